"""State between runs: reliable checkpoints, versioned Parquet tables, caches with an age and a size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names. A folder of our own serves only local
    sessions that name none; on a cluster it would lie on one machine, so that is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillmill-checkpoint-"))
    return df.checkpoint()


def write_state(df: DataFrame, path: str, version: int) -> None:
    """A state table; its version is a partition, so a reader of another version prunes it."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def read_state(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Rows of this version only; none if another version wrote the table."""
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")


def cache_split(live: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses to recompute) of live rows by equal keys."""
    return live.join(cache, keys), live.join(cache, keys, "left_anti")


def cleaned_cache(cache: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Cached rows whose key is still live."""
    return cache.join(live.select(*keys).distinct(), keys, "left_semi")


def fresh(rows: DataFrame, at: str, now: Column, ttl_seconds: int, keep: int | None = None, key: str | None = None) -> DataFrame:
    """Rows not older than the time to live; with ``keep``, only the rows most recently used."""
    live = rows.where((now.cast("timestamp") - F.col(at)) <= F.expr(f"interval {ttl_seconds} seconds"))
    return live.orderBy(F.col(at).desc(), *([key] if key else [])).limit(keep) if keep else live


def history_tail(history: DataFrame, at: str, tie: str, keep: int = 50) -> DataFrame:
    """The last entries of a history: a top-k, which Spark runs without sorting everything."""
    return history.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(keep)


def first_entry(history: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The first entry of each key, for the check whether a source was taken in before."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    return history.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
