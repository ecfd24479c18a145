"""Change feeds: renames as a removal and an upsert, bursts as their last event, and the upkeep of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_renames(events: DataFrame) -> DataFrame:
    """(ts, path, op) of create, modify, delete and rename events; a rename removes the old path and upserts the new one."""
    renamed = F.array(F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("op")), F.struct(F.col("path").alias("path"), F.lit("modify").alias("op")))
    plain = F.array(F.struct(F.col("path").alias("path"), F.col("op").alias("op")))
    return events.select("ts", F.explode(F.when(F.col("op") == "rename", renamed).otherwise(plain)).alias("e")).select("ts", "e.path", "e.op").where("path is not null")


def debounced(events: DataFrame, key: str, ts: str, value: str, gap: str = "1 second", watermark: str | None = "1 minute") -> DataFrame:
    """(key, window, last, n): a burst of events of a key is one row with its last event. Works on streams and on tables."""
    rows = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    return rows.groupBy(key, F.session_window(ts, gap).alias("window")).agg(F.max_by(value, ts).alias("last"), F.count("*").alias("n"))


def bursts(events: DataFrame, key: str, ts: str, value: str, tie: str, gap_seconds: float) -> DataFrame:
    """The same over a table by gaps and islands, with ties settled: (key, burst_start, burst_end, n, last)."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(order)) >= int(gap_seconds * 1_000_000), F.lit(True))
    islands = events.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(key, "_island").agg(F.min(ts).alias("burst_start"), F.max(ts).alias("burst_end"), F.count("*").alias("n"), F.max_by(value, F.struct(ts, tie)).alias("last")).drop("_island")


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key."""
    columns = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def upserted(index: DataFrame, changes: DataFrame, key: str, order: str, op: str = "op") -> DataFrame:
    """The index after a batch of changes: untouched rows, and the last change of each other key unless it is a removal."""
    last = latest(changes, key, order)
    keep = index.join(last.select(key), key, "left_anti")
    new = last.where(F.col(op) != "delete").select(*index.columns)
    return keep.unionByName(new)


def frequencies_after(frequencies: DataFrame, changes: DataFrame) -> DataFrame:
    """Document frequencies (token, df) after signed changes (token, sign); tokens that no document holds any more go."""
    both = frequencies.select("token", "df").unionByName(changes.select("token", F.col("sign").cast("long").alias("df")))
    return both.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")


def current_version(spark: SparkSession, path: str) -> int | None:
    """The greatest version of an index that was written to its end; None if there is no index."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    names = [(f.getPath().getName(), f.getPath()) for f in system.listStatus(folder)]
    done = [int(n.split("=")[1]) for n, p in names if n.startswith("v=") and system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def current_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index as its last finished version holds it."""
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v={version}")


def maintain(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, trigger: str = "1 second"):
    """Keep a Parquet index current from a stream of changes. Each batch writes a new version beside the one it read, so a failed write
    leaves the index as it was and a batch that comes again does its work again; versions before the last but one are removed."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        jvm = spark.sparkContext._jvm
        version = current_version(spark, path)
        if version is not None and version > number:
            return  # a batch from before: its changes are in the index
        last = None if version is None else version if version < number else version - 1
        index = batch.drop("op").limit(0) if last is None or last < 0 else spark.read.parquet(f"{path}/v={last}")
        upserted(index, batch, key, order).write.mode("overwrite").parquet(f"{path}/v={number}")
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def first_submissions(stream: DataFrame, key: str, ts: str, within: str = "10 minutes") -> DataFrame:
    """The first row of each key; on a stream, within the watermark."""
    if stream.isStreaming:
        return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    return stream.groupBy(key).agg(F.min_by(F.struct(*[c for c in stream.columns if c != key]), ts).alias("_f")).select(key, "_f.*")
