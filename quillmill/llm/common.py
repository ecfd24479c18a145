"""What the operators of this package share: reading, lineage cuts, tokens, Arrow helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed range: the Han characters that the tables' definitions count.
HAN = "一-鿿"
#: A Han character, or a maximal run of other letters and digits.
UNIT = re.compile(rf"[{HAN}]|[^\W_{HAN}]+")
#: A run of letters and digits that holds no Han character, of four or more; and a run of Han.
WORD4 = re.compile(rf"[^\W_{HAN}]{{4,}}")
HAN_RUN = re.compile(rf"[{HAN}]{{2,}}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


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


def js_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text (Unicode white space included)."""
    return F.coalesce(F.regexp_replace(text, r"(?U)[\s\p{Z}\x{FEFF}]+", "") == "", F.lit(True))
