"""A dictionary of Han words, drawn from a corpus, for segmentation.

A run of two to four Han characters is a word if it occurs often and holds together: at every place where it could be cut, it occurs many
times as often as its two parts would by chance. All counts come from all rows; only the words that stand the test are collected, and
their number is bounded by a parameter that is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import STOP_WORDS
from .tokens import Segmenter, chunks

LONGEST = 4
#: Words that are sent to the workers at most.
MOST_WORDS = 2_000_000


def gram_counts(rows: DataFrame, text: str) -> DataFrame:
    """(gram, n): runs of one to four Han characters."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[\u4e00-\u9fff]+"), F.lit(0))

    def grams(run: Column) -> Column:
        one = lambda n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda k: run.substr(k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[one(n) for n in range(1, LONGEST + 1)])

    return rows.select(F.explode(F.flatten(F.transform(runs, grams))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def words(rows: DataFrame, text: str, least: int = 5, cohesion: float = 20.0) -> DataFrame:
    """(word, n): grams of two characters or more, seen ``least`` times, ``cohesion`` times as often as the parts of any cut by chance."""
    counted = gram_counts(rows, text)
    total = counted.where(F.length("gram") == 1).agg(F.sum("n").alias("total"))
    often = counted.where((F.length("gram") > 1) & (F.col("n") >= least))
    cuts = often.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("cut"))
    parts = cuts.select("gram", "n", F.expr("substring(gram, 1, cut)").alias("a"), F.expr("substring(gram, cut + 1)").alias("b"))
    part = lambda name: counted.select(F.col("gram").alias(name), F.col("n").alias(f"n{name}"))
    tied = parts.join(part("a"), "a").join(part("b"), "b").crossJoin(F.broadcast(total))  # one row
    bond = F.col("n") * F.col("total") / (F.col("na") * F.col("nb").cast("double"))
    return tied.groupBy(F.col("gram").alias("word")).agg(F.max("n").alias("n"), F.min(bond).alias("bond")).where(F.col("bond") >= cohesion).select("word", "n")


def word_counts(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, token, cnt): dictionary words of two characters or more in each row, marked ``W:``, stop words left out."""
    n = dictionary.count()
    if n > MOST_WORDS:
        raise ValueError(f"{n} words are too many to send to every worker")
    known = dictionary.toArrow()
    table = dict(zip(known.column("word").to_pylist(), known.column("n").to_pylist(), strict=True))
    sent = rows.sparkSession.sparkContext.broadcast((table, max(1, sum(table.values()))))
    stop = set(STOP_WORDS)
    found = rows.select(F.col(key).alias("key"), F.filter(chunks(F.col(text)), lambda c: c.rlike("[\u4e00-\u9fff]")).alias("runs")).where(F.size("runs") > 0)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(*sent.value)
        for batch in batches:
            out: list[tuple] = []
            for k, runs in zip(batch["key"], batch["runs"], strict=True):
                seen: dict[str, int] = {}
                for run in runs:
                    for w in segmenter.cut(run):
                        if len(w) > 1 and w not in stop:
                            seen["W:" + w] = seen.get("W:" + w, 0) + 1
                out += [(k, w, c) for w, c in seen.items()]
            yield pd.DataFrame(out, columns=[key, "token", "cnt"])

    return found.mapInPandas(cut, f"{key} {dict(rows.dtypes)[key]}, token string, cnt long")
