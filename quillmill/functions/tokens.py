"""Tokens of mixed Han and Latin text, as column expressions.

Text is lower-cased and cut into runs of ASCII letters, digits, ``_`` and Han characters. A run without Han is one token if it has
two characters or more; a run with Han gives all its n-grams (its 2-gram where it is shorter than n). Stop words are left out.
With a dictionary, the words of the best segmentation of a Han run come first, marked ``W:``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import STOP_WORDS, stop_words

CHUNK = "[a-z0-9_一-鿿]+"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CHUNK), 0)


def _grams(chunk: Column, n: int) -> Column:
    size = F.length(chunk)
    every = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: chunk.substr(i, F.lit(n)))
    grams = F.when(size >= n, every)
    if n > 2:
        grams = grams.when(size >= 2, F.transform(F.sequence(F.lit(1), size - 1), lambda i: chunk.substr(i, F.lit(2))))
    return grams.otherwise(F.array().cast("array<string>"))


def tokens(text: Column, n: int = 3) -> Column:
    """All tokens in order of occurrence, repeats included."""
    none = F.array().cast("array<string>")

    def of(chunk: Column) -> Column:
        return F.when(chunk.rlike("[一-鿿]"), _grams(chunk, n)).when(F.length(chunk) >= 2, F.array(chunk)).otherwise(none)

    return F.filter(F.flatten(F.transform(chunks(text), of)), lambda t: ~F.array_contains(stop_words(), t))


def keyword_set(text: Column) -> Column:
    """Distinct 2-gram tokens in order of first occurrence."""
    return F.array_distinct(tokens(text, 2))


def token_stats(values: Column) -> Column:
    """Struct of the number of values, of distinct values, and of the most frequent value, in one pass over the sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("different"), F.lit(0).alias("top"))

    def step(a: Column, v: Column) -> Column:
        same = a["last"].eqNullSafe(v)
        run = F.when(same, a["run"] + 1).otherwise(1)
        return F.struct(v.alias("last"), run.alias("run"), (a["different"] + F.when(same, 0).otherwise(1)).alias("different"), F.greatest(a["top"], run).alias("top"))

    return F.aggregate(F.array_sort(values), start, step, lambda a: F.struct(F.size(values).alias("total"), a["different"].alias("different"), a["top"].alias("top")))


def token_counts(rows: DataFrame, key: str, text: Column, n: int = 3) -> DataFrame:
    """(key, token, cnt, pos): one row per distinct token of a row, ``pos`` is its first place. Partial counts precede the shuffle."""
    spread = rows.select(F.col(key), F.posexplode(tokens(text, n)).alias("pos", "token"))
    return spread.groupBy(key, "token").agg(F.count("*").alias("cnt"), F.min("pos").alias("pos"))


class Segmenter:
    """Best path through a dictionary's words by log frequency, from right to left; of equal paths the one with the shorter word.

    A trie holds the words, so that a place costs no more than its longest word. Where words begin but none of one character does, a
    single character is no way on.
    """

    def __init__(self, words: dict[str, int], total: int):
        self.unknown = math.log(1 / total)
        self.trie: dict = {}
        for word, times in words.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = math.log((times or 1) / total)

    def cut(self, text: str) -> list[str]:
        n = len(text)
        score, to = [0.0] * (n + 1), [0] * (n + 1)
        for k in range(n - 1, -1, -1):
            best, end = -math.inf, k + 1
            node, j = self.trie.get(text[k]), k + 1
            while node is not None:
                cost = node.get("")
                if cost is not None and cost + score[j] > best:
                    best, end = cost + score[j], j
                node = node.get(text[j]) if j < n else None
                j += 1
            score[k], to[k] = (best, end) if best > -math.inf else (self.unknown + score[k + 1], k + 1)
        out, k = [], 0
        while k < n:
            out.append(text[k : to[k]])
            k = to[k]
        return out


def segmented(rows: DataFrame, key: str, text: Column, words: dict[str, int], total: int) -> DataFrame:
    """(key, words): dictionary words of two characters or more in each Han run, marked ``W:``, in order; rows without Han are not sent to Python."""
    found = rows.select(F.col(key), F.filter(chunks(text), lambda c: c.rlike("[一-鿿]")).alias("runs")).where(F.size("runs") > 0)
    sent = rows.sparkSession.sparkContext.broadcast((words, total))
    stop = set(STOP_WORDS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(*sent.value)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "words": [["W:" + w for run in runs for w in segmenter.cut(run) if len(w) > 1 and w not in stop] for runs in batch["runs"]]})

    return found.mapInPandas(cut, f"{key} {dict(rows.dtypes)[key]}, words array<string>")
