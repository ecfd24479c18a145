"""Token statistics: document frequencies, IDF, saturated term weights, norms and top tokens.

Everything is a grouped aggregate with partial counts before each shuffle; ``group`` names columns that keep corpora apart (a batch,
an extraction), each with its own document count, frequencies and mean length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16_length
from ..functions.tokens import tokens

K1, B = 1.5, 0.75
#: Distinct tokens below which a text is compared with nothing.
LEAST_TOKENS = 3


def counts(rows: DataFrame, key: str, text: str, group: tuple[str, ...] = (), n: int = 3) -> DataFrame:
    """(group, key, len, token, cnt, pos): one row per row and distinct token; keys must be unique (in their group). Null texts have no tokens.

    Tokens are cut by Catalyst and counted within the row, whole batches at a time, so nothing is shuffled.
    """
    kinds = dict(rows.dtypes)
    cut = rows.select(*group, key, utf16_length(F.col(text)).alias("len"), tokens(F.coalesce(F.col(text), F.lit("")), n).alias("tokens"))
    names = [*group, key, "len", "token", "cnt", "pos"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            start = np.concatenate([[0], np.cumsum(size)])
            cell, first, times = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_index=True, return_counts=True)
            at = cell // len(coded.dictionary)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), coded.dictionary.take(pa.array(cell % len(coded.dictionary))), pa.array(times, pa.int64()), pa.array((first - start[at]).astype(np.int32))], names=names)

    return cut.mapInArrow(count, ", ".join([*(f"{c} {kinds[c]}" for c in (*group, key)), "len int, token string, cnt long, pos int"]))


def corpus_size(rows: DataFrame, key: str, text: str, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, docs, avg_len)"""
    return rows.groupBy(*group).agg(F.count(key).alias("docs"), F.avg(utf16_length(F.coalesce(F.col(text), F.lit("")))).alias("avg_len"))


def idf(token_counts: DataFrame, sizes: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, token, df, idf) with smoothing: ln((N+1)/(df+1))+1"""
    found = token_counts.where("token is not null").groupBy(*group, "token").agg(F.count("*").alias("df"))
    joined = found.join(sizes, list(group)) if group else found.crossJoin(F.broadcast(sizes))  # without groups it is one row
    return joined.select(*group, "token", "df", (F.log((F.greatest("docs", F.lit(1)) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weight(cnt: Column, length: Column, avg_len: Column, idf_: Column) -> Column:
    relative = F.when(avg_len > 0, 1 - B + B * length / avg_len).otherwise(1.0)
    return cnt / (cnt + K1 * relative) * idf_


def vectors(rows: DataFrame, key: str, text: str, group: tuple[str, ...] = (), n: int = 3) -> DataFrame:
    """(group, key, len, token, cnt, pos, df, w): long sparse vectors of a corpus against itself."""
    found = counts(rows, key, text, group, n)
    sizes = corpus_size(rows, key, text, group)
    table = idf(found, sizes, group)
    weighed = found.where("token is not null").join(table, [*group, "token"])
    weighed = weighed.join(sizes, list(group)) if group else weighed.crossJoin(F.broadcast(sizes))
    return weighed.select(*group, key, "len", "token", "cnt", "pos", "df", weight(F.col("cnt"), F.col("len"), F.col("avg_len"), F.col("idf")).alias("w"))


def norms(long: DataFrame, key: str, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, key, n_tokens, norm) by partial sums alone."""
    return long.groupBy(*group, key).agg(F.count("*").alias("n_tokens"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def top(long: DataFrame, key: str, group: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """The rows of the k heaviest tokens of each key, earlier ones first among equals.

    Equal weights are compared at twelve digits, so that the order doesn't hang on the last bit of a logarithm. Each partition is cut to
    its own first k of a key before anything moves.
    """
    order = Window.partitionBy(*group, key).orderBy(F.round("w", 12).desc(), "pos")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def summary(long: DataFrame, key: str, group: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """(group, key, n_tokens, norm, top_tokens, top_df)"""
    best = top(long, key, group, k).groupBy(*group, key).agg(F.sort_array(F.collect_list(F.struct("rank", "token", "df"))).alias("_v"))
    tops = best.select(*group, key, F.transform("_v", lambda x: x["token"]).alias("top_tokens"), F.transform("_v", lambda x: x["df"]).alias("top_df"))
    return norms(long, key, group).join(tops, [*group, key])


def dots(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, a: str, b: str, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, a, b, dot) of pairs of keys, over their common tokens; weights are read only for keys that stand in a pair."""
    of_a = pairs.select(*group, a, b).join(left.select(*group, F.col(key).alias(a), "token", F.col("w").alias("_wa")), [*group, a])
    both = of_a.join(right.select(*group, F.col(key).alias(b), "token", F.col("w").alias("_wb")), [*group, b, "token"])
    return both.groupBy(*group, a, b).agg(F.sum(F.col("_wa") * F.col("_wb")).alias("dot"))


def ordered_weights(long: DataFrame, key: str, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, key, tokens, weights) in order of first occurrence, as fingerprints need them."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "token", "w")))
    found = long.groupBy(*group, key).agg(packed.alias("_v"))
    return found.select(*group, key, F.transform("_v", lambda x: x["token"]).alias("tokens"), F.transform("_v", lambda x: x["w"]).alias("weights"))


def sparse_cosine(dot: Column, norm_a: Column, norm_b: Column, n_a: Column, n_b: Column) -> Column:
    """0 for texts with too few distinct tokens or without weight, else clamped to [0, 1]; a missing product is 0."""
    few = (n_a < LEAST_TOKENS) | (n_b < LEAST_TOKENS) | (norm_a == 0) | (norm_b == 0)
    return F.when(F.coalesce(few, F.lit(True)), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot, F.lit(0.0)) / (norm_a * norm_b))))


def first_rows(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ``row_number`` with a limit lets the planner cut each partition before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
