"""Nearest neighbours of dense vectors: exact, by blocks of a query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries held at once by a worker; a larger query set makes further passes.
BLOCK = 4096


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(-1, dimension)


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, least: float = 0.82, dimension: int | None = None, exclude_self: bool = True) -> DataFrame:
    """(key, other, similarity): each query's nearest base row by cosine clamped to [0, 1], null if it is below ``least`` or not above 0.

    The stated query set is sent to the base rows in blocks; each task keeps one best row per query and the maxima are reduced after,
    so what moves is queries x tasks. Of equally near rows the smaller key wins (similarities are compared at twelve digits). Null
    vectors and vectors of another dimension are no one's neighbours.
    """
    if dimension is None:
        first = base.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
        dimension = first.n if first else 0
    good = F.col(vector).isNotNull() & (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull())
    asked = queries.where(good).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    rows = base.where(good).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    context = queries.sparkSession.sparkContext
    blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)).toArrow()
        matrix = _matrix(part.column("v").combine_chunks(), dimension) if part.num_rows else np.zeros((0, dimension or 1))
        sent = context.broadcast((np.array(part.column("key")), matrix))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            norms = np.linalg.norm(q, axis=1)
            q = np.divide(q, norms[:, None], out=np.zeros_like(q), where=norms[:, None] > 0)
            top = np.full(len(keys), -1.0)
            who = np.full(len(keys), -1, np.int64)
            for batch in batches:
                if not batch.num_rows or not len(keys):
                    continue
                mine = np.array(batch.column(0))
                x = _matrix(batch.column(1), dimension)
                size = np.linalg.norm(x, axis=1)
                x = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
                order = np.argsort(mine)
                mine = mine[order]
                s = np.round(np.clip(q @ x[order].T, 0, 1), 12)
                if exclude_self:
                    s[keys[:, None] == mine[None, :]] = -1
                at = s.argmax(axis=1)
                value = s[np.arange(len(keys)), at]
                better = (value > top) | ((value == top) & (mine[at] < who))
                top[better], who[better] = value[better], mine[at][better]
            hit = top > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(who[hit]), pa.array(top[hit])], names=["key", "other", "similarity"])

        near = rows.mapInArrow(best, "key long, other long, similarity double")
        found = near if found is None else found.unionByName(near)
    top = found.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("m"))
    hit = -F.col("m.s") >= least
    return asked.select("key").distinct().join(top, "key", "left").select(F.col("key").alias(key), F.when(hit, F.col("m.other")).alias("other"), F.when(hit, -F.col("m.s")).alias("similarity"))
