"""New batches against all history.

The history is kept as shards of an index: one row per accepted entry and element of its prefix (see ``near_dups``), with the bitmap of
its tokens, the elements of every entry, and the order of common elements by which the shard's prefixes were taken. A batch's prefixes
are taken in the order of each shard and meet only the groups that it shares with it; the bounds of ``near_dups`` drop what can't reach
the overlap, and what is left is compared exactly, so no entry is lost. The history's texts and tokens are never read again. Each
accepted batch becomes a shard of its own (``build`` with the next number, then ``write``, which appends); ``compacted`` merges shards
and drops entries that are no longer in force. ``known_already`` has one table of history and one of notes: one shard, one batch.

Null or blank contents and null ids or paths take no part; repeated rows count once; of a path only the row with the greatest mtime
is in force (of equal ones the one with the greater key); entries without counted tokens are similar to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bags, near_dups
from .common import HAN, checkpointed, js_blank

#: Least overlap that a shard's prefixes are made for.
LEAST = 0.5
_RUN = re.compile(rf"[a-z0-9_{HAN}]+")
_HAN = re.compile(f"[{HAN}]")


def content_tokens(text: str) -> list[str]:
    """Han-free runs of four or more of ``[a-z0-9_]``, and the three-character pieces that hold a Han character of other runs."""
    out = []
    for run in _RUN.findall(text):
        if run.isascii():
            if len(run) > 3:
                out.append(run)
        elif len(run) > 2:
            pieces = map(add, map(add, run, run[1:]), run[2:])
            if sum(map(str.isascii, run)) < 3:
                out += pieces
            else:
                out += [p for p in pieces if not p.isascii()]
    return out


def _counted(token: str | None) -> bool:
    if not token or token.startswith("W:"):
        return False
    return len(token) > 3 if _HAN.search(token) is None else len(token) == 3


def entry_sets(features: DataFrame) -> DataFrame:
    """(path, class_key, elements) of the entries in force, from their token counts."""
    source = features.select("path", F.coalesce("mtime", F.lit(-(2**62))).alias("mtime"), F.col("tokens").alias("tokens")).where("path is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            coded = flat.field(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            good = np.array([_counted(t) for t in names] + [False])
            hashes = np.array([bags.token_hash(t) if t else 0 for t in names] + [0], np.uint64)
            code = pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False)
            count = np.maximum(pc.fill_null(flat.field(1), 1).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            keep = good[code] & (count > 0)
            found = bags.Bags(doc[keep], hashes[code[keep]], count[keep], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.keys()), found.binary()], names=["path", "mtime", "class_key", "elements"])

    rows = source.mapInArrow(read, "path string, mtime long, class_key long, elements binary")
    force = rows.groupBy("path").agg(F.max_by(F.struct("class_key", "elements"), F.struct("mtime", "class_key")).alias("last"))
    return force.select("path", "last.class_key", "last.elements").where(F.length("elements") > 0)


class Shards:
    """The index: (path, class_key, buckets, shard) members, (class_key, elements) entries, prefix rows, and (element, rank) of common elements."""

    TABLES = ("members", "entries", "prefixes", "common")

    def __init__(self, members: DataFrame, entries: DataFrame, prefixes: DataFrame, common: DataFrame):
        self.members, self.entries, self.prefixes, self.common = members, entries, prefixes, common

    @classmethod
    def build(cls, sets: DataFrame, shard: int = 0) -> Shards:
        """A shard over (path, class_key, elements)."""
        number = F.lit(shard).alias("shard")
        entries = sets.select("class_key", "elements")
        common = near_dups.common_elements(entries)
        ranks = sets.sparkSession.createDataFrame(pa.table({"element": common.astype(np.int64), "rank": np.arange(len(common))}))
        buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(
            sets.select("path", "class_key", F.lit(buckets).alias("buckets"), number),
            entries.select("*", number),
            near_dups.prefix_rows(entries, LEAST, common, side=1, salt=shard, buckets=buckets).drop("buckets").withColumn("shard", number),
            ranks.select("*", number),
        )

    def write(self, folder: str) -> None:
        """Append these shards to a folder of Parquet tables; shards already there stay as they are."""
        for name in self.TABLES:
            getattr(self, name).write.mode("append").partitionBy("shard").parquet(f"{folder}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Shards:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in cls.TABLES))

    def union(self, other: Shards) -> Shards:
        return Shards(*(getattr(self, name).unionByName(getattr(other, name)) for name in self.TABLES))

    def compacted(self, shard: int) -> Shards:
        """All shards as one, in an order of its own: of a path that several shards hold, the latest shard's entry stays."""
        last = self.members.groupBy("path").agg(F.max_by("class_key", "shard").alias("class_key"))
        return Shards.build(checkpointed(last.join(near_dups.classes(self.entries), "class_key").select("path", "class_key", "elements")), shard)


def probe(batch: DataFrame, shards: Shards, least: float = LEAST) -> DataFrame:
    """(id, path, overlap): entries of the shards whose overlap with a row of (id, class_key, elements) is at least ``least``."""
    if least < LEAST:
        raise ValueError(f"the shards hold prefixes for overlaps from {LEAST} on")
    spread = shards.prefixes.select("bucket", "members")
    for shard, buckets in sorted((r.shard, r.buckets) for r in shards.members.select("shard", "buckets").distinct().collect()):
        ranks = shards.common.where(F.col("shard") == shard).select("element", "rank").toArrow().sort_by("rank")
        mine = near_dups.prefix_rows(batch, LEAST, ranks.column("element").to_numpy().astype(np.uint32), salt=shard, buckets=buckets)
        spread = spread.unionByName(mine.drop("buckets"))
    pairs = near_dups.candidate_pairs(spread, least, two_sided=True)
    links = near_dups.compared(pairs, batch, shards.entries.select("class_key", "elements"), least)
    ids = batch.select("id", F.col("class_key").alias("a")).distinct()
    paths = shards.members.select("path", F.col("class_key").alias("b")).distinct()
    return links.join(ids, "a").join(paths, "b").select("id", "path", "overlap")


def batch_sets(notes: DataFrame, ident: str = "id", content: str = "content") -> DataFrame:
    return near_dups.text_sets(notes.where(~js_blank(F.col(content))), ident, F.col(content), content_tokens)


def known_already(notes: DataFrame, features: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, path, overlap) of all notes against the entries in force."""
    shards = Shards.build(checkpointed(entry_sets(features)))
    return probe(checkpointed(batch_sets(notes)), shards, least)
