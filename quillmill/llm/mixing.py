"""Mixing sources to target weights.

Systematic sampling: a document of a source is wanted ``rate`` times, the same for all documents of the source; the running sum of
the wanted copies, in an order by size, plus one random offset per plan and source, gives a copy for every integer boundary that a
document crosses. So no document is taken more than ``ceil(rate)`` times, small and large documents are taken alike, and a
source's size misses what is wanted by less than a document or so.

Sizes are tokens of a public tokenizer. Sources are compared trimmed and lower-cased; documents without one belong to none. Targets
of a plan are divided by their sum; a source gets its share of ``budget_ratio`` times the size of all documents, or as much as
``max_repeats`` allows (null: no bound). What a missing or small source lacks is not given to others, which would move them away
from their own targets; the shares reached are reported.

Null and empty texts have no tokens and are not taken, null ids are kept out, repeated rows count once, targets that are null or not
positive want nothing, of several rows for one plan and source the shares add up and the least bound holds. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Ranks of a byte-pair vocabulary; a parameter of every operator here.
VOCABULARY = os.environ.get("QUILLMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern by which the vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def source_key(source: Column) -> Column:
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens) of all documents with text, each once."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).alias("body")).where("doc_id is not null and body <> ''")
    kind = dict(rows.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in batches:
            sizes = [len(known.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {kind}, source string, n_tokens long").dropDuplicates(["doc_id"])


def ranked(sizes: DataFrame) -> DataFrame:
    """The documents with their place in their source, by size: ranges are sorted apart, then shifted by the counts of the ranges before.

    No source passes through one task, however large its share.
    """
    kind = dict(sizes.dtypes)["doc_id"]
    ordered = sizes.where("source is not null").withColumn("h", F.xxhash64("doc_id")).repartitionByRange("source", "n_tokens", "h", "doc_id").sortWithinPartitions("source", "n_tokens", "h", "doc_id")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            places = np.empty(batch.num_rows, np.int64)
            for k, s in enumerate(batch.column(1).to_pylist()):
                places[k] = seen[s] = seen.get(s, -1) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(places)], names=["doc_id", "source", "n_tokens", "part", "place"])

    placed = checkpointed(ordered.select("doc_id", "source", "n_tokens", F.spark_partition_id().alias("part")).mapInArrow(place, f"doc_id {kind}, source string, n_tokens long, part int, place long"))
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"))
    # one row per source and range: a running sum over at most as many rows as there are ranges
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return placed.join(before, ["source", "part"]).select("doc_id", "source", "n_tokens", (F.col("before") + F.col("place")).alias("rank"))


def rates(sizes: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """One row per plan and source: target, wanted tokens, copies wanted of each document, offset. Sources number some dozens."""
    wanted = (
        targets.select("mix_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and mix_id is not null and target_share > 0")
        .groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most"))
    )
    wholes = wanted.groupBy("mix_id").agg(F.sum("share").alias("whole"))
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("documents"))
    total = held.agg(F.sum("held").alias("total"))
    ratios = plans.where("mix_id is not null and budget_ratio > 0").groupBy("mix_id").agg(F.max("budget_ratio").alias("budget_ratio"))
    rows = wanted.join(wholes, "mix_id").join(ratios, "mix_id").join(held.where("source is not null"), "source", "left").join(F.broadcast(total))
    size = F.coalesce("held", F.lit(0))
    want = F.col("share") / F.col("whole") * F.col("budget_ratio") * F.col("total")
    rate = F.when(size > 0, F.least(want / size, F.when(F.col("most").isNull(), F.lit(float("inf"))).otherwise(F.greatest("most", F.lit(0)).cast("double")))).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source"), F.lit(1 << 31)) / float(1 << 31)
    return rows.select("mix_id", "source", (F.col("share") / F.col("whole")).alias("target_share"), want.alias("wanted_tokens"), "most", size.alias("source_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), rate.alias("rate"), offset.alias("offset"))


def selection(documents: DataFrame, plans: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """((mix_id, doc_id, source, n_tokens, copies), rates): the documents of each plan's mixture with the times each is taken."""
    sizes = checkpointed(sized(documents, vocabulary))
    wanted = checkpointed(rates(sizes, plans, targets, seed))
    at = lambda place: F.floor(F.col("rate") * place + F.col("offset"))
    chosen = ranked(sizes).join(F.broadcast(wanted.where("rate > 0").select("mix_id", "source", "rate", "offset")), "source")
    copies = (at(F.col("rank") + 1) - at(F.col("rank"))).alias("copies")
    return chosen.select("mix_id", "doc_id", "source", "n_tokens", copies).where("copies > 0"), wanted


def shares(documents: DataFrame, plans: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """Per plan and source: target share, tokens wanted and reached, share of the mixture reached, and copies."""
    chosen, wanted = selection(documents, plans, targets, vocabulary, seed)
    reached = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    rows = wanted.join(reached, ["mix_id", "source"], "left").na.fill(0, ["tokens", "copies", "most_copies"])
    whole = rows.groupBy("mix_id").agg(F.sum("tokens").alias("mixture"))
    return rows.join(whole, "mix_id").select("mix_id", "source", "target_share", "wanted_tokens", F.col("tokens").alias("reached_tokens"), (F.col("tokens") / F.nullif("mixture", F.lit(0))).alias("reached_share"), "source_tokens", "documents", "copies", "most_copies", F.col("most").alias("max_repeats"))
