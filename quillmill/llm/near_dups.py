"""Groups of records that say nearly the same.

Token-group matrix: similar records are partitioned into groups (overlapping ones), each member row brings the bitmap of its tokens, the
bound on the overlap of a query and a group follows from the bits of the query that the group's union lacks, and only what the bound lets
through is opened, that is, compared exactly on whole element sets. Within a group the bound is taken against the unions of sub-groups
first, then against single members.

Groups are the elements of a prefix filter: all sets are put in one order, rare elements first, and a set of n elements joins the groups of
its first n - ceil(least * n) + 1. Two sets whose overlap reaches ``least`` share one of them, at places that leave enough of both behind,
so no pair is lost, neither by the groups nor by the bounds. Equal records collapse to one class before anything else, so copies cost
nothing however many there are.

Null titles count as empty; null or blank contents and null ids take no part; repeated rows count once; texts without tokens are
similar to nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bags
from .common import checkpointed, js_blank

#: Members of a sub-group, whose union is bounded before its members are.
SUBGROUP = 64
#: Layout of a place, see ``unpacked``.
_SIZE_BITS = 16
_GROUP = np.uint64(0xFFFFFFFF)
_BIG = (1 << (_SIZE_BITS - 1)) - 1
#: Share of all sets from which on an element's frequency counts in the order; a set has few such elements, so their list is bounded.
COMMON_SHARE = 1e-4
_PAIR_COLUMNS = 1024
#: Words of the bitmaps that are met for all pairs of a table; the others are met for pairs that these let through.
_FIRST_WORDS = 4
#: Keys that are broadcast at most, eight bytes each; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def text_sets(rows: DataFrame, ident: str, text: Column, tokens=bags.word_tokens) -> DataFrame:
    """(id, class_key, elements): one row per row with tokens; ``class_key`` is equal for equal element sets."""
    source = rows.select(F.col(ident).alias("id"), text.alias("body")).where("id is not null and body is not null")
    kind = dict(source.dtypes)["id"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags.Bags.of_texts([tokens(t.lower()) for t in batch.column(1).to_pylist()])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.keys()), found.binary()], names=["id", "class_key", "elements"])
            yield out.filter(pa.array(found.sizes() > 0))

    return source.mapInArrow(split, f"id {kind}, class_key long, elements binary")


def common_elements(sets: DataFrame, share: float = COMMON_SHARE) -> np.ndarray:
    """Elements that more than ``share`` of all sets hold, the rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(bags.Sets(batch.column(0)).flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n)], names=["element", "n"])

    least = share * sets.count()
    counted = sets.select("elements").mapInArrow(count, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    found = counted.toArrow()
    element, n = (found.column(k).to_numpy() for k in (0, 1))
    return element[np.lexsort((element, n))].astype(np.uint32)


def lanes(n: int) -> np.ndarray:
    """n numbers that Spark's hash partitioning sends to n different partitions, in order."""
    tries = np.arange(max(64, 30 * n), dtype=np.uint32)
    turned = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    h = turned(turned(tries * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(by))) * np.uint32(factor)
    place = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
    found, first = np.unique(place, return_index=True)
    out = np.arange(n)
    out[found] = first  # a number that was not met keeps its own, which only makes it share a partition
    return out.astype(np.int32)


def prefix_rows(sets: DataFrame, least: float, common: np.ndarray, side: int = 0, salt: int = 0, buckets: int | None = None) -> DataFrame:
    """(bucket, buckets, members): the sets' places in the groups of their prefixes, in the order of ``common``; other elements come before
    them. Groups lie in ``buckets`` (by default as many as the session has shuffle partitions, numbered so that each gets one), and what a batch of sets has in one bucket
    is one row, packed: a set's key and bitmap stand there once, however many of the bucket's groups it is in.

    Both sides of a comparison need the same ``common``, ``salt`` and ``buckets``.
    """
    spark = sets.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(common)
    salted = np.uint64(bags.mix(np.array([salt], np.uint64))[0] >> np.uint64(32))
    first = np.uint64(1 << 32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value.astype(np.uint64)
        by_element = np.argsort(common)
        ordered = common[by_element]
        for batch in batches:
            _, rows = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(rows))
            read = bags.Sets(batch.column(1))
            if not len(read.flat):
                continue
            size = read.sizes()
            flat = read.flat.astype(np.uint64)
            rank = flat
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, flat), len(ordered) - 1)
                rank = np.where(ordered[at] == flat, by_element[at].astype(np.uint64) + first, flat)
            rank = np.sort((np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(34)) | rank)
            place = np.arange(len(rank)) - np.repeat(read.starts[:-1], size)
            length = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
            inside = place < np.repeat(np.minimum(length, size), size)
            doc = (rank[inside] >> np.uint64(34)).astype(np.int64)
            rank = rank[inside] & np.uint64((1 << 34) - 1)
            element = rank.copy()
            element[rank >= first] = common[(rank[rank >= first] - first).astype(np.int64)]
            # sets too large for their size to be told are never bounded
            place = np.where(size[doc] >= _BIG, 0, place[inside])
            element ^= salted
            bucket = (bags.mix(element) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            bucket, doc, element, place = bucket[order], doc[order], element[order].astype(np.uint32), place[order].astype(np.uint16)
            keys, bits = batch.column(0).to_numpy(), bags.bitmaps(read.flat, read.starts)
            found, starts = np.unique(bucket, return_index=True)
            lane = lanes(buckets)
            packed = []
            for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
                members, times = np.unique(doc[a:b], return_counts=True)
                head = np.array([len(members), b - a], np.int64)
                sizes = (np.minimum(size[members], _BIG) | (side << (_SIZE_BITS - 1))).astype(np.uint16)
                packed.append(b"".join(x.tobytes() for x in (head, keys[members], bits[members], element[a:b], sizes, times.astype(np.uint16), place[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(lane[found]), pa.array(np.full(len(found), buckets, np.int32)), pa.array(packed, pa.binary())], names=["bucket", "buckets", "members"])

    return sets.select("class_key", "elements").mapInArrow(spread, "bucket int, buckets int, members binary")


def unpacked(members: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, class key, bitmap) of each set in each group: ``place`` holds the place of the group's element in the set (16 bits), the group
    (32), the side (1) and the set's size (15)."""
    places, keys, bits = [], [], []
    for blob in members:
        n, m = np.frombuffer(blob, np.int64, 2)
        at = 16
        parts = []
        for kind, length in ((np.int64, n), (np.uint64, n * bags.BITMAP_WORDS), (np.uint32, m), (np.uint16, n), (np.uint16, n), (np.uint16, m)):
            parts.append(np.frombuffer(blob, kind, int(length), at))
            at += parts[-1].nbytes
        key, bitmap, element, size, times, place = parts
        row = np.repeat(np.arange(n), times)
        places.append((place.astype(np.uint64) << np.uint64(48)) | (element.astype(np.uint64) << np.uint64(_SIZE_BITS)) | size[row].astype(np.uint64))
        keys.append(key[row])
        bits.append(bitmap.reshape(n, bags.BITMAP_WORDS)[row])
    return np.concatenate(places).view(np.int64), np.concatenate(keys), np.concatenate(bits)


def qualifying(place: np.ndarray, key: np.ndarray, bits: np.ndarray, least: float, two_sided: bool) -> Iterator[np.ndarray]:
    """Pairs of members of a common group that the bounds let through, in pieces of (n, 2) keys.

    A pair needs ``least / (1 + least)`` of both sizes in common. The first common element must leave that many in both sets from its
    place on, and the bits that both have, with the elements that share a bit, bound what is common. Both bounds are exact.
    Groups of up to ``SUBGROUP`` members are compared member by member, all groups of a partition at once, by distance in the
    sorted order. In larger groups blocks of members first meet the unions of sub-groups and only open those that qualify.
    Of a set too large for its size to be told, only the bits of the other bound what is common, and that its size is this or more.
    """
    word = place.view(np.uint64)
    group = (word >> np.uint64(_SIZE_BITS)) & _GROUP
    side = ((word >> np.uint64(_SIZE_BITS - 1)) & np.uint64(1)).astype(np.int8)
    size = (word & np.uint64(_BIG)).astype(np.int64)
    skipped = (word >> np.uint64(48)).astype(np.int64)
    order = np.lexsort((skipped, key, side, group))
    group, side, size, skipped, key, bits = group[order], side[order], size[order], skipped[order], key[order], bits[order]
    keep = np.ones(len(group), bool)
    keep[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (side[1:] != side[:-1])
    group, side, size, skipped, key, bits = group[keep], side[keep], size[keep], skipped[keep], key[keep], bits[keep]
    if not len(group):
        return
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(start, len(group)))
    members = np.repeat(count, count)
    part = least / (1 + least)
    big = size >= _BIG
    ones, later = (np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (bits, bits[:, _FIRST_WORDS:]))
    # part of the size; what is left for the other's part from the element on; common bits needed besides the other's part
    share = (part * size).astype(np.float32)
    room = (size - skipped - part * size + 0.01).astype(np.float32)
    need = (part * size - (size - ones) - 0.01).astype(np.float32)
    room[big], need[big] = np.inf, -np.inf
    early = need - later  # of them in the first words, if the other has all later bits too

    small = np.flatnonzero((members > 1) & (members <= SUBGROUP))
    for step in range(1, SUBGROUP):
        i = small[: len(small) - step] if step < len(small) else small[:0]
        j = small[step:] if step < len(small) else small[:0]
        same = group[i] == group[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        good = (room[i] >= share[j]) & (room[j] >= share[i]) & ((side[i] != side[j]) if two_sided else (key[i] != key[j]))
        i, j = i[good], j[good]
        common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1)
        good = common >= np.maximum(need[i] + share[j], need[j] + share[i])
        yield np.stack([key[i[good]], key[j[good]]], axis=1)
    for g in np.flatnonzero(count > SUBGROUP):
        at = np.arange(start[g], start[g] + count[g])
        queries, others = (at[side[at] == 0], at[side[at] == 1]) if two_sided else (at, at)
        if len(queries) and len(others):
            queries, others = (x[np.lexsort((bits[x, 0], size[x]))] for x in (queries, others))
            yield from _across(queries, others, not two_sided, key, bits, room, share, need, early)


def _across(queries: np.ndarray, others: np.ndarray, same: bool, key: np.ndarray, bits: np.ndarray, room: np.ndarray, share: np.ndarray, need: np.ndarray, early: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of two sides of a group, in pieces; ``same`` where they are one list, smaller sets first, whose pairs count once."""
    edges = np.arange(0, len(others), SUBGROUP)
    union = np.ascontiguousarray(np.bitwise_or.reduceat(bits[others], edges, axis=0).T)
    shares, rooms, earlies = share[others], room[others], early[others]
    low = np.minimum.reduceat(shares, edges)
    columns = np.ascontiguousarray(bits[others].T)
    # of one list the smaller set of a pair asks, for which the element must leave its own part twice
    asking = np.flatnonzero(rooms >= shares) if same else np.arange(len(queries))
    # sets of like size and room ask together, so that few members that one of them can reach are out of the others' reach
    strata = int(np.ceil(np.sqrt(len(asking) / SUBGROUP)))
    asking = asking[np.lexsort((room[queries[asking]], np.arange(len(asking)) * strata // max(1, len(asking))))]
    for k in range(0, len(asking), SUBGROUP):
        rank = asking[k : k + SUBGROUP]
        q = queries[rank]
        # what the element leaves of either side must reach the other's part
        within = (rooms >= share[q].min()) & (shares <= room[q].max())
        if same:
            within[: rank.min() + 1] = False  # each pair once
        blocks = np.flatnonzero(np.logical_or.reduceat(within, edges))
        if not len(blocks):
            continue
        # a set of the sub-group is at least as large as its smallest and shares at most what the union covers
        opened = np.zeros(len(edges), bool)
        opened[blocks] = (_common(bits[q], union[:, blocks], np.uint16) >= need[q][:, None] + low[blocks]).any(axis=0)
        reached = np.flatnonzero(within & np.repeat(opened, SUBGROUP)[: len(others)])
        for c in range(0, len(reached), _PAIR_COLUMNS):
            o = reached[c : c + _PAIR_COLUMNS]
            seen = _common(bits[q, :_FIRST_WORDS], columns[:_FIRST_WORDS, o], np.uint8)
            good = seen - shares[o] >= early[q][:, None]
            good &= seen - earlies[o] >= share[q][:, None]
            at = np.flatnonzero(good)
            i, j = np.divmod(at, len(o))
            left = (room[q][i] >= shares[o][j]) & (rooms[o][j] >= share[q][i])
            if same:
                left &= o[j] > rank[i]
            at, i, j = at[left], i[left], j[left]
            if not len(at):
                continue
            a, b = q[i], others[o[j]]
            common = seen.ravel()[at] + np.bitwise_count(bits[a, _FIRST_WORDS:] & bits[b, _FIRST_WORDS:]).sum(axis=1)
            close = common >= np.maximum(need[a] + share[b], need[b] + share[a])
            yield np.stack([key[a[close]], key[b[close]]], axis=1)


def _common(rows: np.ndarray, columns: np.ndarray, kind: type) -> np.ndarray:
    """Table of the numbers of bits that each row (sets, words) has in common with each column (words, sets)."""
    table = np.zeros((len(rows), columns.shape[1]), kind)
    for w in range(len(columns)):
        table += np.bitwise_count(rows[:, w, None] & columns[w])
    return table


def candidate_pairs(rows: DataFrame, least: float, two_sided: bool = False) -> DataFrame:
    """Distinct (a, b) keys of sets in a common group that the bound lets through; a < b, or a of side 0 and b of side 1."""
    schema = "a long, b long"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = [m for batch in batches for m in batch.column(0).to_pylist()]
        if not members:
            return
        place, key, bits = unpacked(members)
        del members
        held: list[np.ndarray] = []
        total = 0
        for found in qualifying(place, key, bits, least, two_sided):
            if not two_sided:
                found = np.sort(found, axis=1)
            held.append(found)
            total += len(found)
            if total > 2_000_000:
                yield _unique(held)
                held, total = [], 0
        if total:
            yield _unique(held)

    return rows.repartition("bucket").select("members").mapInArrow(match, schema).distinct()


def _unique(held: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(held)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[new, k])) for k in (0, 1)], names=["a", "b"])


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap) of the pairs whose exact overlap reaches ``least``; both sides give (class_key, elements), in one row or more a class."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = bags.Sets(batch.column(2)), bags.Sets(batch.column(3))
            common = bags.intersections(x, y)
            overlap = common / np.maximum(1, x.sizes() + y.sizes() - common)
            good = pa.array(overlap >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlap)], names=["a", "b", "overlap"]).filter(good)

    pairs = checkpointed(pairs)
    sides = [wanted(side, pairs.select(F.col(name).alias("class_key"))).select(F.col("class_key").alias(name), F.col("elements").alias(f"e{name}")) for name, side in (("a", left), ("b", right))]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ea", "eb").mapInArrow(check, "a long, b long, overlap double")


def wanted(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per class that a pair needs; the keys go out as a broadcast while their counted number is small, else by shuffle."""
    keys = keys.distinct()
    few = keys.count() <= BROADCAST_KEYS
    return classes(sets.join(F.broadcast(keys) if few else keys, "class_key", "left_semi"))


def classes(sets: DataFrame) -> DataFrame:
    """One row per class."""
    return sets.groupBy("class_key").agg(F.any_value("elements").alias("elements"))


def class_links(sets: DataFrame, least: float = 0.6) -> DataFrame:
    """(a, b, overlap): links between different classes, each once."""
    return compared(candidate_pairs(prefix_rows(sets, least, common_elements(sets)), least), sets, sets, least)


def note_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("content"))


def near_duplicate_pairs(notes: DataFrame, least: float = 0.6) -> DataFrame:
    """(id_a, id_b): all pairs of records with different ids whose overlap is at least ``least``, copies included."""
    sets = checkpointed(text_sets(notes.where(~js_blank(F.col("content"))), "id", note_text()))
    members = sets.select("id", "class_key").distinct()
    links = class_links(sets, least)
    first, second = (members.select(F.col("class_key").alias(k), F.col("id").alias(f"id_{k}")) for k in "ab")
    across = links.select("a", "b").join(first, "a").join(second, "b").select("id_a", "id_b")
    inside = first.join(second, F.col("a") == F.col("b")).where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(inside).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def near_duplicate_groups(notes: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, class_key, group_key, links): every record with its class of equal texts, its group of linked classes, and its class' links.

    Groups are connected components by smallest key, in alternating star steps over the links of classes; every step is a shuffle
    of links, cut by a checkpoint, and the loop ends when nothing changes.
    """
    sets = checkpointed(text_sets(notes.where(~js_blank(F.col("content"))), "id", note_text()))
    links = checkpointed(class_links(sets, least).select("a", "b"))
    labels = components(links)
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").count()
    return (
        sets.select("id", "class_key").distinct()
        .join(labels.withColumnRenamed("node", "class_key"), "class_key", "left")
        .join(degree.select(F.col("a").alias("class_key"), F.col("count").alias("links")), "class_key", "left")
        .select("id", "class_key", F.coalesce("label", "class_key").alias("group_key"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest key of each node's component; the loop ends when nothing changes."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = checkpointed(small)
        if not edges.exceptAll(small).head(1) and not small.exceptAll(edges).head(1):
            break
        edges = small
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))
