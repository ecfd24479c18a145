"""Near-duplicates in a batch and against a corpus, by keywords, weights and fingerprints.

Candidates come from equi-joins only. For batch pairs the score can pass the threshold only if enough of the top tokens agree, so two
texts must share one of the rarest of them (prefix filter); short texts, which are compared by edits, are joined by pieces. For the
corpus, fingerprints within two bits agree in one of three bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import edits
from ..functions.hashing import simhash
from ..functions.similarity import edit_similarity, hamming, jaccard
from ..functions.text import utf16_length
from ..functions.tokens import tokens
from ..sources.state import checkpointed
from . import vectors

LENGTH_RATIO, SHORT, TINY, BOOST = 0.3, 100, 30, 1.15
#: Bits in which fingerprints may differ, plus one.
DISTANCE = 3
BANDS = ((0, 22), (22, 21), (43, 21))


def _length_ok(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= LENGTH_RATIO * F.greatest(a, b)


def _prefix(threshold: float, size: Column, rest: float = 0.5) -> Column:
    """Number of rarest top tokens of which two texts above the threshold share one; ``rest`` is what everything else can give at most."""
    least = max(0.0, (threshold - rest) / 0.3)
    return F.greatest(F.lit(1), size - F.floor(size * least).cast("int"))


#: Rows of a group that are weighed together.
_WEIGHED = 4_096


def _frequencies(rows: DataFrame, key: str, text: str, group: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows with docs, avg_len and the part of their group, frequencies of the tokens of each part in the whole group): (group, _part, token, df)."""
    sizes = checkpointed(vectors.corpus_size(rows, key, text, group))
    part = F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(F.col("docs") / _WEIGHED))).cast("int")
    rows = (rows.join(sizes, list(group)) if group else rows.crossJoin(F.broadcast(sizes))).withColumn("_part", part)
    found = vectors.counts(rows, key, text, (*group, "_part")).groupBy(*group, "_part", "token").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*group, "token")
    return rows, checkpointed(found.select(*group, "_part", "token", F.sum("n").over(whole).alias("df")))


def _top_tokens(rows: DataFrame, frequencies: DataFrame, key: str, text: str, group: tuple[str, ...], k: int = 5) -> DataFrame:
    """(group, key, top_tokens, top_df): a part of a group meets the frequencies of its own tokens, so no weight is written anywhere."""
    by = [*group, "_part"]
    kinds = dict(rows.dtypes)
    texts = rows.select(*by, key, F.col("docs"), F.col("avg_len"), utf16_length(F.col(text)).alias("len"), F.col(text).alias("_t")).repartition(*by)
    cut = texts.select(*by, key, "docs", "avg_len", "len", tokens(F.col("_t")).alias("tokens"))
    names = [*group, key, "top_tokens", "top_df"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.column("tokens").combine_chunks()
        known = right.column("token").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        code = pa.compute.index_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        cell, first, cnt = np.unique(row * max(1, len(known)) + code, return_index=True, return_counts=True)
        row, code = np.divmod(cell, max(1, len(known)))
        df = right.column("df").to_numpy()[code]
        docs, avg, length = (left.column(c).to_numpy()[row] for c in ("docs", "avg_len", "len"))
        relative = np.where(avg > 0, 1 - vectors.B + vectors.B * length / np.where(avg > 0, avg, 1), 1.0)
        w = cnt / (cnt + vectors.K1 * relative) * (np.log((np.maximum(docs, 1) + 1) / (df + 1)) + 1)
        order = np.lexsort((first, -np.round(w, 12), row))
        row, code, df = row[order], code[order], df[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        held = np.bincount(row[kept], minlength=len(size))
        ends = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
        return pa.table([*(left.column(c) for c in (*group, key)), pa.ListArray.from_arrays(ends, known.take(pa.array(code[kept]))), pa.ListArray.from_arrays(ends, pa.array(df[kept].astype(np.int64)))], names=names)

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*group, key)), "top_tokens array<string>", "top_df array<bigint>"])
    return cut.groupBy(*by).cogroup(frequencies.groupBy(*by)).applyInArrow(best, schema).where(F.size("top_tokens") > 0)


def batch_candidates(rows: DataFrame, key: str, text: str, order: str, group: tuple[str, ...] = (), threshold: float = 0.65, title: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (group, later, earlier) that may reach the threshold, rows with their top tokens, weights of the rows that stand in a pair)

    Pairs are judged where they meet, from fingerprints of their top tokens and titles or, if short, from their texts; only those that pass move
    on. Weights are computed anew for their rows, so that the weights of all texts are never written.
    """
    kept, frequencies = _frequencies(rows.where(F.col(text).isNotNull()), key, text, group)
    named = F.array_distinct(tokens(F.coalesce(F.col(title), F.lit("")))) if title else F.array().cast("array<string>")
    base = kept.select(*group, key, F.col(order).alias("_o"), F.col(text).alias("_t"), utf16_length(F.col(text)).alias("_len"), named.alias("title_tokens"))
    full = base.join(_top_tokens(kept, frequencies, key, text, group), [*group, key], "left").withColumn("top_tokens", F.coalesce("top_tokens", F.array().cast("array<string>")))
    rare = F.transform(F.array_sort(F.arrays_zip("top_df", "top_tokens")), lambda x: x["top_tokens"])
    size = F.size("top_tokens")
    keys = F.when(F.col("_len") < SHORT, F.col("top_tokens")).otherwise(F.slice(rare, F.lit(1), _prefix(threshold, size, 0.7 if title else 0.5)))
    # of the texts only those of short rows are needed from here on
    full = full.withColumn("_keys", F.when(size > 0, keys).otherwise(F.array().cast("array<string>"))).withColumn("_t", F.when(F.col("_len") < SHORT, F.col("_t")))
    full = checkpointed(full.select(*group, key, *([] if order == key else ["_o"]), "_len", "_t", "title_tokens", "top_tokens", "_keys"))
    prints = lambda c: F.transform(c, lambda x: F.hash(x))
    short = F.col("_t").alias("_s")
    own = [] if order == key else ["_o"]  # written once
    spread = full.select(*group, key, *own, "_len", short, prints("top_tokens").alias("_tops"), prints("title_tokens").alias("_names"), F.explode(prints("_keys")).alias("_k"))
    likely = 0.5 + 0.3 * jaccard(F.col("l_tops"), F.col("e_tops")) + (0.2 * jaccard(F.col("l_names"), F.col("e_names")) if title else 0.0) > threshold - 1e-9
    close = F.levenshtein(F.col("l_s"), F.col("e_s"), int(0.3 * SHORT)) >= 0
    both_short = F.col("l_s").isNotNull() & F.col("e_s").isNotNull()

    def met(rows: DataFrame, good: Column) -> DataFrame:
        columns = [c for c in ("_len", *own, "_s", "_tops", "_names") if c in rows.columns]
        a, b = (rows.select(*group, "_k", F.col(key).alias(name), *[F.col(c).alias(f"{x}{c}") for c in columns]) for x, name in (("l", "later"), ("e", "earlier")))
        ordered = F.col("e_o") < F.col("l_o") if own else F.col("earlier") < F.col("later")
        return a.join(b, [*group, "_k"]).where(ordered & _length_ok(F.col("l_len"), F.col("e_len")) & good).select(*group, "later", "earlier")

    # tiny texts need no common token: alike by edits, they share a piece of two characters
    tiny = full.where(F.col("_len") <= int(TINY / (1 - LENGTH_RATIO)))
    at = F.sequence(F.lit(1), F.greatest(F.col("_len") - 1, F.lit(1)))
    grams = tiny.select(*group, key, *own, "_len", F.col("_t").alias("_s"), F.explode(F.array_distinct(F.transform(at, lambda i: F.col("_t").substr(i, F.lit(2))))).alias("_k"))
    pairs = checkpointed(met(spread, F.when(both_short, close).otherwise(likely)).unionByName(met(grams, close)).distinct())
    standing = pairs.select(*group, F.col("later").alias(key)).unionByName(pairs.select(*group, F.col("earlier").alias(key))).distinct()
    few = kept.join(standing, [*group, key], "left_semi")
    # a part holds the frequencies of all of its rows' tokens
    on = [*group, "_part", "token"]
    sized = few.select(*group, key, "docs", "avg_len")
    weighed = vectors.counts(few, key, text, (*group, "_part")).join(frequencies, on).join(sized, [*group, key])
    idf = F.log((F.greatest("docs", F.lit(1)) + 1) / (F.col("df") + 1)) + 1
    return pairs, full, checkpointed(weighed.select(*group, key, "token", vectors.weight(F.col("cnt"), F.col("len"), F.col("avg_len"), idf).alias("w")))


def batch_pairs(rows: DataFrame, key: str, text: str, order: str, group: tuple[str, ...] = (), threshold: float = 0.65, title: str | None = None) -> DataFrame:
    """(group, later, earlier, similarity): pairs above the threshold; ``order`` decides which comes first.

    Scores are half the cosine and three tenths of the top-token overlap; where both texts have fewer than a hundred characters, one
    less the relative edit distance. Null texts are left out; keys must be unique in their group. Titles take no part, as in the results
    to be matched; with ``title``, the overlap of their tokens counts two tenths, as was meant there.
    """
    pairs, full, long = batch_candidates(rows, key, text, order, group, threshold, title)
    lengths = vectors.norms(long, key, group)
    side = lambda name: full.join(lengths, [*group, key], "left").select(*group, F.col(key).alias(name), *[F.col(c).alias(f"{name}_{c.strip('_')}") for c in ("_t", "_len", "top_tokens", "norm", "n_tokens", "title_tokens")])
    both = pairs.join(side("later"), [*group, "later"]).join(side("earlier"), [*group, "earlier"])
    c = lambda name: F.col(f"later_{name}")
    d = lambda name: F.col(f"earlier_{name}")
    likely = both.withColumn("_overlap", jaccard(c("top_tokens"), d("top_tokens"))).where((F.col("_overlap") > 0) | (F.least(c("len"), d("len")) <= TINY))
    short = (c("len") < SHORT) & (d("len") < SHORT)
    edits = edit_similarity(c("t"), d("t"))
    scored = checkpointed(likely.select(*group, "later", "earlier", "_overlap", jaccard(c("title_tokens"), d("title_tokens")).alias("_title"), short.alias("_short"), F.when(short, F.when(edits >= 0.7, edits)).alias("_edits"), *[f"{x}_{y}" for x in ("later", "earlier") for y in ("norm", "n_tokens")]))
    # half the cosine is at most one half: the rest has to come from the top tokens and titles
    close = scored.where(~F.col("_short") & (0.5 + 0.3 * F.col("_overlap") + 0.2 * F.col("_title") > threshold))
    close = close.join(vectors.dots(close, long, long, key, "later", "earlier", group), [*group, "later", "earlier"], "left")
    cosine = vectors.sparse_cosine(F.col("dot"), c("norm"), d("norm"), c("n_tokens"), d("n_tokens"))
    found = close.select(*group, "later", "earlier", (0.5 * cosine + 0.3 * F.col("_overlap") + 0.2 * F.col("_title")).alias("similarity"))
    found = found.unionByName(scored.where("_short").select(*group, "later", "earlier", F.col("_edits").alias("similarity")))
    return found.where(F.col("similarity") > threshold)


def greedy_kept(pairs: DataFrame, group: tuple[str, ...] = (), order: DataFrame | None = None) -> DataFrame:
    """(group, later, earlier): each dropped row with the first kept row that it repeats.

    Sequentially, a row is dropped if it repeats an earlier kept row. In rounds: rows without undecided earlier neighbours are kept
    unless a kept one stands before them, so each round settles at least the first undecided row of every chain; the loop ends when
    none is left, after as many rounds as the longest chain has rows. ``pairs`` must order rows by their keys; an order that runs in
    a circle settles nothing and raises an error.
    """
    edges = checkpointed(pairs.select(*group, "later", "earlier"))
    nodes = edges.select(*group, F.col("later").alias("node")).unionByName(edges.select(*group, F.col("earlier").alias("node"))).distinct()
    state = nodes.withColumn("kept", F.lit(None).cast("boolean"))
    left = None
    while left != 0:
        before = edges.join(state.select(*group, F.col("node").alias("earlier"), F.col("kept").alias("k")), [*group, "earlier"])
        found = before.groupBy(*group, F.col("later").alias("node")).agg(F.max(F.coalesce("k", F.lit(False))).alias("any_kept"), F.max(F.col("k").isNull()).alias("open"))
        state = checkpointed(
            state.join(found, [*group, "node"], "left").select(*group, "node", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("any_kept", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True).alias("kept"))
        )
        last, left = left, state.where("kept is null").count()
        if left and left == last:
            raise ValueError("rows repeat each other in a circle: pairs must be ordered")
    dropped = state.where("not kept").select(*group, F.col("node").alias("later"))
    kept = state.where("kept").select(*group, F.col("node").alias("earlier"))
    return edges.join(dropped, [*group, "later"]).join(kept, [*group, "earlier"]).groupBy(*group, "later").agg(F.min("earlier").alias("earlier"))


def edit_pairs(rows: DataFrame, text: str, least: float) -> DataFrame:
    """(a, b, similarity): pairs a < b of different texts whose edit similarity is at least ``least``, which must be above 0.5; no pair is lost.

    Texts lie in blocks of like length, and only blocks whose lengths fit meet, each two in a cell of their own. There bitmaps of characters
    and of their neighbours bound every pair, and the distances of those that pass are computed many at a time (``functions/edits.py``).
    What moves is texts x the blocks that one meets, of which there are at most some tens.
    """
    if 2 * least - 1 <= 0:
        raise ValueError("edit similarities up to 0.5 leave no pair of characters in common")
    source = checkpointed(rows.select(F.col(text).alias("t")).where(F.length("t") > 0).distinct().withColumn("n", F.length("t")))
    spark = source.sparkSession
    lengths = sorted((r.n, r["count"]) for r in source.groupBy("n").count().collect())
    size = max(CELL, -(-sum(c for _, c in lengths) // BLOCKS))
    # blocks: (shortest, longest) of each, where a length stands, and in how many pieces
    blocks: list[tuple[int, int]] = []
    places: list[tuple[int, int, int]] = []
    held = size
    for n, count in lengths:
        pieces = -(-count // size)
        if pieces == 1 and held + count <= size:
            blocks[-1] = (blocks[-1][0], n)
            held += count
        else:
            blocks += [(n, n)] * pieces
            held = count if pieces == 1 else size
        places.append((n, len(blocks) - pieces, pieces))
    cells = [(i, j) for j in range(len(blocks)) for i in range(j + 1) if blocks[i][1] >= least * blocks[j][0] - 1e-9]
    meets = [(x, c, x == j) for c, (i, j) in enumerate(cells) for x in {i, j}]
    placed = source.join(F.broadcast(spark.createDataFrame(places, "n int, first int, pieces int")), "n").select("t", (F.col("first") + F.pmod(F.xxhash64("t"), F.col("pieces"))).cast("int").alias("block"))
    keyed = placed.join(F.broadcast(spark.createDataFrame(meets, "block int, cell int, second boolean")), "block").select("cell", "second", "t")
    inside = [i == j for i, j in cells]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in edits.grouped(batches, 1):
            texts, second = table.column("t").combine_chunks(), table.column("second").combine_chunks()
            same = inside[table.column("cell")[0].as_py()]
            b = edits.Texts(texts.filter(second))
            a = b if same else edits.Texts(texts.filter(pa.compute.invert(second)))
            for i, j, distance in edits.close_pairs(a, b, least, same):
                yield _pair_rows(a.texts.take(pa.array(i)), b.texts.take(pa.array(j)), distance, np.maximum(a.size[i], b.size[j]))

    found = keyed.repartition(_parts(spark, len(cells)), "cell").sortWithinPartitions("cell").mapInArrow(compare, "a string, b string, similarity double")
    return found.withColumn("similarity", F.coalesce("similarity", edit_similarity(F.col("a"), F.col("b")))).where(F.col("similarity") >= least - 1e-9)


#: Texts of a block at least, and how many blocks there are at most, besides those of a single length.
CELL, BLOCKS = 2_048, 32
#: Rows that a comparison gives out at once, and texts of a group that is compared together with others.
_ROWS, _FEW = 100_000, 128


def _parts(spark: SparkSession, cells: int) -> int:
    """Tasks for so many cells: each cell can be a long one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2_000, cells))


def _pair_rows(x: pa.Array, y: pa.Array, distance: np.ndarray, longest: np.ndarray) -> pa.RecordBatch:
    """Pairs with the smaller text first."""
    swap = pa.compute.greater(x, y)
    return pa.RecordBatch.from_arrays([pa.compute.if_else(swap, y, x), pa.compute.if_else(swap, x, y), edits.similarities(distance, longest)], names=["a", "b", "similarity"])


def group_edits(rows: DataFrame, group: str, text: str, digits: int = 9) -> DataFrame:
    """(a, b, similarity): all pairs a < b of different texts of a group with their edit similarity, rounded.

    Every pair is a row of the result, so work grows with the square of a group. Groups are cut into blocks of bounded size, and each two
    blocks are a cell, so that a large group is many tasks' work, while small groups are taken together; distances are computed many at a time (``functions/edits.py``).
    """
    source = checkpointed(rows.select(F.col(group).alias("g"), F.col(text).alias("t")).where("g is not null and t is not null").distinct())
    spark = source.sparkSession
    sizes = source.groupBy("g").count().where("count > 1")
    pairs = sizes.agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0] or 0
    pieces = F.ceil(F.col("count") / CELL).cast("int")
    sized = source.join(sizes, "g")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths().to_numpy()
            texts, start = lists.flatten(), np.concatenate([[0], np.cumsum(size)])
            run = np.cumsum(size * (size - 1) // 2) // _ROWS
            for r in np.unique(run):
                first, last = np.searchsorted(run, r), np.searchsorted(run, r, side="right")
                part = edits.Texts(texts.slice(start[first], start[last] - start[first]))
                # every text with those before it in its group
                before = np.arange(len(part)) - np.repeat(start[first:last] - start[first], size[first:last])
                x = np.repeat(np.arange(len(part)), before)
                y = np.arange(len(x)) - np.repeat(np.cumsum(before) - before, before) + np.repeat(np.arange(len(part)) - before, before)
                yield rounded(part.texts.take(pa.array(x)), part.texts.take(pa.array(y)), edits.Pairs(part, part).distances(x, y), np.maximum(part.size[x], part.size[y]))

    def rounded(x: pa.Array, y: pa.Array, distance: np.ndarray, longest: np.ndarray) -> pa.RecordBatch:
        out = _pair_rows(x, y, distance, longest)
        return out.set_column(2, "similarity", pa.compute.round(out.column(2), digits))

    schema = "a string, b string, similarity double"
    small = sized.where(F.col("count") <= _FEW).groupBy("g").agg(F.collect_list("t").alias("t")).select("t").mapInArrow(within, schema)
    cut = sized.where(F.col("count") > _FEW).select("g", "t", pieces.alias("pieces"), F.pmod(F.xxhash64("t"), pieces).cast("int").alias("block"))
    cut = cut.select("g", "t", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    keyed = cut.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in edits.grouped(batches, 3):
            i, j = (table.column(k)[0].as_py() for k in "ij")
            texts, block = table.column("t").combine_chunks(), table.column("block").combine_chunks()
            texts, block = texts.take(order := pa.compute.sort_indices(texts)), block.take(order).to_numpy()
            b = edits.Texts(texts.filter(pa.array(block == j)))
            a = b if i == j else edits.Texts(texts.filter(pa.array(block == i)))
            held_a, held_b, held = [], [], []
            waiting = 0
            for k, distance in edits.all_distances(a, b):
                mine = np.arange(k if i == j else len(a))  # within a block, each pair once
                held_a.append(mine)
                held_b.append(np.full(len(mine), k))
                held.append(distance[: len(mine)])
                waiting += len(mine)
                if waiting >= _ROWS or k == len(b) - 1 and waiting:
                    x, y, distance = (np.concatenate(h) for h in (held_a, held_b, held))
                    held_a, held_b, held, waiting = [], [], [], 0
                    yield rounded(a.texts.take(pa.array(x)), b.texts.take(pa.array(y)), distance, np.maximum(a.size[x], b.size[y]))

    found = keyed.repartition(_parts(spark, int(pairs / CELL**2)), "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(compare, schema).unionByName(small)
    return found.withColumn("similarity", F.when(F.col("similarity").isNull(), F.round(edit_similarity(F.col("a"), F.col("b")), digits)).otherwise(F.col("similarity")))


def fingerprints(rows: DataFrame, key: str, text: str, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, key, simhash) over the weights of a corpus against itself."""
    return vectors.ordered_weights(vectors.vectors(rows, key, text, group), key, group).select(*group, key, simhash("tokens", "weights").alias("simhash"))


def voted(long: DataFrame) -> DataFrame:
    """(key, simhash) of long rows (key, token, w) with whole votes, for which order does not matter."""
    packed = F.sort_array(F.collect_list(F.struct("token", "w")))
    found = long.groupBy("key").agg(packed.alias("_v"))
    return found.select("key", simhash(F.transform("_v", lambda x: x["token"]), F.transform("_v", lambda x: x["w"])).alias("simhash"))


def fingerprint_pairs(left: DataFrame, right: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b, distance): keys of (key, simhash) rows whose fingerprints differ in fewer than ``distance`` (at most 3) bits.

    Rows are joined by equal bands of the bits; equal fingerprints of one side collapse first, so a fat fingerprint is matched once.
    """

    def bands(rows: DataFrame, name: str) -> DataFrame:
        value = F.col("simhash")
        band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(value, at).bitwiseAND((1 << width) - 1).alias("bits")) for i, (at, width) in enumerate(BANDS)]))
        return rows.select("simhash").distinct().select(F.col("simhash").alias(name), band.alias("x")).select(name, "x.band", "x.bits")

    near = bands(left, "sa").join(bands(right, "sb"), ["band", "bits"]).where(hamming(F.col("sa"), F.col("sb")) < distance).select("sa", "sb").distinct()
    found = near.join(left.select(F.col("key").alias("a"), F.col("simhash").alias("sa")), "sa").join(right.select(F.col("key").alias("b"), F.col("simhash").alias("sb")), "sb")
    return found.select("a", "b", hamming(F.col("sa"), F.col("sb")).alias("distance"))


def combined_score(content: Column, overlap: Column, title: Column) -> Column:
    """Content, top tokens and, where both sides have a title to compare, the title."""
    return F.when(title.isNotNull(), 0.5 * content + 0.3 * overlap + 0.2 * title).otherwise(0.6 * content + 0.4 * overlap)


def best_match(pairs: DataFrame, keys: DataFrame, key: str, other: str, score: str, length: str | None = None) -> DataFrame:
    """Every key with its best partner, or none: the highest score, the smaller partner among equals; short texts are boosted after the choice."""
    top = pairs.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(other).alias("o"))).alias("_best"))
    found = keys.join(top, key, "left").select(*keys.columns, F.col("_best.o").alias(other), (-F.col("_best.s")).alias(score))
    if length:
        found = found.withColumn(score, F.when(F.col(score).isNotNull() & (F.col(length) < SHORT), F.least(F.col(score) * BOOST, F.lit(1.0))).otherwise(F.col(score)))
    return found


def merged_matches(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Lexical and semantic best matches (key, other, score): the semantic one replaces the other only if strictly better; a missing score is 0."""
    a = lexical.select(key, F.col("other").alias("lo"), F.coalesce("score", F.lit(0.0)).alias("local_similarity"))
    b = semantic.select(key, F.col("other").alias("so"), F.coalesce("score", F.lit(0.0)).alias("semantic_similarity"))
    both = a.join(b, key, "full").na.fill(0.0, ["local_similarity", "semantic_similarity"])
    better = F.col("semantic_similarity") > F.col("local_similarity")
    return both.select(key, F.when(better, F.col("so")).otherwise(F.col("lo")).alias("other"), F.greatest("local_similarity", "semantic_similarity").alias("similarity"), "local_similarity", "semantic_similarity")


def band_of(similarity: Column, high: Column | float, mid: Column | float) -> Column:
    """pending_high, pending or keep; nothing is dropped."""
    high, mid = (F.lit(x) if isinstance(x, float) else x for x in (high, mid))
    return F.when(similarity >= high, "pending_high").when(similarity >= mid, "pending").otherwise("keep")


def corpus_matches(fresh: DataFrame, corpus: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, other, score): each new row's best partner in the corpus, by fingerprints, length, top tokens and cosine.

    Corpus weights use the corpus' mean length, new ones the mean over both; tokens that the corpus lacks weigh as if in no document. With
    ``title``, titles count where both have enough tokens. Keys must be unique on each side.
    """
    sizes = vectors.corpus_size(corpus, key, text)
    known = vectors.counts(corpus, key, text)
    table = vectors.idf(known, sizes)
    own = known.where("token is not null").join(table, "token").crossJoin(F.broadcast(sizes)).select(key, "len", "token", "cnt", "pos", "df", vectors.weight(F.col("cnt"), F.col("len"), F.col("avg_len"), F.col("idf")).alias("w"))
    new_size = vectors.corpus_size(fresh, key, text).select(F.col("docs").alias("d2"), F.col("avg_len").alias("a2"))
    mean = sizes.crossJoin(new_size).select("docs", ((F.col("docs") * F.col("avg_len") + F.col("d2") * F.col("a2")) / F.greatest(F.col("docs") + F.col("d2"), F.lit(1))).alias("avg_len"))
    seen = vectors.counts(fresh, key, text).where("token is not null").join(table, "token", "left").crossJoin(F.broadcast(mean))
    new = seen.select(key, "len", "token", "cnt", "pos", F.coalesce("df", F.lit(0)).alias("df"), vectors.weight(F.col("cnt"), F.col("len"), F.col("avg_len"), F.coalesce("idf", F.log(F.col("docs") + 1) + 1)).alias("w"))
    sides = []
    new, own = checkpointed(new), checkpointed(own)
    for long in (new, own):
        prints = vectors.ordered_weights(long, key).select(F.col(key).alias("key"), simhash("tokens", "weights").alias("simhash"))
        sides.append((checkpointed(prints), vectors.summary(long, key)))
    (fp_new, sum_new), (fp_own, sum_own) = sides
    near = fingerprint_pairs(fp_new, fp_own)
    near = checkpointed(near)
    product = vectors.dots(near, new, own, key, "a", "b")
    columns = ("n_tokens", "norm", "top_tokens")
    length = utf16_length(F.coalesce(F.col(text), F.lit("")))
    left, right = (d.join(s, key, "left").select(F.col(key).alias(k), F.col("_len").alias(f"{k}_len"), *[F.col(c).alias(f"{k}_{c}") for c in columns]) for d, s, k in ((fresh.select(key, length.alias("_len")), sum_new, "a"), (corpus.select(key, length.alias("_len")), sum_own, "b")))
    both = near.join(left, "a").join(right, "b").where(_length_ok(F.col("a_len"), F.col("b_len")))
    both = both.withColumn("overlap", jaccard(F.col("a_top_tokens"), F.col("b_top_tokens"))).where((F.col("overlap") > 0) | (F.least("a_len", "b_len") <= TINY)).join(product, ["a", "b"], "left")
    content = vectors.sparse_cosine(F.col("dot"), F.col("a_norm"), F.col("b_norm"), F.col("a_n_tokens"), F.col("b_n_tokens"))
    named = F.lit(None).cast("double")
    if title:
        both = both.join(title_cosines(near, fresh, corpus, key, title), ["a", "b"], "left")
        named = F.col("title_cosine")
    scored = both.select(F.col("a").alias(key), F.col("b").alias("other"), combined_score(content, F.col("overlap"), named).alias("score"))
    return best_match(scored, fresh.select(key, length.alias("len")), key, "other", "score", "len")


def title_cosines(pairs: DataFrame, fresh: DataFrame, corpus: DataFrame, key: str, title: str) -> DataFrame:
    """(a, b, title_cosine) of pairs whose titles both have enough distinct tokens; titles weigh as texts of the corpus' titles."""
    sizes = vectors.corpus_size(corpus.where(F.col(title).isNotNull()), key, title)
    known = vectors.counts(corpus, key, title)
    table = vectors.idf(known, sizes)
    weigh = lambda found: found.join(table, "token", "left").crossJoin(F.broadcast(sizes)).select(key, "token", vectors.weight(F.col("cnt"), F.col("len"), F.col("avg_len"), F.coalesce("idf", F.log(F.greatest("docs", F.lit(1)) + 1) + 1)).alias("w"))
    left, right = (checkpointed(weigh(found)) for found in (vectors.counts(fresh, key, title), known))
    a, b = (vectors.norms(long, key).select(F.col(key).alias(k), F.col("norm").alias(f"n{k}"), F.col("n_tokens").alias(f"t{k}")) for long, k in ((left, "a"), (right, "b")))
    long_enough = pairs.select("a", "b").join(a, "a").join(b, "b").where((F.col("ta") >= vectors.LEAST_TOKENS) & (F.col("tb") >= vectors.LEAST_TOKENS))
    return long_enough.join(vectors.dots(long_enough, left, right, key, "a", "b"), ["a", "b"], "left").select("a", "b", vectors.sparse_cosine(F.col("dot"), F.col("na"), F.col("nb"), F.col("ta"), F.col("tb")).alias("title_cosine"))
