"""Related notes: sparse Jaccard over keywords, search by a query text, and re-ranking for diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import keyword_set
from ..sources.state import checkpointed
from .vectors import first_rows


def keyword_jaccard(queries: DataFrame, index: DataFrame, key: str, keywords: str, least: float = 0.0) -> DataFrame:
    """(query, other, similarity) of rows that share a keyword; only such pairs are computed.

    An inverted index: exploded keywords joined on the keyword, shared ones counted with partial sums before the shuffle.
    """
    a = queries.select(F.col(key).alias("query"), F.size(F.array_distinct(keywords)).alias("na"), F.explode(F.array_distinct(keywords)).alias("k"))
    b = index.select(F.col(key).alias("other"), F.size(F.array_distinct(keywords)).alias("nb"), F.explode(F.array_distinct(keywords)).alias("k"))
    shared = a.join(b, "k").where("query <> other").groupBy("query", "other").agg(F.count("*").alias("n"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    found = shared.select("query", "other", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("similarity"))
    return found.where(F.col("similarity") >= least) if least > 0 else found


#: Keywords of queries that are sent to the workers at once, and cells of a batch's table of queries by rows.
BLOCK_WORDS, CELLS = 4_000_000, 4_000_000


def keyword_search(queries: DataFrame, index: DataFrame, key: str, keywords: str, least: float, top: int) -> DataFrame:
    """(query, other, similarity): the ``top`` rows most alike to each query, of at least ``least`` (above 0).

    The stated query set goes to the workers as an inverted index, in blocks of a bounded number of keywords; the index is read once a
    block and stays where it is. Every task keeps ``top`` rows a query, and these are reduced, so what moves is queries x tasks x ``top``.
    """
    kinds = dict(index.dtypes)
    filled = lambda rows: rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.array_distinct(F.coalesce(keywords, F.array().cast("array<string>"))).alias("words")).where(F.size("words") > 0)
    asked, rows = filled(queries), filled(index)
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    found = None
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block)).toArrow()
        lists = part.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        size = lists.value_lengths().to_numpy()
        codes, order = np.sort(coded.indices.to_numpy()), np.argsort(coded.indices.to_numpy(), kind="stable")
        # postings: the queries of each word, one word after the other
        postings = np.repeat(np.arange(len(size)), size)[order].astype(np.int32)
        starts = np.searchsorted(codes, np.arange(len(coded.dictionary) + 1))
        sent = index.sparkSession.sparkContext.broadcast((part.column("k").combine_chunks(), size, coded.dictionary, postings, starts))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, sizes, words, postings, starts = sent.value
            n = len(names)
            if not n:
                return
            step = max(1, CELLS // n)
            query, close, other = np.empty(0, np.int64), np.empty(0), None
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    order = pa.compute.sort_indices(batch.column(0))  # ties go to the smaller key
                    others, lists = batch.column(0).take(order), batch.column(1).take(order)
                    own = lists.value_lengths().to_numpy()
                    word = pa.compute.fill_null(pa.compute.index_in(lists.flatten(), value_set=words), -1).to_numpy()
                    row = np.repeat(np.arange(len(own)), own)[word >= 0]
                    word = word[word >= 0]
                    times = starts[word + 1] - starts[word]
                    ends = np.cumsum(times)
                    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(starts[word], times)
                    shared = np.bincount(postings[place].astype(np.int64) * len(own) + np.repeat(row, times), minlength=n * len(own)).reshape(n, len(own))
                    score = shared / (sizes[:, None] + own[None, :] - shared)
                    score[score < least] = 0
                    # no row is its own partner
                    mine = pa.compute.fill_null(pa.compute.index_in(names, value_set=others), -1).to_numpy()
                    score[np.flatnonzero(mine >= 0), mine[mine >= 0]] = 0
                    q, c = np.nonzero(score > 0)
                    new = others.take(pa.array(c))
                    query, close = np.concatenate([query, q]), np.concatenate([close, score[q, c]])
                    other = new if other is None else pa.concat_arrays([other, new])
                    # the first ``top`` of each query
                    order = np.lexsort((pa.compute.rank(other).to_numpy(), -close, query))
                    query, close = query[order], close[order]
                    first = np.searchsorted(query, query)
                    keep = np.arange(len(query)) - first < top
                    query, close, other = query[keep], close[keep], other.take(pa.array(order[keep]))
            if len(query):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), other, pa.array(close)], names=["query", "other", "similarity"])

        near = rows.mapInArrow(best, f"query {kinds[key]}, other {kinds[key]}, similarity double")
        found = near if found is None else found.unionByName(near)
    return first_rows(found, ["query"], [F.col("similarity").desc(), F.col("other")], top)


def related(queries: DataFrame, index: DataFrame, key: str, text: str, least: float = 0.08, top: int = 5) -> DataFrame:
    """(query, other, similarity): for each query text the rows most alike by 2-gram keywords; texts without keywords find nothing."""
    a, b = (rows.select(key, keyword_set(F.col(text)).alias("keywords")) for rows in (queries, index))
    return keyword_search(a, b, key, "keywords", least, top)


def diverse(candidates: DataFrame, keywords: DataFrame, key: str, top: int = 10, relevance: float = 0.6, threshold: float = 0.0) -> DataFrame:
    """(query, rank, other, similarity): repeatedly the candidate with the best mix of relevance and distance to those already taken.

    ``candidates`` are (query, other, similarity) with at most some hundreds per query (the search's own limit), so a query's group is
    bounded; ``keywords`` are (key, keywords). The first of equals, by key, wins; the threshold is applied after the choice.
    """
    rows = candidates.join(keywords.select(F.col(key).alias("other"), "keywords"), "other")
    kind = dict(candidates.dtypes)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("other").reset_index(drop=True)
        sets = [set(k) for k in group["keywords"]]
        penalty = [0.0] * len(group)
        left, taken = list(range(len(group))), []
        while left and len(taken) < top:
            best = max(left, key=lambda k: (relevance * group["similarity"][k] - (1 - relevance) * penalty[k], -k))
            left.remove(best)
            taken.append(best)
            for k in left:
                union = len(sets[k] | sets[best])
                penalty[k] = max(penalty[k], len(sets[k] & sets[best]) / union if union else 0.0)
        out = group.loc[taken, ["query", "other", "similarity"]].copy()
        out.insert(1, "rank", range(1, len(out) + 1))
        return out[out["similarity"] >= threshold]

    return rows.groupBy("query").applyInPandas(choose, f"query {kind['query']}, rank int, other {kind['other']}, similarity double")


#: Keywords of queries and choices that are sent at once, and similarities of a choice to a batch that are kept.
DIVERSE_WORDS, DIVERSE_KEPT = 8_000_000, 256


def diverse_of_all(queries: DataFrame, index: DataFrame, key: str, keywords: str, top: int = 10, relevance: float = 0.6, threshold: float = 0.0) -> DataFrame:
    """(query, rank, other, similarity) as ``diverse``, where every other row of the index competes, those without a shared keyword included.

    ``queries`` is a stated set, whose keywords and choices are sent to all workers as 64-bit numbers, in blocks of a bounded number of them;
    the index stays where it is. In each of ``top`` passes every batch gives its best row of each query, and the best of these is taken.
    """
    kind = dict(index.dtypes)[key]
    spark = index.sparkSession
    numbers = F.transform(F.array_distinct(F.coalesce(F.col(keywords), F.array().cast("array<string>"))), lambda w: F.xxhash64(w))
    rows = checkpointed(index.where(F.col(key).isNotNull()).select(F.col(key).alias("other"), numbers.alias("keywords")).dropDuplicates(["other"]))
    stated = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), numbers.alias("words")).dropDuplicates(["k"]).toArrow()
    names, lists = stated.column("k").to_pylist(), stated.column("words").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    # choices may be larger than queries: a block has room for either
    block = np.maximum.accumulate(ends[:-1] * (top + 1) // DIVERSE_WORDS) if len(names) else np.zeros(0, int)
    ranked: list[tuple] = []
    for number in np.unique(block):
        mine = np.flatnonzero(block == number)
        asked = {names[i]: flat[ends[i] : ends[i + 1]] for i in mine}
        taken: dict = {q: [] for q in asked}
        chosen: dict = {}
        for _ in range(top):
            sent = spark.sparkContext.broadcast((asked, {q: [k for k, _ in t] for q, t in taken.items()}, chosen))

            def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                asked, taken, chosen = sent.value
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    others, lists = batch.column(0), batch.column(1)
                    # ties go to the smaller key
                    order = pa.compute.sort_indices(others)
                    others, lists = others.take(order), lists.take(order)
                    place = {k: i for i, k in enumerate(others.to_pylist())}
                    sizes = lists.value_lengths().to_numpy()
                    words = lists.flatten().to_numpy()
                    by_word = np.argsort(words, kind="stable")
                    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_word]
                    known, starts = np.unique(words[by_word], return_index=True)
                    starts = np.append(starts, len(words))

                    def similarity(words: np.ndarray) -> np.ndarray:
                        at = np.searchsorted(known, words)
                        at = at[known[np.minimum(at, len(known) - 1)] == words] if len(known) else at[:0]
                        shared = np.bincount(np.concatenate([rows[starts[c] : starts[c + 1]] for c in at]), minlength=len(sizes)) if len(at) else np.zeros(len(sizes))
                        return shared / np.maximum(1, sizes + len(words) - shared)

                    kept: dict = {}
                    out = []
                    for q, words in asked.items():
                        close = similarity(words)
                        penalty = np.zeros(len(sizes))
                        for k in taken[q]:
                            if k not in kept:
                                if len(kept) >= DIVERSE_KEPT:
                                    del kept[next(iter(kept))]
                                kept[k] = similarity(chosen[k])
                            penalty = np.maximum(penalty, kept[k])
                        score = relevance * close - (1 - relevance) * penalty
                        for k in (q, *taken[q]):
                            if k in place:
                                score[place[k]] = -np.inf
                        at = int(np.argmax(score))
                        if score[at] > -np.inf:
                            out.append((q, -score[at], at, close[at]))
                    if out:
                        q, cost, at, close = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(q, others.type), pa.array(cost, pa.float64()), others.take(pa.array(at)), pa.array(close, pa.float64())], names=["query", "cost", "other", "similarity"])

            found = rows.mapInArrow(best, f"query {kind}, cost double, other {kind}, similarity double")
            picked = found.groupBy("query").agg(F.min(F.struct("cost", "other", "similarity")).alias("b")).select("query", "b.other", "b.similarity").collect()
            for r in picked:
                taken[r.query].append((r.other, r.similarity))
            new = {r.other for r in picked} - chosen.keys()
            if new:
                held = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in new], f"other {kind}")), "other").toArrow()
                words = held.column("keywords").combine_chunks()
                chosen |= {k: words[i].values.to_numpy() for i, k in enumerate(held.column("other").to_pylist())}
            sent.destroy()
        ranked += [(q, n, other, close) for q, picks in taken.items() for n, (other, close) in enumerate(picks, 1) if close >= threshold]
    return spark.createDataFrame(ranked, f"query {kind}, rank int, other {kind}, similarity double")
