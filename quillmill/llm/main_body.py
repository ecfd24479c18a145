"""The main body of a page, line by line.

Layout-aware rendering: every line gets a tag, the lines build a tree with implied sections, and rules of visibility decide what is shown
(``layout``). Pages that are still HTML are rendered to lines first by the same module.

The tags rest on statistics over all pages: how many different articles hold a line, over the whole crawl and on its host (a line
that many articles share is furniture, whatever it says; reprints of one article count once, by their two longest lines), and how much a
line's word classes differ from prose (``prose``). Lists of words for section labels, bylines and notices help where a line varies.

Texts are read once (``pages``); what is counted, joined and judged after that are narrow rows. The shared lines of the crawl number at
most lines-per-page / ``crawl_share`` whatever the number of pages, so they are sent to every worker; those of the hosts are sent too
while their counted number is small, and else joined by host, each host spread over ``SALTS`` keys.

Null, empty and blank texts give no row, rows with a null id are kept out, repeated rows count once, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout
from . import pages as reading
from .bags import mix
from .common import checkpointed
from .spam import line_shares

#: Share of the crawl's articles, and of a host's articles, from which a line counts as shared; and the least number of articles.
CRAWL_SHARE, HOST_SHARE, LEAST_ARTICLES = 0.002, 0.08, 3
#: Keys of hosts' lines that are broadcast at most, eight bytes each, and the keys that a host is spread over where they are joined.
BROADCAST_KEYS, SALTS = 1_000_000, 32


def of_host(host: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One key for a line and its host."""
    return (mix(host.view(np.uint64)) ^ key.view(np.uint64)).view(np.int64)


def statistics(rows: DataFrame, crawl_share: float, host_share: float) -> tuple[np.ndarray, DataFrame]:
    """Sorted keys of lines that many articles share over the crawl, and (host, line) of those that a host's articles share."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.append(np.frombuffer(r, reading.LINE)["key"], 0)) for r in batch.column(2).to_pylist()]  # 0 stands for the article itself
            if found:
                n = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(batch.column(1).to_numpy(), n)), pa.array(np.concatenate(found))], names=["host", "article", "line"])

    lines = rows.select("host", "article", "lines").mapInArrow(spread, "host long, article long, line long")
    # copies of one article on one host count once: first the distinct triples, by two steps of partial aggregation
    each = checkpointed(lines.groupBy("line", "host").agg(F.count_distinct("article").alias("n")))
    total = each.where("line = 0").agg(F.sum("n")).first()[0] or 0
    crawl = each.groupBy("line").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST_ARTICLES, crawl_share * total)).where("line <> 0").select("line").toArrow()
    sizes = each.where("line = 0").select("host", F.col("n").alias("articles"))
    own = each.where(f"line <> 0 and n >= {LEAST_ARTICLES}").join(sizes, "host").where(F.col("n") >= host_share * F.col("articles")).select("host", "line")
    return np.sort(crawl.column("line").to_numpy()), own


def holds(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys stand in a sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def line_kinds(judged: reading.Judged, shared: np.ndarray) -> np.ndarray:
    """Tag of each line; of several the first holds."""
    has, tokens = judged.has, judged.lines["tokens"]
    excess = judged.excess / judged.error
    prosaic = (excess < 3.5) & (tokens >= 6)
    ended = has("ended")
    rules = [
        (has("blank"), layout.BLANK),
        (has("title"), layout.HEADLINE),
        (has("comments"), layout.COMMENTS),
        (has("section"), layout.ASIDE),
        (shared, layout.FURNITURE),
        (has("teaser"), layout.TEASER),
        (has("time") | (has("meta") & ~(prosaic & (tokens > 20))) | (has("notice") & ~(prosaic & (tokens > 25))), layout.FURNITURE),
        (has("caption"), layout.CAPTION),
        (has("reference"), layout.REFERENCE),
        (has("item"), layout.ITEM),
        (has("quote"), layout.QUOTE),
        ((tokens >= 8) & (prosaic | (ended & (excess < 8))) & (ended | (tokens >= 25)), layout.PARAGRAPH),
        ((excess > 5) & has("bar"), layout.FURNITURE),
        (has("trail"), layout.FURNITURE),
        (has("wrecked") & (judged.lines["size"] > 60), layout.PARAGRAPH),
    ]
    return np.select([r[0] for r in rules], [r[1] for r in rules], layout.HEADING)


def find_body(pages: DataFrame, page_id: str = "page_id", text: str = "content", title: str = "title", host: str = "host", crawl_share: float = CRAWL_SHARE, host_share: float = HOST_SHARE, spam_share: float = 0.5) -> DataFrame:
    """(id, line_no): the lines of each page's main body; pages that are mostly keyword lists have none."""
    read = reading.read_pages(pages, page_id, text, title, host)
    kind = dict(read.rows.dtypes)["id"]
    crawl, own = statistics(read.rows, crawl_share, host_share)
    own = checkpointed(own)
    few = own.count() <= BROADCAST_KEYS
    keys = np.empty(0, np.int64)
    rows = read.rows.select("id", "host", "lang", "classes", "lines")
    if few:
        found = own.toArrow()
        keys = np.sort(of_host(found.column("host").to_numpy(), found.column("line").to_numpy()))
        rows = rows.withColumn("own", F.lit(None).cast("array<long>"))
    else:
        lists = own.groupBy("host").agg(F.collect_list("line").alias("own")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(lists, ["host", "salt"], "left").select("id", "host", "lang", "classes", "lines", "own")
    sent = pages.sparkSession.sparkContext.broadcast((read.model, crawl, keys))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, crawl, keys = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, reading.SLICE):
                batch = whole.slice(at, reading.SLICE)
                judged = reading.Judged(model, *batch.columns[2:5])
                key = judged.lines["key"]
                hosts = batch.column(1).to_numpy()
                shared = holds(crawl, key)
                if few:
                    shared |= holds(keys, of_host(hosts[judged.page], key))
                else:
                    lists: dict[int, np.ndarray] = {}
                    for k, h in enumerate(hosts.tolist()):
                        if h not in lists:
                            lists[h] = np.sort(np.array(batch.column(5)[k].as_py() or [], np.int64))
                        part = slice(judged.first[k], judged.first[k + 1])
                        shared[part] |= holds(lists[h], key[part])
                high, low = line_shares(judged)
                kinds, tokens = line_kinds(judged, shared).tolist(), judged.lines["tokens"].tolist()
                where, numbers = [], []
                for k in np.flatnonzero(high + low <= spam_share).tolist():
                    part = slice(judged.first[k], judged.first[k + 1])
                    found = layout.visible(layout.built(kinds[part], tokens[part]), kinds[part])
                    where += [k] * len(found)
                    numbers += found
                if where:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array(np.array(numbers, np.int32) + 1)], names=["id", "line_no"])

    return rows.mapInArrow(judge, f"id {kind}, line_no int").distinct().withColumnRenamed("id", page_id)


def body_text(pages: DataFrame, page_id: str = "page_id", text: str = "content", title: str = "title", host: str = "host", **settings) -> DataFrame:
    """(id, body): the main body of each page that has one, with its spacing, lists and aligned cells; one row per distinct id and text."""
    numbers = find_body(pages, page_id, text, title, host, **settings).groupBy(page_id).agg(F.collect_list("line_no").alias("numbers"))
    rows = pages.select(F.col(page_id).alias("id"), F.col(text).alias("body")).where("id is not null and body is not null").distinct()
    joined = rows.join(numbers.withColumnRenamed(page_id, "id"), "id").select("id", "body", "numbers")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body, shown in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = body.split("\n")
                bodies.append(layout.rendered(lines, [n for n in shown if n <= len(lines)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["id", "body"])

    return joined.mapInArrow(render, f"id {dict(rows.dtypes)['id']}, body string").withColumnRenamed("id", page_id)


def rendered_pages(pages: DataFrame, html: str) -> DataFrame:
    """Pages with ``html`` replaced by its visible text, laid out in lines, as ``find_body`` takes it; null stays null."""
    columns = [c for c in pages.columns if c != html]
    tagged = pages.select(*[F.col(c) for c in columns], F.col(html).alias("_source"))
    schema = tagged.withColumnRenamed("_source", html).schema

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if s is None else layout.page_text(s) for s in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return tagged.mapInArrow(render, schema)
