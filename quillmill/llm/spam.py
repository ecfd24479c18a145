"""Pages made of keywords, links, tags or product lines instead of sentences.

Each line is scored by two n-gram models. A word-class trigram model of prose (``prose``), trained on the prose-like lines of the same
crawl: a line whose loss lies far above that of prose of its length is a string of keywords, links, headlines, tags or products. And the
word trigrams of the page itself, each place predicted by all others: a line whose loss under them is abnormally low only recycles key
phrases. A page is flagged by the share of its characters in such lines.

Null, empty and blank texts give no row, rows with a null id are kept out, repeated rows count once, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages as reading

#: Standard errors above the loss of prose from which a line counts as unlike prose.
UNLIKE_PROSE = 4.0
#: Bits a token by which its loss must exceed that of prose as well, so that long paragraphs aren't judged by a trifle.
EXCESS_BITS = 1.0
#: Bits a word, or a character of Han text, under the page's own trigrams up to which a line only recycles phrases; and tokens that a line
#: needs to be a sentence.
RECYCLED_BITS, RECYCLED_TOKENS = 3.4, 15


def line_shares(judged: reading.Judged) -> tuple[np.ndarray, np.ndarray]:
    """(share of characters in lines unlike prose, share in lines that recycle phrases) of each page; wrecked lines are judged neither way."""
    lines = judged.lines
    sound = ~judged.has("unsound")
    high = (judged.excess > np.maximum(EXCESS_BITS, UNLIKE_PROSE * judged.error)) & (lines["tokens"] > 0) & sound
    low = (lines["own"] < RECYCLED_BITS) & (lines["tokens"] >= RECYCLED_TOKENS) & sound & ~high
    total = np.maximum(1, judged.sums(lines["size"]))
    return judged.sums(lines["size"] * high) / total, judged.sums(lines["size"] * low) / total


def spam_shares(pages: DataFrame, page_id: str = "page_id", text: str = "content", read: reading.Pages | None = None) -> DataFrame:
    """(id, unlike_prose, recycled): one row per distinct id and text. Texts are read once and never shuffled."""
    read = read or reading.read_pages(pages, page_id, text)
    kind = dict(read.rows.dtypes)["id"]
    sent = pages.sparkSession.sparkContext.broadcast(read.model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, reading.SLICE):
                batch = whole.slice(at, reading.SLICE)
                high, low = line_shares(reading.Judged(sent.value, *batch.columns[1:]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high), pa.array(low)], names=["id", "unlike_prose", "recycled"])

    return read.rows.select("id", "lang", "classes", "lines").mapInArrow(score, f"id {kind}, unlike_prose double, recycled double").distinct().withColumnRenamed("id", page_id)


def spam_pages(pages: DataFrame, page_id: str = "page_id", text: str = "content", share: float = 0.5) -> DataFrame:
    """Ids of pages with more than ``share`` of their characters in such lines."""
    return spam_shares(pages, page_id, text).where(F.col("unlike_prose") + F.col("recycled") > share).select(page_id).distinct()
