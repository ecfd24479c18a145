"""Evaluation texts that leak into a corpus.

One Aho-Corasick automaton holds every window of the test items; each document is read once, unit by unit, and every hit is
mapped back to the characters of the original text.

The alphabet of the automaton is the set of units of the items: each distinct unit (a Han character, or a lower-cased run of
other letters and digits) becomes one code point and every other unit of a document becomes one code point that no pattern
holds. A pattern of thirteen units is then a string of thirteen characters, unit boundaries need no check, and the automaton
stays small enough for every worker.

Rows: one per document and item, with the number of matching windows and the span of the first one (1-based code points,
``end_pos`` inclusive). Null or unit-less texts and items match nothing; rows with a null id are kept out; repeated rows count
once; other columns are ignored, so clashing names do no harm; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import UNIT

#: Units of other letters become code points from here on; the first stands for units that no item holds.
FIRST = 0x20000
#: Characters of items held in one automaton, which has at most a node for each unit of each window (about 40 bytes each, so 13 windows'
#: worth of 500,000 units stay below 300 MB); more items are scanned in further blocks, each with its own pass.
BLOCK_CHARS = 500_000


def units(text: str) -> list[str]:
    """Lower-cased units of a text, in order."""
    return [u.lower() for u in UNIT.findall(text)]


class Automaton:
    """Windows of one block of items, over code points that stand for units."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.code: dict[str, str] = {}
        windows: dict[str, set[int]] = defaultdict(set)
        for item, text in items:
            codes = "".join(self.code.setdefault(u, chr(FIRST + 1 + len(self.code))) for u in units(text))
            if codes:
                for k in range(max(1, len(codes) - window + 1)):
                    windows[codes[k : k + window]].add(item)
        self.machine = ahocorasick.Automaton()
        for pattern, found in windows.items():
            self.machine.add_word(pattern, (len(pattern), tuple(sorted(found))))
        self.empty = not windows
        if windows:
            self.machine.make_automaton()

    def scan(self, text: str) -> dict[int, list[int]]:
        """item -> [number of windows, first unit, last unit of the first window]"""
        get, other = self.code.get, chr(FIRST)
        found: dict[int, list[int]] = {}
        for end, (length, items) in self.machine.iter("".join([get(u, other) for u in UNIT.findall(text.lower())] if len(text.lower()) == len(text) else [get(u, other) for u in units(text)])):
            for item in items:
                if item in found:
                    found[item][0] += 1
                else:
                    found[item] = [1, end - length + 1, end]
        return found


_built: dict[str, Automaton] = {}


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Documents that hold ``window`` consecutive units of an item, or all of an item that has fewer.

    The corpus is never shuffled before its hits: scan, match, then one aggregation over the (few) hits that drops repeated rows.
    """
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("body")).where("item is not null and body is not null").distinct()
    chars = wanted.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    corpus = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).where("doc is not null and body is not null")
    kinds = dict(corpus.dtypes)["doc"], dict(wanted.dtypes)["item"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, windows long, start_pos long, end_pos long"
    types = [f.dataType for f in (corpus.schema["doc"], wanted.schema["item"])]
    arrow = [to_arrow_type(t) for t in types] + [pa.int64()] * 3
    out = None
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        pairs = sorted((r.item, r.body) for r in part.collect())
        sent = documents.sparkSession.sparkContext.broadcast(pairs)
        key = f"{sent.id if hasattr(sent, 'id') else id(sent)}-{hash((tuple(pairs), window))}"

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            if key not in _built:
                _built.clear()
                _built[key] = Automaton(sent.value, window)
            machine = _built[key]
            for batch in batches:
                rows = []
                if not machine.empty:
                    for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        if found := machine.scan(body):
                            spans = [m.span() for m in UNIT.finditer(body)]
                            rows += [(doc, item, n, spans[a][0] + 1, spans[b][1]) for item, (n, a, b) in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=["doc_id", "item_id", "windows", "start_pos", "end_pos"])

        hits = corpus.mapInArrow(scan, schema)
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.min("start_pos").alias("start_pos"), F.min("end_pos").alias("end_pos"))
