"""Calls to services behind interfaces: a text model and an embedding model, with retries, batches and defined failures.

Clients are plain callables that the caller injects and that run on the workers; the stubs here are deterministic and need no network.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.state import checkpointed
from . import claims, review, titles
from .notes import LEAST_CONTENT, chunked, from_json, json_in, parse_output

class Request(str):
    """A prompt, with the limit of the answer's tokens and whether the service is held to JSON; plain clients may read it as a string."""

    max_tokens: int
    json_mode: bool

    def __new__(cls, prompt: str, max_tokens: int = 4096, json_mode: bool = True):
        made = super().__new__(cls, prompt)
        made.max_tokens, made.json_mode = max_tokens, json_mode
        return made


@dataclass
class Answer:
    """What a service gave: the text, and why it stopped ("length" where the limit cut it)."""

    text: str
    finish: str = "stop"


Text = Callable[[Request], "str | Answer"]
Embed = Callable[[list[str]], list[list[float]]]


class ServiceError(Exception):
    """A failed call; ``retry`` says whether another try may help."""

    def __init__(self, message: str, retry: bool = True):
        super().__init__(message)
        self.retry = retry


def with_retries(call: Callable, *args, tries: int = 2, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """Call again after waits that double; errors that no retry helps are raised at once."""
    for k in range(tries):
        try:
            return call(*args)
        except ServiceError as error:
            if not error.retry or k + 1 == tries:
                raise
            sleep(wait * 2**k)
    raise AssertionError


def stub_text(prompt: str) -> str:
    """The first sentences of a prompt as notes."""
    lines = [s.strip() for s in prompt.split("\n") if len(s.strip()) >= 10][:3]
    return json.dumps({"notes": [{"title": s[:18], "content": s, "tags": []} for s in lines]}, ensure_ascii=False)


def stub_embedding(texts: list[str], dimension: int = 64) -> list[list[float]]:
    def one(text: str) -> list[float]:
        seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
        return np.random.default_rng(seed).normal(size=dimension).round(6).tolist()

    return [one(t) for t in texts]


class CoolDown:
    """A client that, after a failure that all its tries shared, fails at once for a time instead of calling again. State per worker process."""

    def __init__(self, call: Callable, seconds: float = 300, clock: Callable[[], float] = time.time):
        self.call, self.seconds, self.clock, self.until = call, seconds, clock, 0.0

    def __call__(self, *args):
        if self.clock() < self.until:
            raise ServiceError("cooling down", retry=False)
        try:
            return self.call(*args)
        except ServiceError:
            self.until = self.clock() + self.seconds
            raise


def asked(client: Text, prompt: str, tries: int = 2, max_tokens: int = 4096, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer to a prompt. An answer that its limit cut to nothing is asked for again with twice the tokens, another empty one without
    JSON mode; empty again is an error."""
    request = Request(prompt, max_tokens)
    for again in (True, False):
        found = with_retries(client, request, tries=tries, sleep=sleep)
        answer = found if isinstance(found, Answer) else Answer(found)
        if answer.text and answer.text.strip():
            return answer.text
        if again:
            request = Request(prompt, 2 * max_tokens, request.json_mode) if answer.finish == "length" else Request(prompt, max_tokens, json_mode=False)
    raise ServiceError("empty answer", retry=False)


def wish(preferences: list[str] | None, strict: bool) -> str:
    """What a prompt says about tags: only the preferred ones, preferably these, or nothing."""
    return "" if not preferences else f"Tags: {'only' if strict else 'prefer'} {', '.join(preferences)}.\n"


def extraction_prompt(text: str, most: int = 10_000, preferences: list[str] | None = None, strict: bool = False) -> str:
    return f'Answer as JSON {{"notes": [{{"title", "content", "tags", "source"}}]}}.\n{wish(preferences, strict)}Text:\n{text[:most]}'


def review_prompt(notes: list[tuple[str | None, str | None]], preview: int = 500) -> str:
    """Asks for scores of numbered notes, of which each shows its beginning."""
    shown = "\n".join(f"[{n}] {title or ''}\n{(content or '')[:preview]}" for n, (title, content) in enumerate(notes, 1))
    return f'Score each note from 1 to 5 for insight and for knowledge. Answer as a JSON array of {{"index", "insight_score", "knowledge_score", "final_score", "verdict", "reason"}}.\n{shown}'


def comparison_prompt(source: str, claims: list[str], most: int = 10_000) -> str:
    """Asks which numbered claims, from 0, the source speaks of."""
    shown = "\n".join(f"[{n}] {c}" for n, c in enumerate(claims))
    return f'Compare each claim with the source. Answer as a JSON array of {{"index", "status", "source_text", "diff_note"}}; status is 需对比 or 超源.\nSource:\n{source[:most]}\nClaims:\n{shown}'


def strictly_valid(notes: list[dict]) -> list[dict]:
    return [n for n in notes if n["title"].strip() and len(n["content"]) >= LEAST_CONTENT]


def extracted_notes(rows: DataFrame, key: str, text: str, client: Text = stub_text, tries: int = 2, preferences: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(key, pos, title, content, source, tags, error): notes that a model draws from each text; a failed text is one row with its error.

    The answer is read as JSON first and, where that gives no valid note, by all the ways of ``parse_output``.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, body in zip(batch[key], batch[text], strict=True):
                try:
                    answer = asked(client, extraction_prompt(body or "", preferences=preferences, strict=strict), tries)
                    read = json_in(answer, "{")
                    given = strictly_valid(from_json(read["notes"])) if isinstance(read, dict) and isinstance(read.get("notes"), list) else []
                    notes = given or parse_output(answer)
                    out += [(k, p, n["title"], n["content"], n["source"], n["tags"], n["listed"], None) for p, n in enumerate(notes)] or [(k, 0, None, None, None, None, None, "no_notes")]
                except ServiceError as error:
                    out.append((k, 0, None, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=[key, "pos", "title", "content", "source", "tags", "listed", "error"])

    found = rows.select(key, text).mapInPandas(run, f"{key} {kind}, pos int, title string, content string, source string, tags array<string>, listed boolean, error string")
    return titles.ensured(found, "title", "content", "listed").withColumn("title", F.when(F.col("error").isNull(), F.col("title"))).drop("listed")


def reviewed(notes: DataFrame, key: str, pos: str, title: str, content: str, client: Text, least: int = 6, tries: int = 2) -> DataFrame:
    """(key, idx, insight, knowledge, final, verdict, reason, success): one call for the notes of each key (an extraction, some dozens of notes).

    Where the call fails every note keeps the default of 3 + 3 and ``success`` is false.
    """
    kind = dict(notes.dtypes)[key]
    given = notes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(title).alias("t"), F.col(content).alias("c")))).alias("n"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, rows in zip(batch[key], batch["n"], strict=True):
                try:
                    raw = asked(client, review_prompt([(r["t"], r["c"]) for r in rows]), tries)
                except ServiceError:
                    raw = None
                out.append((k, raw, len(rows)))
            yield pd.DataFrame(out, columns=[key, "raw", "n"])

    answers = checkpointed(given.mapInPandas(call, f"{key} {kind}, raw string, n int"))
    return review.parsed(answers, key, "raw", "n", least).join(answers.select(key, F.col("raw").isNotNull().alias("success")), key)


def compared(claims_left: DataFrame, key: str, claim: str, source: str, client: Text, tries: int = 2) -> DataFrame:
    """(key, claim, status, source_text, diff_note, reason): one call for the unmatched claims of each key against its source.

    A claim that the answer passes over, a quotation that the source lacks, and every claim of a failed call are beyond the source.
    """
    kind = dict(claims_left.dtypes)[key]
    given = claims_left.groupBy(key).agg(F.sort_array(F.collect_set(claim)).alias("c"), F.max(source).alias("s"))
    schema = f"{key} {kind}, {claim} string, _source string, _status string, _quote string, _note string, _reason string"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, found, body in zip(batch[key], batch["c"], batch["s"], strict=True):
                said: dict[int, dict] = {}
                reason = "not answered"
                try:
                    read = json_in(asked(client, comparison_prompt(body or "", list(found)), tries), "[")
                    said = {int(r["index"]): r for r in read or [] if isinstance(r, dict) and str(r.get("index", "")).isdigit()}
                except ServiceError as error:
                    reason = str(error)
                for n, text in enumerate(found):
                    r = said.get(n)
                    out.append((k, text, body, r.get("status"), r.get("source_text"), r.get("diff_note"), None) if r else (k, text, body, None, None, None, reason))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    answers = claims.settled(given.mapInPandas(call, schema), "_status", "_quote", "_source")
    good = F.col("status") == claims.COMPARE
    return answers.select(key, claim, "status", F.when(good, F.col("_quote")).alias("source_text"), F.when(good, F.col("_note")).alias("diff_note"), F.col("_reason").alias("reason"))


def deep_notes(rows: DataFrame, key: str, text: str, client: Text = stub_text, size: int = 10_000, overlap: int = 500) -> DataFrame:
    """Notes of long texts chunk by chunk, in order; a text fails only if all its chunks do."""
    parts = chunked(rows, key, text, size, overlap).withColumn("_id", F.concat_ws("#", F.col(key).cast("string"), F.format_string("%06d", "pos")))
    found = extracted_notes(parts, "_id", "chunk", client).withColumnRenamed("pos", "note_pos")
    both = found.join(parts.select("_id", key, F.col("pos").alias("chunk_pos")), "_id").drop("_id")
    good = both.where("error is null")
    failed = both.join(good.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.first("error").alias("error"))
    return good.unionByName(failed, allowMissingColumns=True)


def embedded(rows: DataFrame, key: str, text: str, client: Embed = stub_embedding, batch_size: int = 16, tries: int = 3) -> DataFrame:
    """(key, vector): embeddings in batches of sixteen; null for a batch that fails after its retries."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors: list = []
            for k in range(0, len(batch), batch_size):
                part = [t or "" for t in batch[text].iloc[k : k + batch_size]]
                try:
                    vectors += with_retries(client, part, tries=tries)
                except ServiceError:
                    vectors += [None] * len(part)
            yield pd.DataFrame({key: batch[key], "vector": vectors})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")
