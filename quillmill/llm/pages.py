"""One reading of a crawl's pages, shared by the operators that judge lines.

A single pass over the texts repairs what can be repaired, cuts lines, and keeps of every page only what judging needs: the word class
of each token (a byte) and a record of each line. Later passes read these narrow rows; texts are neither read again nor shuffled.

A line's record holds the key by which equal lines are counted, its size, its tokens, what its words and marks say (flags), and its loss
under the page's own word trigrams, each token predicted by all other places of the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import nlargest
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prose
from .common import checkpointed
from .mojibake import WRECK, repaired, softened, softly_repaired, wreckage

LINE = np.dtype([("key", "<i8"), ("size", "<i4"), ("tokens", "<i4"), ("flags", "<i4"), ("own", "<f4")])
FLAGS = {name: 1 << k for k, name in enumerate("blank title comments section teaser meta time notice caption reference item quote ended parted bar trail wrecked unsound".split())}
SCHEMA = "host long, article long, lang int, classes binary, lines binary"
#: Pages judged at once, so that arrays over their tokens stay small.
SLICE = 400
#: Share of a line's characters that are wreckage of a wrong decoding, from which its losses say nothing, and from which its form does not either.
UNSOUND, WRECKED = 0.08, 0.15

#: Places at which a page's single units count where its trigrams are asked, so that a phrase which stands twice is still unexpected.
PRIOR = 4

_BULLET = re.compile(r"^(?:[-•*·–]\s+|\d{1,2}[.)]\s+|[a-z]\)\s+)")
_QUOTE = re.compile(r"^(?:>|“.*”[.!?。！？]?$|«.*»\.?$|„.*“\.?$|「.*」$)")
_REFERENCE = re.compile(r"^(?:\[\d+\]|\(\d+\)|\d+\.)\s.*\(?(?:19|20)\d{2}\)?")
_CAPTION = re.compile(r"^(?:Fig(?:ure|\.)?|Abb(?:ildung|\.)?|Figura|Image|Photo|Bild|Tab(?:le|elle|\.)?|Tabla|Tableau|图|表|图片)\s*\d+\s*[:：.\s]", re.IGNORECASE)
# Words of page furniture in five languages, by kind.
_BYLINE = re.compile(
    r"^(?:By\s.{2,60}(?:staff|·|\d{4})|By\s[A-ZÀ-Ý][\w’.-]+(?:\s[A-ZÀ-Ý][\w’.-]+){0,3}$|Von\s(?:der\s)?\w+.*\d|Par\s.{2,60}\d{4}|Por\s.{2,60}\d{4}|La rédaction\b|La redacción\b|Die Redaktion\b|Redacción\b|Rédaction\b|Redaktion\b|Equipo de redacción|编辑[:：]|作者[:：]|来源[:：]|记者[:：]|责编|文[/／]"
    r"|(?:Updated|Published|Posted|Last updated|Aktualisiert|Veröffentlicht|Stand|Mis à jour|Publié|Actualizado|Publicado|更新|发布)\b.{0,12}\d|更新(?:时间|于)?[:：]?\s?\d|发布(?:时间|于)?[:：]?\s?\d)",
)
_TIME = re.compile(
    r"(?:\d+\s?min(?:utos|uten|utes|\.)?\b.{0,8}$|^阅读约|^收听本文|^Lesezeit|^Lecture\s?:|^Lectura\s?:|^Listen to|^Écouter|^Escuchar|^Artikel anhören|\bmin read\b|小时前|分钟前|天前|\b(?:hours?|days?|minutes?|weeks?) ago\b|\bil y a \d|\bvor \d+ (?:Stunde|Tag|Minute)|\bhace \d)",
    re.IGNORECASE,
)
_TAGS = re.compile(r"^(?:Tags?|Keywords|Topics|Filed under|Posted in|Mots-clés|Étiquettes|Schlagw(?:örter|orte)|Stichwörter|Etiquetas|Palabras clave|标签|关键词|分类|话题|栏目)\s?[:：]?\s?(?:in\s)?\S", re.IGNORECASE)
_SECTION = re.compile(
    r"^(?:Related|Read next|You may also like|More from|Most read|Popular|Trending|Recommended|See also|Further reading on|Up next|Keep reading|À lire aussi|Sur le même thème|Les plus lus|À découvrir|Lire aussi|Mehr zum Thema|Meistgelesen|Das könnte|Weiterlesen|Auch interessant|Te puede interesar|Lo más leído|Sigue leyendo|También te|Más sobre|相关阅读|猜你喜欢|本周热门|本栏更多|推荐阅读|延伸阅读|热门文章|更多|上一篇|下一篇|Previous\b.{0,12}Next|Prev\b)",
    re.IGNORECASE,
)
_COMMENTS = re.compile(r"^(?:\d+\s?(?:comments?|commentaires?|Kommentare?|comentarios?)\b|\d+\s?条评论|Leave a comment|Leave a reply|Comments?$|Commentaires?$|Kommentare?$|Comentarios?$|发表评论|评论区?$|网友评论|Laisser un commentaire|Deja un comentario|Kommentar (?:schreiben|verfassen))", re.IGNORECASE)
_REPLY = re.compile(r"^(?:Reply|Répondre|Antworten|Responder|回复)\b.{0,30}$|^(?:Reply|Répondre|Antworten|Responder|回复)\s?[·•|]?\s?", re.IGNORECASE)
_NOTICE_START = re.compile(r"(?:Sponsored|Advertisement|Advertorial|Publicité|Anzeige|Publicidad|广告|推广)\b|推广[:：]|广告$|(?:Share|Partager|Teilen|Compartir)\s?:|分享到", re.IGNORECASE)
_NOTICE_YEAR = re.compile(r"\(c\)\s?(?:19|20)\d{2}|免费阅读\d+篇")
_NOTICE_WORDS = [
    "©", "all rights reserved", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos", "版权所有", "备案号", "icp备", "未经许可", "不得转载", "subscribe", "newsletter", "free article left", "free articles left", "articles gratuits", "article gratuits", "freie artikel", "artículos gratis",
    "sign up for", "privacy policy", "cookie policy", "cookie settings", "back to top", "nach oben", "haut de page", "volver arriba", "返回顶部", "follow us",
]
_BAR = re.compile(r"\s(?:[|/·•»›>→]|&gt;)\s|\s{2,}|\s—\s")
_TRAIL = re.compile(r"\s[>›»/|·→]\s")
_STOPS, _CLOSING = set(".!?。！？"), "\"”’»“）)]"
_DIGITS = re.compile(r"\d+")


def plain(line: str) -> str:
    """A line without bullets and white space at its ends, numbers as one digit."""
    return _DIGITS.sub("0", _BULLET.sub("", line).strip())


def titles(title: str | None) -> set[str]:
    """The title, and its parts around a separator that may join the site's name."""
    if not title:
        return set()
    whole = softly_repaired(title).strip()
    parts = {whole}
    for mark in (" | ", " - ", " – ", " — ", " · ", "_", " « ", " :: "):
        parts.update(p.strip() for p in whole.split(mark))
    return {p.casefold() for p in parts if len(p) > 3}


#: Key and flags of a line by its words and marks alone; only the lines that come again are worth remembering.
_memo: dict[str, tuple[int, int]] = {}
REMEMBERED = 200


def _notice(line: str) -> bool:
    low = line.lower()
    return any(w in low for w in _NOTICE_WORDS) or _NOTICE_START.match(line) is not None or (("(c)" in low or "免费" in low) and _NOTICE_YEAR.search(low) is not None)


def marks(line: str, tokens: int) -> tuple[int, int]:
    """(key, flags) of a stripped line that is not blank."""
    if (found := _memo.get(line)) is not None:
        return found
    flags = FLAGS["ended"] if line.rstrip(_CLOSING)[-1:] in _STOPS else 0
    if _COMMENTS.match(line):
        flags |= FLAGS["comments"]
    elif tokens <= 20 and not flags and _SECTION.match(line):
        flags |= FLAGS["section"]
    elif _REPLY.match(line) or _BYLINE.match(line) or _TAGS.match(line):
        flags |= FLAGS["meta"]
    elif tokens < 16 and _TIME.search(line):
        flags |= FLAGS["time"]
    elif tokens <= 60 and _notice(line):
        flags |= FLAGS["notice"]
    if line[-1] == "…" and (tokens < 30 or " — " in line):
        flags |= FLAGS["teaser"]
    if _CAPTION.match(line):
        flags |= FLAGS["caption"]
    elif _REFERENCE.match(line):
        flags |= FLAGS["reference"]
    elif _BULLET.match(line):
        flags |= FLAGS["item"]
    elif _QUOTE.match(line):
        flags |= FLAGS["quote"]
    if bars := _BAR.findall(line):
        flags |= FLAGS["parted"] | (FLAGS["bar"] if len(bars) > 1 else 0)
    found = xxhash.xxh3_64_intdigest(plain(line)) - (1 << 63), flags
    if len(line) <= REMEMBERED:
        if len(_memo) > 200_000:
            _memo.clear()
        _memo[line] = found
    return found


def own_losses(text: str, lines: prose.Lines) -> np.ndarray:
    """Mean loss in bits of each line's units under the trigrams of the page's other places; 0 for an empty line.

    Units are words and marks, and single characters where the page is Han text, which has no spaces between words.
    """
    starts, ends = lines.starts, lines.ends
    if lines.lang == prose.ZH:
        letters = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(letters == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        found, unit = np.unique(letters, return_inverse=True)
        n, size = len(unit), len(found)
    else:
        number = defaultdict(count().__next__)
        n = len(lines.tokens)
        unit = np.fromiter(map(number.__getitem__, lines.tokens), np.int64, n)
        size = len(number)
    chance = np.bincount(unit)[unit] / (n - 1 + size)
    if n > 2:
        pair = unit[:-2] * size + unit[1:-1]
        triple = pair * size + unit[2:]
        order = triple.argsort()
        runs3, runs2 = _runs(triple[order]), _runs(pair[order])
        seen = np.empty(n - 2)
        seen[order] = (runs3 - 1 + PRIOR * chance[2:][order]) / (runs2 - 1 + PRIOR)
        chance[2:] = seen
    total = np.concatenate([[0.0], np.cumsum(-np.log2(chance))])
    return (total[ends] - total[starts]) / np.maximum(1, ends - starts)


def _runs(values: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, how often its value stands there."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    n = np.diff(edges)
    return np.repeat(n, n)


def read_page(body: str, title: str | None) -> tuple[prose.Lines, np.ndarray, int]:
    """(classes, line records, key of the article)"""
    before = repaired(body)
    fixed = softened(before)
    parts = fixed.split("\n")
    # what a line lost in its repair counts as wreckage
    raw = parts if fixed is before else before.split("\n")
    lines = prose.read_lines(fixed)
    out = np.zeros(len(parts), LINE)
    tokens = (lines.ends - lines.starts).tolist()
    heads = titles(title)
    longest = max(map(len, heads), default=0) + 8
    wrecked = not before.isascii() and WRECK.search(before) is not None
    keys, flags = [], []
    for k, part in enumerate(parts):
        line = part.strip()
        if not line:
            keys.append(0)
            flags.append(FLAGS["blank"])
            continue
        key, flag = marks(line, tokens[k])
        if heads:
            if len(line) <= longest and line.casefold() in heads:
                flag |= FLAGS["title"]
            elif flag & FLAGS["parted"] and _TRAIL.search(line):
                low = line.casefold()
                if any(h in low for h in heads):
                    flag |= FLAGS["trail"]  # a trail that ends in the title
        if wrecked:
            if wreckage(raw[k]) > UNSOUND * len(raw[k]):
                flag |= FLAGS["unsound"]
            if wreckage(part) > WRECKED * len(line):
                flag |= FLAGS["wrecked"]
        keys.append(key)
        flags.append(flag)
    out["key"], out["flags"], out["tokens"], out["size"], out["own"] = keys, flags, tokens, list(map(len, parts)), own_losses(fixed, lines)
    return lines, out, article_key(parts)


def article_key(parts: list[str]) -> int:
    """Key of an article by its two longest lines, so that reprints count once and a long notice alone doesn't make all pages one."""
    return xxhash.xxh3_64_intdigest("\n".join(p.strip() for p in nlargest(2, parts, key=len))) - (1 << 63)


class Pages:
    """What one pass gave: the narrow rows of all pages, and the prose model that their prose-like lines taught."""

    def __init__(self, rows: DataFrame, model: prose.ProseModel):
        self.rows, self.model = rows, model


def read_pages(pages: DataFrame, page_id: str, text: str, title: str | None = None, host: str | None = None) -> Pages:
    """One row per page row with text that is not blank: (id, host, article, lang, classes, lines)."""
    none = F.lit(None).cast("string")
    rows = pages.select(F.col(page_id).alias("id"), F.col(text).alias("body"), (F.col(title) if title else none).alias("title"), F.xxhash64(F.coalesce(F.col(host), F.lit("")) if host else F.lit("")).alias("host")).where("id is not null and body is not null")
    kind = dict(rows.dtypes)["id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(prose.LANGS) * prose.K**3, np.int64)
        names = ["id", "host", "article", "lang", "classes", "lines"]
        kind = None
        for whole in batches:
            kind = whole.column(0).type
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                keep, articles, langs, classes, records, cells = [], [], [], [], [], []
                for k, (body, head) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    if not body.strip():
                        continue
                    lines, found, article = read_page(body, head)
                    keep.append(k)
                    articles.append(article)
                    langs.append(lines.lang)
                    classes.append(lines.classes.astype(np.uint8).tobytes())
                    records.append(found.tobytes())
                    good = prose.is_prose_like(lines)
                    if good.any():
                        cells.append(prose.trigrams(lines)[np.repeat(good, lines.ends - lines.starts + 1)])
                if cells:
                    total += np.bincount(np.concatenate(cells), minlength=len(total))
                if keep:
                    take = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(3).take(take), pa.array(articles, pa.int64()), pa.array(langs, pa.int32()), pa.array(classes, pa.binary()), pa.array(records, pa.binary())], names=names)
        if kind is not None and len(at := np.flatnonzero(total)):
            # what the model learns from this partition, in a row without an id
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=names)

    held = checkpointed(rows.mapInArrow(read, f"id {kind}, {SCHEMA}"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cells, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["cell", "n"])

    model = prose.fit_rows(held.where("id is null").select("classes", "lines").mapInArrow(unpack, "cell long, n long"))
    return Pages(held.where("id is not null"), model)


class Judged:
    """Lines of several pages at once: ``lines`` holds their records one after the other, ``page`` the page of each."""

    def __init__(self, model: prose.ProseModel, langs: pa.Array, classes: pa.Array, records: pa.Array):
        codes = np.frombuffer(b"".join(classes.to_pylist()), np.uint8).astype(np.int64)
        sizes = np.array([len(r) // LINE.itemsize for r in records.to_pylist()], np.int64)
        self.lines = np.frombuffer(b"".join(records.to_pylist()), LINE)
        self.page = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.flatnonzero(codes == prose.EOL)
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.lang = lang = np.array(langs, np.int64)[self.page]
        read = prose.Lines([], codes, starts, ends, np.repeat(lang, ends - starts + 1))
        loss, length = model.line_losses(read)
        self.excess = loss - model.mean[lang]
        #: Standard errors of prose of this length.
        self.error = model.spread[lang] / np.sqrt(length)

    def has(self, name: str) -> np.ndarray:
        return (self.lines["flags"] & FLAGS[name]) != 0

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by page."""
        return np.bincount(self.page, values, minlength=len(self.first) - 1)
