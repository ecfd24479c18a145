"""Text that was decoded with the wrong encoding.

Every distinct clean word of the corpus (an accented or typographically marked word, a lone mark, a pair of neighbouring Han
characters) is sent through every encoding chain; the garbled forms make a table. Tokens and pieces of pages that hold unusual
characters are joined with that table by hash. A hit that isn't quoted marks the page; runs whose pieces are verified by the table
are decoded back along the chain that the hits name. Replacement characters and the residue of a second lossy round mark damage
that can't be undone.

Neither the vocabulary nor the table is collected or broadcast; both are partial aggregates, joined by shuffle. Words seen on fewer than
``min_pages`` pages prove only forms that are longer than they are, so that one damaged page doesn't prove its own words.

Null and empty texts are never cases, rows with a null id are kept out, repeated rows count once, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code pages by which bytes are misread; undefined bytes of the first stay control characters, as in browsers.
SINGLE_BYTE = ("cp1252", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8_r", "iso8859_15", "iso8859_2", "latin1")
MULTI_BYTE = ("gbk", "big5", "shift_jis", "euc_kr")
REPLACED = "�"
#: Left by replacement characters that were written as UTF-8 and read as GBK.
RESIDUE = re.compile("锟斤拷|锟斤|斤拷锟|烫烫烫|屯屯屯")


@cache
def byte_table(codec: str) -> str:
    """The 256 characters of a single-byte code page; bytes without one keep their own number."""
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))


@cache
def _decode_map(codec: str) -> dict[int, str]:
    return {b: c for b, c in enumerate(byte_table(codec)) if ord(c) != b}


@cache
def _encode_map(codec: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(byte_table(codec))))}


def misread(data: bytes, codec: str) -> str:
    if codec in SINGLE_BYTE:
        return data.decode("latin1").translate(_decode_map(codec))
    return data.decode(codec, "replace")


def unread(text: str, codec: str) -> bytes | None:
    """The bytes that were misread as ``text``; None if the code page can't have given it."""
    if codec in SINGLE_BYTE:
        table = _encode_map(codec)
        try:
            return bytes([table[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


#: name -> steps (written as, read as), applied in order
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    **{f"utf8>{c}": (("utf8", c),) for c in SINGLE_BYTE + MULTI_BYTE},
    "utf8>cp1252>utf8>cp1252": (("utf8", "cp1252"),) * 2,
    "utf8>cp1252 x3": (("utf8", "cp1252"),) * 3,
    "utf8>cp1251>utf8>cp1251": (("utf8", "cp1251"),) * 2,
    "utf8>gbk>utf8>gbk": (("utf8", "gbk"),) * 2,
    **{f"gbk>{c}": (("gbk", c),) for c in ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "big5", "euc_kr", "shift_jis")},
    "gbk>cp1252>utf8>cp1252": (("gbk", "cp1252"), ("utf8", "cp1252")),
    **{f"cp1252>{c}": (("cp1252", c),) for c in ("cp1251", "cp1250", "cp437", "cp850", "mac_roman", "gbk", "big5", "koi8_r", "iso8859_2", "latin1")},
    **{f"mac_roman>{c}": (("mac_roman", c),) for c in ("cp1252", "cp437")},
    **{f"{c}>cp1252": ((c, "cp1252"),) for c in ("cp437", "cp850")},
    "big5>cp1252": (("big5", "cp1252"),),
    "big5>gbk": (("big5", "gbk"),),
}


#: Chains that can write Han text.
HAN_CHAINS = tuple(k for k, steps in CHAINS.items() if steps[0][0] in ("utf8", "gbk", "big5"))


def garble(word: str, chain: str) -> str | None:
    """The word as it looks after the chain; None where the chain leaves it as it is or can't write it."""
    text = word
    for written, read in CHAINS[chain]:
        try:
            text = misread(text.encode(written), read)
        except UnicodeEncodeError:
            return None
    return text if text != word else None


def ungarble(text: str, chain: str) -> str | None:
    """The text before the chain; None where it can't have come out of the chain."""
    for written, read in reversed(CHAINS[chain]):
        data = unread(text, read)
        if data is None:
            return None
        try:
            text = data.decode(written)
        except UnicodeDecodeError:
            return None
    return text


# Characters that clean text of the corpus' languages is made of, besides ASCII and Han.
_LETTERS = "àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿßÀÂÄÁÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖØŒÚÙÛÜÝŸ"
_MARKS = "’‘“”„‚«»‹›…—–·•°©®™€£¥§¿¡→←↑↓★☆№℃º²³½¼¾× ­​  ﻿　"
_CJK = "，。、；：？！（）《》〈〉「」『』【】〔〕～—…·“”‘’￥％＋－＝／＠０-９Ａ-Ｚａ-ｚ"
#: Every character of ``_LETTERS`` that never stands for a misread lead byte in practice is safe by itself; the marks aren't.
SAFE = "àäáçéèêëíìîïñóòôöœúùûüßÀÄÇÉÊÖÜÚÁÍÓÑ’‘“”„«»›…—–·•©£°¿¡→↑　"
UNSAFE = re.compile(rf"[^\x00-\x7f{SAFE}{_CJK}一-鿿]|[A-Za-z][一-鿿]+[A-Za-z ]|[ÃÂâÎÐÑÄÅ][^\x00-\x7f]")
PLAUSIBLE = re.compile(rf"[A-Za-z{_LETTERS}{_MARKS}{_CJK}一-鿿]+")
#: ASCII letters and everything beyond ASCII, with at least one of the latter.
RUN = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
HAN_CHAR = re.compile("[一-鿿]")
HAN_TEXT = re.compile("[一-鿿，。、：；“”！？]+")
QUOTES = {"“": "”", "「": "」", "『": "』", '"': '"', "‘": "’", "«": "»", "„": "“", "《": "》", "`": "`"}


@cache
def _pair_pattern(codec: str) -> re.Pattern:
    """Two three-byte characters of UTF-8, misread by a single-byte code page."""
    t = byte_table(codec)
    cls = lambda a, b: "[" + "".join(map(re.escape, t[a:b])) + "]"
    lead, more = cls(0xE2, 0xF0), cls(0x80, 0xC0)
    return re.compile(f"(?=({lead}{more}{{2}}{lead}{more}{{2}}))")


@cache
def _run_pattern(codec: str) -> re.Pattern:
    """Bytes of GBK misread by a single-byte code page: four or more bytes that all are above A0."""
    return re.compile("[" + "".join(map(re.escape, byte_table(codec)[0xA1:0xFF])) + "]{4,}")


def clean_words(text: str) -> set[str]:
    """Words that show a misreading: marked words, and neighbouring pairs of Han text."""
    out: set[str] = set()
    for run in RUN.findall(text):
        if HAN_CHAR.search(run) is None:
            out.add(run)
            continue
        for part in HAN_TEXT.findall(run):
            out.update(map(add, part, part[1:]))
        for part in HAN_TEXT.split(run):
            if part and not part.isascii():
                out.add(part)
    return out


def _quoted(text: str, start: int, end: int) -> bool:
    for gap in (0, 1):  # French marks stand off by a space
        before, after = text[max(0, start - 1 - gap) : start], text[end : end + 1 + gap]
        if before and after and QUOTES.get(before[0]) == after[-1] and not (before[1:] + after[:-1]).strip():
            return True
    first, last = text[start], text[end - 1]
    return end - start > 2 and QUOTES.get(first) == last


def suspects(text: str) -> tuple[set[str], bool]:
    """Tokens and pieces that may be garbled, and whether the text holds unquoted damage that can't be undone."""
    found: set[str] = set()
    lossy = False
    han_damage = False
    if "锟" in text or "烫" in text or "屯" in text:
        lossy = any(not _quoted(text, m.start(), m.end()) for m in re.finditer(rf"(?:{RESIDUE.pattern})+", text))
    mixed = UNSAFE.search(text) is not None
    if own := len(text) - len(HAN_CHAR.sub("", text)):
        # Han text written as UTF-8 and read as GBK gives valid UTF-8 back, which clean Han text hardly ever does
        back = text.encode("gbk", "ignore").decode("utf8", "ignore")
        han_damage = len(back) - len(HAN_CHAR.sub("", back)) > 0.2 * own
    if not mixed and not han_damage:
        return found, lossy
    for m in RUN.finditer(text):
        run = m.group()
        if REPLACED in run and not _quoted(text, m.start(), m.end()):
            lossy = True
        if not (UNSAFE.search(run) or han_damage):
            continue
        if _quoted(text, m.start(), m.end()):
            continue
        found.add(run)
        for inner in re.finditer(r"[^“”「」『』«»\"]+", run):
            if _quoted(text, m.start() + inner.start(), m.start() + inner.end()):
                continue
            found.add(inner.group())
        if len(run) >= 4:
            for codec in ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "koi8_r"):
                found.update(_pair_pattern(codec).findall(run))
            for codec in ("cp1252", "cp1251", "mac_roman", "cp437", "cp850"):
                for high in _run_pattern(codec).findall(run):
                    found.update(high[k : k + 4] for k in range(0, len(high) - 3, 2))
            if han_damage or any("一" <= c for c in run):
                found.update(run[k : k + n] for n in (2, 3) for k in range(len(run) - n + 1) if run[k] > "⹿")
    return found, lossy


def vocabulary(pages: DataFrame, text: str) -> DataFrame:
    """(word, pages): each clean word and the number of pages that hold it, counted map-side first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body and not body.isascii():
                    total.update(clean_words(body))
            if len(total) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], names=["word", "pages"])
                total.clear()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], names=["word", "pages"])

    return pages.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "word string, pages long").groupBy("word").agg(F.sum("pages").alias("pages"))


def garbled_forms(words: DataFrame) -> DataFrame:
    """(garbled, original, chain): every clean word in every chain, words of a single page too; forms that might be clean text themselves left out."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                if PLAUSIBLE.fullmatch(word) is None:
                    continue
                han = len(word) == 2 and any("一" <= c <= "鿿" for c in word)
                if not han and any(
                    (back := ungarble(word, chain)) and back != word and len(back) < len(word) and PLAUSIBLE.fullmatch(back)
                    for chain in ("utf8>cp1252", "utf8>cp850", "utf8>mac_roman", "utf8>gbk", "utf8>iso8859_15")
                ):
                    continue  # a garbled word that several pages share
                for chain in HAN_CHAINS if han else CHAINS:
                    if (form := garble(word, chain)) and not form.isascii() and (len(form) > 1 or form not in _LETTERS + _MARKS) and not (len(form) == 1 and "一" <= form <= "鿿"):
                        # a form that could be clean text proves nothing
                        if UNSAFE.search(form) or any("一" <= c <= "鿿" for c in form):
                            out.append((form, word, chain))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["garbled", "original", "chain"])

    return words.select("word").mapInArrow(forms, "garbled string, original string, chain string")


def verified(pages: DataFrame, page_id: str, text: str, min_pages: int) -> DataFrame:
    """(id, garbled, original, chain, lossy): suspect tokens of each page that the table knows, and a row without a chain for damage that
    can't be undone. One pass over the texts finds the tokens."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(text).alias("body")).where("id is not null and body is not null")
    kind = dict(rows.dtypes)["id"]
    words = vocabulary(rows, "body")
    table = garbled_forms(words)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, where, lost = [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                if body and not body.isascii():
                    found, lossy = suspects(body)
                    pieces += found
                    where += [k] * len(found)
                    lost += [False] * len(found)
                    if lossy:
                        pieces.append(f"\0{k}")  # a token of its own, which no word gives, so that these rows spread
                        where.append(k)
                        lost.append(True)
            if where:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array(pieces, pa.string()), pa.array(lost)], names=["id", "garbled", "lossy"])

    tokens = rows.mapInArrow(split, f"id {kind}, garbled string, lossy boolean")
    # a word that the corpus itself uses as often as the original is no sign of damage
    known = words.where(F.col("pages") >= min_pages).select(F.col("word").alias("garbled"), F.col("pages").alias("own"))
    sized = table.join(words.withColumnRenamed("word", "original"), "original").join(known, "garbled", "left").where("own is null or own < pages")
    # of a word seen on fewer pages only a longer form proves damage: a form of the same length might as well be the original
    sized = sized.where((F.col("pages") >= min_pages) | (F.length("garbled") > F.length("original")))
    best = sized.groupBy("garbled").agg(F.max_by(F.struct("chain", "original"), F.struct("pages", "chain", "original")).alias("best"))
    return tokens.join(best, "garbled", "left").where("lossy or best is not null").select("id", "garbled", "best.original", "best.chain", "lossy")


def find_garbled(pages: DataFrame, page_id: str = "page_id", text: str = "content", min_pages: int = 2) -> DataFrame:
    """(id, chain, hits, lossy): one row per damaged page and chain; chain is null where only damage that can't be undone was seen."""
    hits = verified(pages, page_id, text, min_pages)
    return hits.groupBy("id", "chain").agg(F.count("original").alias("hits"), F.max("lossy").alias("lossy")).withColumnRenamed("id", page_id)


#: Chains tried, in this order, where single lines are repaired without a corpus at hand.
_COMMON = ("utf8>cp1252", "utf8>latin1", "utf8>iso8859_15", "utf8>cp1252>utf8>cp1252", "utf8>cp1251", "utf8>mac_roman", "utf8>gbk", "utf8>cp437", "utf8>cp850", "gbk>cp1252", "gbk>cp1251", "gbk>mac_roman", "gbk>big5", "big5>cp1252", "gbk>cp437")
WRECK = re.compile(rf"[^\x00-\x7f{_LETTERS}{_CJK}’‘“”„«»‹›…—–·•©£°¿¡→↑€　一-鿿]")


def wreckage(text: str) -> int:
    """Number of characters that clean text of the corpus' languages doesn't hold."""
    return 0 if text.isascii() else len(WRECK.findall(text))


def repaired(text: str) -> str:
    """The text with every line that a whole chain undoes without rest put right; other operators read damaged pages through it."""
    if text.isascii() or UNSAFE.search(text) is None:
        return text
    out = []
    for line in text.split("\n"):
        if not line.isascii() and UNSAFE.search(line):
            for chain in _COMMON:
                back = ungarble(line, chain)
                if back is not None and len(back) < len(line) and "\n" not in back and WRECK.search(back) is None:
                    line = back
                    break
        out.append(line)
    return "\n".join(out)


def softly_repaired(text: str) -> str:
    """``repaired``, and lines that lost bytes in a multi-byte code page read back as far as they go; their lost characters are dropped."""
    return softened(repaired(text))


def softened(text: str) -> str:
    """The second step of ``softly_repaired`` alone; lines stay lines."""
    if REPLACED not in text:
        return text
    out = []
    for line in text.split("\n"):
        if REPLACED in line:
            for codec in ("gbk", "big5"):
                back = line.encode(codec, "ignore").decode("utf8", "ignore")
                if 2 * (len(back) - len(HAN_CHAR.sub("", back))) > len(back.replace(" ", "")) and 3 * len(back) > len(line) and "\n" not in back:
                    line = back
                    break
        out.append(line)
    return "\n".join(out)


def undone(text: str, chains: list[str], originals: dict[str, str]) -> str:
    """The text with its damage put right: lines that one of the page's verified chains undoes as a whole; else runs and pieces of them
    that the table knows, by their originals; else runs that such a chain undoes without an odd character. Everything else stays."""
    pieces = sorted((g for g in originals if len(g) > 1), key=len, reverse=True)

    def back(piece: str) -> str | None:
        for chain in chains:
            found = ungarble(piece, chain)
            if found is not None and found != piece and "\n" not in found and WRECK.search(found) is None:
                return found
        return None

    def run(m: re.Match) -> str:
        whole = m.group()
        if _quoted(m.string, m.start(), m.end()):
            return whole
        found = originals.get(whole) or back(whole)
        if found is None:
            found = whole
            for g in pieces:
                if g in found:
                    found = found.replace(g, originals[g])
        return found

    out = []
    for line in text.split("\n"):
        if not line.isascii():
            whole = back(line) if UNSAFE.search(line) else None
            line = whole if whole is not None and len(whole) < len(line) else RUN.sub(run, line)
        out.append(line)
    return "\n".join(out)


def restored(pages: DataFrame, page_id: str = "page_id", text: str = "content", min_pages: int = 2) -> DataFrame:
    """(id, text, changed): the damaged pages with their text put right as far as the table's originals and chains reach; one row per
    distinct id and text."""
    hits = verified(pages, page_id, text, min_pages).where("chain is not null")
    by_chain = hits.groupBy("id", "chain").agg(F.count("*").alias("hits"), F.collect_set(F.struct("garbled", "original")).alias("pairs"))
    found = by_chain.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("hits")).alias("h"), "chain"))).alias("c"), F.flatten(F.collect_list("pairs")).alias("pairs"))
    found = found.select("id", F.transform("c", lambda x: x["chain"]).alias("chains"), F.transform("pairs", lambda x: x["garbled"]).alias("garbled"), F.transform("pairs", lambda x: x["original"]).alias("originals"))
    rows = pages.select(F.col(page_id).alias("id"), F.col(text).alias("body")).where("id is not null and body is not null").join(found, "id").select("id", "body", "chains", "garbled", "originals")
    kind = dict(rows.dtypes)["id"]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(1).to_pylist()
            after = [undone(b, c, dict(zip(g, o, strict=True))) for b, c, g, o in zip(before, *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(after, pa.string()), pa.array([a != b for a, b in zip(after, before, strict=True)])], names=["id", "body", "changed"])

    return rows.mapInArrow(repair, f"id {kind}, body string, changed boolean").distinct().withColumnRenamed("id", page_id).withColumnRenamed("body", text)
