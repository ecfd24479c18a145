"""Personal information in free text: e-mail addresses, phone numbers, identity numbers, street addresses, names.

Bootstrapped contextual extraction. A first pass over all texts collects candidate instances with the words around them. Seeds
(the known name parts; values whose form allows one kind only) say which contexts belong to which kind; contexts then vouch for
unknown parts and for values whose form allows several kinds; Spark scores this graph of patterns and instances for some rounds.
A second pass finds all occurrences with the lexicon and the patterns learned.

A pattern or part is kept with a fixed number of occurrences behind it (``least_value``, ``least_pattern_n``, ``least_part``,
``least_han``), whatever the size of the corpus, so that no document loses a value because others were added. What is learned is
collected and sent to every worker; it grows with the different contexts and name parts of the corpus and is not bounded.

Null and empty texts hold nothing, rows with a null id are kept out, repeated rows count once, other columns are ignored. Positions
are 1-based code points of the text as given.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

_FULL = str.maketrans({0xFF10 + d: str(d) for d in range(10)} | {"＋": "+", "（": "(", "）": ")", "－": "-", "＠": "@", "．": ".", " ": " ", "‑": "-", "‐": "-", " ": " ", "　": " "})

_WIDE = re.compile("[" + "".join(map(chr, _FULL)) + "]")


def narrowed(text: str) -> str:
    """The text with full-width digits and marks, and odd spaces and hyphens, as plain ones; of the same length."""
    return text.translate(_FULL) if not text.isascii() and _WIDE.search(text) else text


# ---- e-mail -------------------------------------------------------------------------------------------------------------------
_AT = r"(?:\s?@\s?|\s?[\(\[{]\s?(?:at|AT|At)\s?[\)\]}]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?[\(\[{]\s?(?:dot|DOT|Dot)\s?[\)\]}]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+-])(?P<local>[A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9_])?)(?P<at>{_AT})(?P<domain>(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?{_DOT})+[A-Za-z]{{2,24}})(?![A-Za-z0-9])", re.ASCII)

_BRACKETED_AT = re.compile(r"[\(\[{]\s?(?:at|AT|At)\s?[\)\]}]")

# ---- identity numbers ---------------------------------------------------------------------------------------------------------
_B, _E = r"(?<![\w.+#/-])", r"(?![\w]|[-./]\d)"
IDS = [
    ("cn", re.compile(r"(?<!\d)\d{6} ?\d{8} ?\d{3}[\dXx](?![\dA-Za-z])")),
    ("ssn", re.compile(rf"{_B}\d{{3}}([- ])\d{{2}}\1\d{{4}}{_E}")),
    ("nino", re.compile(rf"{_B}[A-Z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-D]{_E}")),
    ("tax", re.compile(rf"{_B}\d{{2}} \d{{3}} \d{{3}} \d{{3}}{_E}")),
    ("dni", re.compile(rf"{_B}\d{{2}}\.?\d{{3}}\.?\d{{3}}[- ]?[A-Za-z]{_E}")),
    ("nie", re.compile(rf"{_B}[XYZxyz][- ]?\d{{7}}[- ]?[A-Za-z]{_E}")),
    ("nir", re.compile(rf"{_B}[12] ?\d{{2}} ?\d{{2}} ?(?:\d{{2}}|2[AB]) ?\d{{3}} ?\d{{3}}(?: ?\d{{2}})?{_E}")),
]
_CN_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]


def chinese_id(value: str) -> bool:
    """Check digit and date of an eighteen-digit identity number."""
    s = value.replace(" ", "").upper()
    return len(s) == 18 and "1" <= s[10:12].lstrip("0")[:1] and 1 <= int(s[10:12]) <= 12 and 1 <= int(s[12:14]) <= 31 and "10X98765432"[sum(int(a) * b for a, b in zip(s[:17], _CN_WEIGHTS, strict=True)) % 11] == s[17]


#: What every identity and phone number holds: six places of digits and marks between them.
_LONG_NUMBER = re.compile(r"\d[\d().\-+ /]{4,}\d")

# ---- phone numbers ------------------------------------------------------------------------------------------------------------
_NUMBER = re.compile(r"(?<![\w.@/§#+-])(?:\(?\+ ?\d|\(\d|\d)[\d().\- /]*\d(?![A-Za-z0-9_])|(?<=[一-鿿：])(?:\(?\+\d|\(\d|\d)[\d()\-  ]*\d(?![\dA-Za-z])")
_NATIONAL = re.compile(
    r"\(?(?:\+|00)[1-9][\d().\- /]{6,22}\d"  # international
    r"|(?:1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}|1[2-9]\d{2}[2-9]\d{6}|[2-9]\d{2}[2-9]\d{2}\d{4}"  # North America
    r"|0\d{2,4}[ ]?\d{3,4}[ ]?\d{3,4}"  # United Kingdom
    r"|\(?0\d{2,4}\)?[ /-]{0,3}\d{3,8}(?:[ -]\d{1,4})?"  # Germany
    r"|0[1-9](?:[ .-]?\d{2}){4}"  # France
    r"|[6-9]\d{2}(?:[ .-]?\d{3}){2}|[6-9]\d{2}(?:[ .-]\d{2}){3}"  # Spain
    r"|1[3-9]\d(?:[ -]?\d{4}){2}|\(?0\d{2,3}\)?[ -]?\d{4}[ -]?\d{4}"  # China
)
# Words before a number that make it something else than a phone or identity number.
NOT_PERSONAL = re.compile(r"(?:ISBN|ISSN|DOI|doi:?|书号|订单号?|单号|编号|版本|order(?: no\.?| number)?|invoice|ticket|tracking|SKU|version|p\.|pp\.|page|§|#|№|v|备案号)[\s:：#.\-]*$", re.IGNORECASE)
_DATE = re.compile(r"(?:19|20)\d{2}([-./ ])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2(?:19|20)?\d{2}")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_THOUSANDS = re.compile(r"\d{1,3}(?:[. ]\d{3})+")
_YEARS = re.compile(r"(?:1[5-9]|20)\d{2}\s?[-–/]\s?(?:1[5-9]|20)\d{2}")

# ---- addresses ----------------------------------------------------------------------------------------------------------------
# Words for streets and places in five languages.
_EN_STREET = "Street|St|Road|Rd|Row|Avenue|Ave|Terrace|Ter|Lane|Ln|Drive|Dr|Court|Ct|Close|Place|Pl|Square|Sq|Way|Crescent|Cres|Boulevard|Blvd|Gardens|Grove|Hill|Mews|Walk|Parade|Park|Yard|Quay"
_DE_STREET = "straße|strasse|str\\.|weg|pfad|platz|allee|gasse|ring|damm|ufer|steig|stieg|hof|markt|chaussee|graben|wall"
_FR_STREET = "rue|avenue|av\\.|chemin|allée|place|boulevard|bd|impasse|quai|route|cours|passage|square|sentier|ruelle|venelle|faubourg|esplanade"
_ES_STREET = "Calle|C/|Plaza|Pza\\.|Avenida|Avda\\.|Av\\.|Paseo|Pº|Camino|Carrera|Ronda|Travesía|Callejón|Glorieta|Rambla|Cuesta|Carretera"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
ADDRESSES = [
    re.compile(rf"(?<![\w-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|FLAT|APT)\s\w{{1,4}},?\s)?\d{{1,5}}[A-Za-z]?,?\s(?:(?:{_CAP})\s){{1,3}}(?:{_EN_STREET})\b\.?(?:(?:,\s|\s)(?:Apt\.?|Flat|Unit|Suite|#)\s?\w{{1,5}})?(?:,\s{_CAP}(?:\s{_CAP})?)?(?:,?\s\d{{5}})?"),
    re.compile(rf"(?<![\w.])(?:P\.?\s?O\.?\s?Box|Postfach|Apartado(?:\sde\sCorreos)?|BP|Boîte\spostale)\s\d{{1,6}}(?:,\s{_CAP})?(?:\s\d{{5}})?", re.IGNORECASE),
    re.compile(rf"(?<![\w-])(?:{_CAP}\s)?[A-ZÄÖÜ][a-zäöüß-]*(?:{_DE_STREET})\s\d{{1,4}}\s?[a-z]?\b(?:(?:,\s(?:\d{{5}}\s)?|\sin\s){_CAP})?"),
    re.compile(rf"(?<![\w-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s(?:{_FR_STREET})\s(?:(?:de|du|des|la|le|les|d’|l’|d'|l')\s?)*{_CAP}(?:[\s-]{_CAP})*(?:,?\s(?:à\s)?(?:\d{{5}}\s)?{_CAP})?"),
    re.compile(rf"(?<![\w-])(?:{_ES_STREET})\s?(?:(?:de|del|la|las|los|el)\s)*{_CAP}(?:\s{_CAP})?,?\s(?:n\.?\s?[ºo°]\.?\s?)?\d{{1,4}}(?:,\s\d{{1,2}}\.?\s?[ºª°](?:\s[A-Z])?)?(?:,\s{_CAP})?"),
    re.compile(rf"(?<![\w-])(?:{_FR_STREET})\s(?:(?:de|du|des|la|le|les|d’|l’)\s?)*{_CAP},?\s\d{{1,4}}\b"),
]
_HAN_ADDRESS = re.compile(r"(?:[一-鿿]{2,3}?省)?(?:[一-鿿]{2}市|[一-鿿]{3}市)?(?:[一-鿿]{2}[区县]|[一-鿿]{3}[区县])?[一-鿿]{2,3}?(?:路|街|巷|大道|胡同|弄|里)\d{1,5}号(?:[附之]?\d+[号栋幢座楼室]|\d+单元|\d+室|附\d+号)*")
# Characters that lead to an address but don't belong to it.
_HAN_LEAD = "在到住往至于去寄发送从是居家址为：:"

# ---- names --------------------------------------------------------------------------------------------------------------------
_W = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿß]+|[A-ZÀ-ÖØ-Þ]{2,}ẞ?[A-ZÀ-ÖØ-Þ]*)"
_I = r"[A-ZÀ-ÖØ-Þ]\."
LATIN = re.compile(
    rf"(?<![A-Za-zÀ-ÿ0-9_@./+’'-])(?=(?P<f1>{_W}),\s(?P<g1>{_W}(?:-{_W})?)(?![A-Za-zÀ-ÿ0-9_@’'+-])|(?P<g2>{_W}(?:-{_W})?)(?P<i2>(?:\s{_I})*)\s(?P<f2>{_W})(?![A-Za-zÀ-ÿ0-9_@’'+-])|(?P<i3>{_I}(?:\s?{_I})*)\s?(?P<f3>{_W})(?![A-Za-zÀ-ÿ0-9_@’'+-]))"
)
LATIN_LOWER = re.compile(r"(?<![A-Za-zÀ-ÿ0-9_@./+’'-])(?=(?P<g>[a-zà-öø-ÿß]{2,}(?:-[a-zà-öø-ÿß]{2,})?)\s(?P<f>[a-zà-öø-ÿß]{3,})(?![A-Za-zÀ-ÿ0-9_@’'+-]))|(?<![A-Za-zÀ-ÿ0-9_@./+’'-])(?=(?P<f4>[a-zà-öø-ÿß]{3,}),\s(?P<g4>[a-zà-öø-ÿß]{2,}(?:-[a-zà-öø-ÿß]{2,})?)(?![A-Za-zÀ-ÿ0-9_@’'+-]))")
_LOWER_PART = re.compile("[a-zà-öø-ÿß]{2,}")
_CONTEXT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|Herr|Frau|Sr|Sra|Srta|Don|Doña"
_TITLE = re.compile(rf"(?:{_TITLES}|M)\.?\s$", re.IGNORECASE)
_TITLE_SET = set(_TITLES.lower().split("|"))


def words_before(text: str, at: int) -> str:
    """The two words or marks before a place, lower-cased, numbers as #; titles are passed over."""
    piece = text[max(0, at - 48) : at]
    piece = _TITLE.sub("", piece)
    found = _CONTEXT.findall(piece)[-2:]
    return " ".join("#" if w[0].isdigit() else w.lower() for w in ["^"] * (2 - len(found)) + found)


def words_after(text: str, at: int) -> str:
    found = _CONTEXT.findall(text[at : at + 48])[:2]
    return " ".join("#" if w[0].isdigit() else w.lower() for w in found + ["$"] * (2 - len(found)))


#: A context whose nearest word is a real word or an opening mark says more than a line end or a full stop.
SPEAKING = re.compile(r"(?s)L:.*(?:[^\W\d_]{2,}|[:—(<@])$|R:(?:[^\W\d_]{2,}|[;<@/’]).*")
GENERIC_WEIGHT = 0.35


class Finder:
    """Values of one text. ``contexts`` gives the kind that a learned context vouches for, by pattern."""

    def __init__(self, contexts: dict[str, str] | None = None):
        self.contexts = contexts or {}

    def structural(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, form) of everything but names, without overlaps; kind ``?`` where the form allows two kinds."""
        plain = narrowed(text)
        spans: list[tuple[int, int, str, str]] = []
        taken: list[tuple[int, int]] = []

        def free(a: int, b: int) -> bool:
            return not any(a < y and x < b for x, y in taken)

        def add(a: int, b: int, kind: str, form: str) -> None:
            spans.append((a, b, kind, form))
            taken.append((a, b))

        at = 0
        # "at" as a word needs "dot" as a word, so most texts needn't be searched
        spelled = "@" in plain or _BRACKETED_AT.search(plain) is not None or "dot" in plain or "DOT" in plain or "Dot" in plain
        while spelled and (m := EMAIL.search(plain, at)):
            if m["at"].strip().isalpha() and re.search(_DOT, m["domain"].replace(".", "")) is None:
                at = m.end("at")  # an address may begin behind it
                continue
            add(*m.span(), "email", "email")
            at = m.end()
        if re.search(r"\d", plain) is None:
            return spans
        for pattern in ADDRESSES:
            for m in pattern.finditer(plain):
                if free(*m.span()):
                    add(*m.span(), "address", "address")
        if "号" in plain:
            for m in _HAN_ADDRESS.finditer(plain):
                a, b = m.span()
                while plain[a] in _HAN_LEAD and a < b:
                    a += 1
                if free(a, b):
                    add(a, b, "address", "address")
        if _LONG_NUMBER.search(plain) is None:
            return sorted(spans)
        for form, pattern in IDS:
            for m in pattern.finditer(plain):
                a, b = m.span()
                if not free(a, b) or NOT_PERSONAL.search(plain[max(0, a - 16) : a]):
                    continue
                if form == "cn":
                    if not chinese_id(m.group()):
                        continue
                elif form == "dni" and m.group()[-1].islower() and plain[b - 2] == " ":
                    continue
                add(a, b, "id_number", form)
        for m in _NUMBER.finditer(plain):
            a, b = m.span()
            for part in self._numbers(plain, a, b):
                if free(part[0], part[1]):
                    add(*part)
        return sorted(spans)

    def _numbers(self, plain: str, a: int, b: int) -> Iterator[tuple[int, int, str, str]]:
        value = plain[a:b]
        if NOT_PERSONAL.search(plain[max(0, a - 16) : a]) or _IP.fullmatch(value) or _DATE.match(value) or _YEARS.match(value):
            return
        digits = sum(c.isdigit() for c in value)
        if digits < 8 or plain[b : b + 1] in "%€$£" and b < len(plain):
            return
        best = max((m.end() for p in (_NATIONAL,) if (m := p.match(value))), default=0)
        if not best:
            return
        # the longest alternative that ends at a boundary
        for end in range(len(value), 7, -1):
            if (end == len(value) or not (value[end].isdigit() or value[end - 1] in " .-/(")) and value[end - 1].isdigit() and _NATIONAL.fullmatch(value[:end]):
                best = end
                break
        else:
            return
        found = value[:best]
        n = sum(c.isdigit() for c in found)
        if not 8 <= n <= 15 or _THOUSANDS.fullmatch(found) and n % 3 != 0 and "." in found:
            return
        if found.count("(") != found.count(")"):
            if found[0] == "(" and ")" not in found:
                a, found = a + 1, found[1:]
            else:
                return
        if found.isdigit() and n == 11:
            kind = self.vouched(plain, a, a + len(found))
            if kind == "id_number":
                yield a, a + len(found), "id_number", "digits11"
                return
            yield a, a + len(found), "phone" if kind == "phone" or found[0] in "1" else "?", "digits11"
            return
        yield a, a + len(found), "phone", "phone"

    def vouched(self, text: str, a: int, b: int) -> str | None:
        return self.contexts.get("L:" + words_before(text, a)) or self.contexts.get("R:" + words_after(text, b))

    @staticmethod
    def names(text: str, seeds: set[str]) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, given, family, form) of everything shaped like a Latin name; parts lower-cased. Overlaps are kept."""
        for m in LATIN.finditer(text):
            if m["g2"] and m["g2"].lower() in _TITLE_SET or m["f1"] and m["f1"].lower() in _TITLE_SET:
                continue
            if m["f1"]:
                yield m.start(), m.end("g1"), m["g1"].lower(), m["f1"].lower(), "family,given"
            if m["f2"]:
                yield m.start(), m.end("f2"), m["g2"].lower(), m["f2"].lower(), "given family"
            if m["f3"]:
                yield m.start(), m.end("f3"), "", m["f3"].lower(), "initial family"
        if seeds.isdisjoint(_LOWER_PART.findall(text)):
            return
        for m in LATIN_LOWER.finditer(text):
            given, family = (m["g"], m["f"]) if m["g"] else (m["g4"], m["f4"])
            if family in seeds or any(g in seeds for g in given.split("-")):
                yield m.start(), m.end("f" if m["g"] else "g4"), given, family, "lower"


def han_candidates(text: str, surnames: re.Pattern) -> Iterator[tuple[str, str, str, str]]:
    """(surname, given name, two characters before, two after) at each known surname, and at each character that opens a run of Han."""
    for m in surnames.finditer(text):
        for n in (1, 2):
            end = m.end() + n
            if len(given := text[m.end() : end]) == n and all("一" <= c <= "鿿" for c in given):
                yield m.group(), given, text[max(0, m.start() - 2) : m.start()], text[end : end + 2]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def learn(documents: DataFrame, parts: DataFrame, text: str = "text", rounds: int = 3, least_value: int = 2, least_pattern_n: int = 3, least_part: int = 1, least_han: int = 3, least_pattern: float = 0.4) -> dict:
    """Patterns and name parts from the graph of contexts and candidates; all support is counted in occurrences, not in shares."""
    spark = documents.sparkSession
    known = parts.select(F.lower(F.trim("name_part")).alias("part"), F.lower(F.trim("name_kind")).alias("kind")).where("part is not null and part <> '' and kind in ('given', 'family')").distinct()
    seeds = {(r.part, r.kind) for r in known.collect()}  # a fixed list of known parts, some hundreds
    seed_parts = {p for p, _ in seeds if p.isascii() or not re.match("[一-鿿]", p)}
    surnames = sorted({p for p, k in seeds if k == "family" and re.fullmatch("[一-鿿]{1,2}", p)}, key=len, reverse=True)
    known_surnames = set(surnames)
    surname_pattern = re.compile("|".join([*map(re.escape, surnames), r"(?<![一-鿿])[一-鿿](?=[一-鿿]{1,2})"]))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            rows: dict[tuple, int] = {}
            for body in batch.column(0).to_pylist():
                spans = finder.structural(body)
                for a, b, kind, form in spans:
                    if kind in ("phone", "id_number", "?"):
                        for side, context in (("L", words_before(body, a)), ("R", words_after(body, b))):
                            key = ("value", kind, form, f"{side}:{context}", "")
                            rows[key] = rows.get(key, 0) + 1
                for a, b, given, family, form in finder.names(body, seed_parts):
                    if not any(a < y and x < b for x, y, *_ in spans):
                        key = ("name" if form != "lower" else "lower", given, family, "L:" + words_before(body, a), "R:" + words_after(body, b))
                        rows[key] = rows.get(key, 0) + 1
                for surname, given, left, right in han_candidates(body, surname_pattern):
                    key = ("han" if surname in known_surnames else "han?", surname, given, left, right)
                    rows[key] = rows.get(key, 0) + 1
            if rows:
                yield _batch([(*k, n) for k, n in rows.items()], ["what", "a", "b", "left", "right", "n"], [pa.string()] * 5 + [pa.int64()])

    found = documents.select(F.col(text).alias("body")).where("body is not null").mapInArrow(collect, "what string, a string, b string, left string, right string, n long")
    found = checkpointed(found.groupBy("what", "a", "b", "left", "right").agg(F.sum("n").alias("n")))

    # values of ambiguous form: which kind do their contexts belong to?
    values = found.where("what = 'value'").groupBy(F.col("left").alias("pattern")).agg(
        F.sum(F.when((F.col("a") == "id_number"), F.col("n")).otherwise(0)).alias("ids"), F.sum(F.when(F.col("a") == "phone", F.col("n")).otherwise(0)).alias("phones"), F.sum("n").alias("n"))
    contexts = {r.pattern: "id_number" if r.ids > 4 * r.phones else "phone" for r in values.where((F.col("n") >= least_value) & ((F.col("ids") > 4 * F.col("phones")) | (F.col("phones") > 4 * F.col("ids")))).collect()}

    # Latin names: each round scores the contexts by the parts known so far, then the parts by the contexts
    names = found.where("what = 'name'").select("a", "b", "left", "right", "n")
    given = {p: 1.0 for p, k in seeds if k == "given"}
    family = {p: 1.0 for p, k in seeds if k == "family"}
    patterns: dict[str, float] = {}
    context = spark.sparkContext
    for _ in range(rounds):
        sent = context.broadcast((given, family))

        def score_patterns(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            given, family = sent.value
            for batch in batches:
                sums: dict[str, list[float]] = {}
                for a, b, left, right, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    gs, fs = given.get(a.split("-")[0], 0.0), family.get(b, 0.0)
                    # an initial vouches for nothing by itself
                    positive = fs if not a else max(gs * fs, 0.6 * max(gs, fs))
                    for side in (left, right):
                        s = sums.setdefault(side, [0, 0.0, 0])
                        s[0] += n
                        s[1] += positive * n
                        s[2] += 1
                if sums:
                    yield _batch([(k, *v) for k, v in sums.items()], ["pattern", "n", "positive", "kinds"], [pa.string(), pa.int64(), pa.float64(), pa.int64()])

        scored = names.mapInArrow(score_patterns, "pattern string, n long, positive double, kinds long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"), F.sum("kinds").alias("kinds"))
        kept = scored.where((F.col("n") >= least_pattern_n) & (F.col("kinds") >= 3) & (F.col("positive") >= least_pattern * F.col("n")))
        patterns = {r.pattern: r.positive / r.n * (1.0 if SPEAKING.match(r.pattern) else GENERIC_WEIGHT) for r in kept.collect()}
        sent = context.broadcast((given, family, patterns))

        def score_parts(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            given, family, patterns = sent.value
            for batch in batches:
                sums: dict[tuple[str, str], list[float]] = {}
                for a, b, left, right, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    trust = 1 - (1 - patterns.get(left, 0.0)) * (1 - patterns.get(right, 0.0))
                    first = a.split("-")[0]
                    for key, other in ((("given", first), family.get(b, 0.0)), (("family", b), given.get(first, 0.0))):
                        if key[1]:
                            s = sums.setdefault(key, [0, 0.0])
                            s[0] += n
                            s[1] += n * trust * (0.7 + 0.3 * other)
                if sums:
                    yield _batch([(*k, *v) for k, v in sums.items()], ["kind", "part", "n", "votes"], [pa.string(), pa.string(), pa.int64(), pa.float64()])

        parts_now = names.mapInArrow(score_parts, "kind string, part string, n long, votes double").groupBy("kind", "part").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"))
        for r in parts_now.where((F.col("n") >= least_part) & (F.col("votes") >= 0.45 * F.col("n"))).collect():
            known_parts = given if r.kind == "given" else family
            known_parts[r.part] = max(known_parts.get(r.part, 0.0), min(0.95, r.votes / r.n))
    # Han names: a context is one of names if several surnames stand in it, none of which makes up most of it
    han = found.where("what = 'han'")

    def contexts_of(*by: str) -> DataFrame:
        each = han.groupBy(*by, "a").agg(F.sum("n").alias("n"))
        return each.groupBy(*by).agg(F.count("*").alias("surnames"), F.sum("n").alias("n"), F.max("n").alias("most")).where((F.col("surnames") >= 3) & (F.col("most") <= 0.6 * F.col("n")) & (F.col("n") >= least_han))

    pairs = contexts_of("left", "right").where("left <> '' and right <> ''").select("left", "right", "n")
    strong = pairs.where((F.col("n") >= 2 * least_han) & F.col("right").rlike("[一-鿿：，、/）]")).select("left", "right")
    inside = found.where("what in ('han', 'han?')").join(strong, ["left", "right"])
    fresh = inside.where("what = 'han?'").groupBy("a").agg(F.count_distinct("left", "right").alias("contexts"), F.count_distinct("b").alias("given")).where("contexts >= 2 and given >= 3")
    chars = inside.where("what = 'han'").select(F.explode(F.split("b", "")).alias("c"), "a").where("c <> ''").groupBy("c").agg(F.count_distinct("a").alias("n")).where("n >= 3")
    spoken = r"[一-鿿]{2}$|[一-鿿]：$"  # one side alone must hold words
    return {
        "contexts": contexts,
        "patterns": patterns,
        "given": given,
        "family": family,
        "han_pairs": sorted((r.left, r.right, r.n) for r in pairs.collect()),
        "han_lefts": {r.left: r.n for r in contexts_of("left").where((F.col("surnames") >= 5) & (F.col("most") <= 0.4 * F.col("n")) & F.col("left").rlike(spoken)).collect()},
        "han_rights": {r.right: r.n for r in contexts_of("right").where((F.col("surnames") >= 5) & (F.col("most") <= 0.4 * F.col("n")) & F.col("right").rlike(spoken)).collect()},
        "given_chars": sorted(r.c for r in chars.collect()),
        "surnames": sorted({*surnames, *(r.a for r in fresh.collect())}, key=len, reverse=True),
        "seeds": sorted(seed_parts),
    }


class Reader:
    """Finds every value of a text with what was learned."""

    def __init__(self, learned: dict):
        self.learned = learned
        self.finder = Finder(learned["contexts"])
        self.seeds = set(learned["seeds"]) | {p for p, score in (*learned["given"].items(), *learned["family"].items()) if score >= 0.65}
        self.surnames = re.compile("|".join(map(re.escape, learned["surnames"])) or r"(?!)")
        self.pairs = {(left, right): n for left, right, n in learned["han_pairs"]}
        self.lefts, self.rights = learned["han_lefts"], learned["han_rights"]
        self.given_chars = set(learned["given_chars"])

    def han_names(self, text: str) -> Iterator[tuple[int, int]]:
        """A known surname with one or two more characters in a learned context; the context seen most decides the length."""
        for m in self.surnames.finditer(text):
            a, first = m.start(), m.end()
            left = text[max(0, a - 2) : a]
            best = (0, False, 0)
            for n in (1, 2):
                b = first + n
                if b <= len(text) and all("一" <= c <= "鿿" for c in text[first:b]):
                    right = text[b : b + 2]
                    seen = max(self.pairs.get((left, right), 0), self.lefts.get(left, 0), self.rights.get(right, 0))
                    best = max(best, (seen, all(c in self.given_chars for c in text[first:b]), b))
            if best[0]:
                yield a, best[2]

    def values(self, text: str) -> list[tuple[int, int, str]]:
        spans = [(a, b, "phone" if kind == "?" else kind) for a, b, kind, _ in self.finder.structural(text)]
        people: list[tuple[float, int, int]] = []
        given, family, patterns = self.learned["given"], self.learned["family"], self.learned["patterns"]
        for a, b, g, f, form in self.finder.names(text, self.seeds):
            if any(a < y and x < b for x, y, _ in spans):
                continue
            gs = max((given.get(x, 0) for x in g.split("-")), default=0) if g else 0
            fs = family.get(f, 0)
            lt, rt = patterns.get("L:" + words_before(text, a), 0), patterns.get("R:" + words_after(text, b), 0)
            trust = 1 - (1 - lt) * (1 - rt)
            both = gs * fs if g else 0.0
            if form == "initial family":
                score = 0.9 * fs + 0.5 * trust
            elif form == "lower":
                score = both + (0.5 * trust if max(gs, fs) >= 0.9 else 0)
            else:
                score = max(both + 0.1 * trust, 0.45 * max(gs, fs) + 0.6 * trust, 0.7 * trust if lt and rt else 0.62 * trust)
            if score >= 0.55:
                people.append((min(score, 1.0) + 0.05 * (b - a), a, b))
        kept: list[tuple[int, int]] = []
        for _, a, b in sorted(people, reverse=True):
            if not any(a < y and x < b for x, y in kept):
                kept.append((a, b))
        for a, b in self.han_names(text):
            if not any(a < y and x < b for x, y, _ in spans) and not any(a < y and x < b for x, y in kept):
                kept.append((a, b))
        return sorted(spans + [(a, b, "person") for a, b in kept])


_readers: dict[str, Reader] = {}


def sent_out(documents: DataFrame, learned: dict):
    """What was learned, for all workers, under a digest of its own: workers keep the reader that they built as long as it is the same."""
    digest = hashlib.sha256(pickle.dumps(sorted(learned.items(), key=lambda x: x[0]))).hexdigest()
    return documents.sparkSession.sparkContext.broadcast((digest, learned))


def _reader(sent) -> Reader:
    digest, learned = sent.value
    if digest not in _readers:
        _readers.clear()
        _readers[digest] = Reader(learned)
    return _readers[digest]


def find_personal(documents: DataFrame, parts: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, kind, start_pos, end_pos): one row per occurrence; ``end_pos`` is the position of its last character."""
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).where("id is not null and body is not null")
    kind = dict(rows.dtypes)["id"]
    sent = sent_out(documents, learn(rows, parts, "body", **settings))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(sent)
        for batch in batches:
            where, out = [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                for a, b, what in reader.values(body):
                    where.append(k)
                    out.append((what, a + 1, b))
            if out:
                names = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array(names[0]), pa.array(names[1], pa.int64()), pa.array(names[2], pa.int64())], names=["id", "kind", "start_pos", "end_pos"])

    return rows.mapInArrow(read, f"id {kind}, kind string, start_pos long, end_pos long").distinct().withColumnRenamed("id", doc_id)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def mask_personal(documents: DataFrame, parts: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, masked text): every value replaced by its kind in brackets, the rest untouched; one row per distinct id and text."""
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).where("id is not null")
    kind = dict(rows.dtypes)["id"]
    sent = sent_out(documents, learn(rows.where("body is not null"), parts, "body", **settings))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(sent)
        for batch in batches:
            bodies = [None if t is None else masked(t, reader.values(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["id", "body"])

    return rows.mapInArrow(read, f"id {kind}, body string").distinct().withColumnRenamed("id", doc_id).withColumnRenamed("body", text)
