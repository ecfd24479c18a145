"""Titles of notes, as column expressions: tidying, shortening by a table of rules, and titles drawn from contents.

Each rule gives a candidate with bounds on its length; the first candidate inside its bounds is the title. Everything is evaluated by
Catalyst, in a few projections so that no expression is written out twice. Lengths count UTF-16 units. Null titles give null where a title
is only cleaned, and count as missing where one is drawn from the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, trimmed, utf16_length

# Nouns that may end the core of a title, Latin words that may end a title, marks of a cut sentence.
CORE_CONCEPTS = ["保护", "假设", "矛盾", "影响", "效应", "机制", "策略", "方法", "思维", "模式", "偏见", "误区", "功能", "限制", "优势", "劣势", "特点", "特征", "原理", "原则", "标准", "规范", "问题", "挑战", "风险", "机遇", "变化", "趋势", "后果", "意义", "价值", "Check", "Effect", "War", "API", "AI", "ML", "UX", "UI", "SDK"]
KNOWN_TERMS = ["AI", "ML", "UX", "UI", "API", "SDK", "OS", "CPU", "GPU", "RAM", "IO", "ID", "OK", "TV", "PC", "HR", "PR", "PM", "QA", "App", "Web", "Mac", "iOS", "Android", "Check", "Effect", "War", "Note", "Data", "Code", "Node", "Git", "HTTP", "JSON"]
FRAGMENTS = ["的如", "认为", "发现", "指出", "显示", "表明", "通过", "以及"]
WEAK_ENDING = "(?:的|如|和|与|或|对|在|被|将|把|了|着|吗|呢|啊|吧|么|[a-zA-Z]{1,2})"
CORE = rf"\A([^\n]{{0,6}})?([^\n]+?(?:{'|'.join(CORE_CONCEPTS)}))([^\n]{{0,8}})?\z"
#: Titles up to this length stay as they are.
LONG = 20

_HAN = "一-龥"
_LETTERS = r"[a-zA-Z]+\z"


def tidied(raw: Column) -> Column:
    """Without numbering, heading marks, bold marks, and separators at the front, or else at the end."""
    t = F.regexp_replace(trimmed(raw), rf"\A(?:[0-9]+[.、]{WHITE}*|[【(（]?[0-9]+[\]】)）]{WHITE}*|[①②③④⑤⑥⑦⑧⑨⑩]{WHITE}*)", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"\A#{{1,3}}{WHITE}*", ""), r"\A\*\*|\*\*\z", "")
    edge = rf"(?:[：:,，]|{WHITE})+"
    return F.when(t.rlike(rf"\A{edge}"), F.regexp_replace(t, rf"\A{edge}", "")).otherwise(F.regexp_replace(t, rf"{edge}\z", ""))


def is_good(title: Column) -> Column:
    """Four to 25 characters, no cut Latin word behind Han text, and no piece of a sentence."""
    t = trimmed(title)
    tail = F.regexp_extract(t, rf"({_LETTERS})", 1)
    known = F.exists(F.array(*map(F.lit, KNOWN_TERMS)), lambda k: F.endswith(tail, k))
    cut = t.rlike(f"[{_HAN}]") & (tail != "") & (F.length(tail) <= 5) & ~known
    piece = (utf16_length(t) > 12) & F.exists(F.array(*map(F.lit, FRAGMENTS)), lambda f: F.contains(t, f))
    return utf16_length(t).between(4, 25) & ~cut & ~piece


def safe_cut(text: Column, most: int = 18) -> Column:
    """At most ``most`` characters: cut between words, and without a weak word at the end."""
    head = F.substring(text, 1, most)
    to_word = F.regexp_extract(head, rf"(?s)\A(.*(?:[{_HAN}]|{WHITE}))[a-zA-Z]*\z", 1)
    no_word = F.coalesce(F.nullif(trimmed(F.regexp_replace(head, _LETTERS, "")), F.lit("")), F.substring(text, 1, 12))
    in_word = F.when(F.length(to_word) > 4, trimmed(to_word)).otherwise(no_word)
    strong = F.regexp_replace(trimmed(head), rf"{WEAK_ENDING}\z", "")
    least = trimmed(F.regexp_replace(F.substring(text, 1, 10), _LETTERS, ""))
    return F.when(utf16_length(text) <= most, text).when(head.rlike(_LETTERS), in_word).when(utf16_length(strong) >= 4, strong).otherwise(least)


def within(candidate: Column, least: int, most: int) -> Column:
    """The candidate, or null outside its bounds."""
    return F.when(utf16_length(candidate).between(least, most), candidate)


def shortened(rows: DataFrame, title: str, out: str) -> DataFrame:
    """Rows with the first candidate of the table of rules; the last rule always gives one."""
    topic = trimmed(F.regexp_extract(title, r"\A([^\n]+?)[：:–—]", 1))
    # a topic that is itself too long is shortened in the title's place
    rows = rows.withColumn("_title_topic", topic).withColumn("_title_w", F.when(utf16_length(F.col("_title_topic")) > 22, F.col("_title_topic")).otherwise(F.col(title)))
    w = F.col("_title_w")
    terms = F.regexp_extract_all(w, F.lit(rf"[A-Z][A-Za-z]*(?:{WHITE}+[A-Z][A-Za-z]*)*"), F.lit(0))
    longest = F.aggregate(terms, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    rows = rows.select(
        "*",
        F.regexp_extract(w, r"\A([^，,]*)[，,]", 1).alias("_title_clause"),
        F.regexp_extract(w, CORE, 1).alias("_title_before"),
        trimmed(F.regexp_extract(w, CORE, 2)).alias("_title_core"),
        longest.alias("_title_term"),
    )
    clause, before, core, term = (F.col(f"_title_{c}") for c in ("clause", "before", "core", "term"))
    at = F.instr(w, term) - 1
    lead = F.regexp_replace(w.substr(F.greatest(F.lit(0), at - 6) + 1, F.least(at, F.lit(6))), rf"\A(?:的|{WHITE})+", "")
    table = [
        within(F.col("_title_topic"), 4, 22),
        F.when(utf16_length(clause).between(6, 22), trimmed(clause)),
        F.when(core != "", F.coalesce(within(trimmed(F.concat(trimmed(before), core)), 4, 22), within(core, 4, 20))),
        F.when(term != "", F.coalesce(within(term, 4, 20), F.when(at > 2, within(trimmed(F.concat(lead, term)), 4, 20)))),
        safe_cut(w),
    ]
    rows = rows.withColumn("_title_rest", table.pop())
    return rows.withColumn(out, F.coalesce(*table, F.col("_title_rest"))).drop("_title_rest", "_title_topic", "_title_w", "_title_clause", "_title_before", "_title_core", "_title_term")


def cleaned(rows: DataFrame, title: str, out: str) -> DataFrame:
    """Rows with the clean title: tidied, shortened where it is long; empty where nothing good comes out."""
    rows = shortened(rows.withColumn("_title_t", tidied(F.col(title))), "_title_t", "_title_s")
    t, size = F.col("_title_t"), utf16_length(F.col("_title_t"))
    return rows.withColumn(out, F.when(F.col(title).isNull(), F.lit(None)).when(size < 2, "").when(size <= LONG, t).otherwise(F.when(is_good(F.col("_title_s")), F.col("_title_s")).otherwise(""))).drop("_title_t", "_title_s")


def drawn(rows: DataFrame, content: str, out: str) -> DataFrame:
    """Rows with a title from the content's first line: the clean line, else its first sentence, cut; empty where it gives none."""
    line = trimmed(F.regexp_extract(F.coalesce(F.col(content), F.lit("")), r"\A([^\n]*)", 1))
    rows = cleaned(rows.withColumn("_title_line", line), "_title_line", "_title_c")
    start = F.regexp_extract("_title_line", r"\A[^。！？；]{1,30}[。！？；]?", 0)
    sentence = trimmed(F.regexp_replace(start, rf"(?:[。，！？；：]|{WHITE})+\z", ""))
    rows = rows.withColumn("_title_said", F.when(start != "", sentence).otherwise(F.col("_title_line")))
    rows = rows.withColumn("_title_cut", safe_cut(F.col("_title_said")))
    short = F.when(utf16_length(F.col("_title_cut")) >= 2, F.col("_title_cut")).otherwise("")
    return rows.withColumn(out, F.when(F.col("_title_c") != "", F.col("_title_c")).otherwise(short)).drop("_title_line", "_title_c", "_title_said", "_title_cut")


def ensured(rows: DataFrame, title: str, content: str, heading: str | None = None) -> DataFrame:
    """Rows with every title cleaned where that leaves something, and missing ones drawn from the content.

    ``heading`` names a boolean column: the title was a line of a list, which has to be clean to count.
    """
    names = rows.columns
    rows = cleaned(rows, title, "_title_first")
    given = F.coalesce(F.col(title), F.lit(""))
    if heading:
        given = F.when(F.coalesce(F.col(heading), F.lit(False)), F.coalesce("_title_first", F.lit(""))).otherwise(given)
    rows = rows.withColumn("_title_given", given)
    rows = drawn(cleaned(rows, "_title_given", "_title_again"), content, "_title_drawn")
    best = F.when(trimmed(F.col("_title_given")) == "", F.col("_title_drawn")).when(F.col("_title_again") != "", F.col("_title_again")).otherwise(F.col("_title_given"))
    return rows.withColumn(title, best).select(*names)
