"""Checkable claims of a text, and where a source bears them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed, trimmed, truncated, utf16_length, wide

# Patterns of figures and names, and words that state causes or evidence.
NUMERIC = [
    r"(?:约|近|超|达|不足)?百分之[\d一二三四五六七八九十百千]+",
    r"(?:约|近|超|达|不足)?\d+(?:\.\d+)?%",
    r"\d+(?:\.\d+)?\s*(?:万亿|万|亿|千|百)?(?:美元|欧元|日元|英镑|人民币|元|美元|人|个|年|月|天|小时|kg|km|m|cm|mm)",
    r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}",
    r"\d{4}年\d{1,2}月\d{1,2}日",
    r"\d{1,2}月\d{1,2}日",
    r"\d{4}[-/年]\d{1,2}",
    r"(?:第[一二三四五六七八九十\d]+|[一二三四五六七八九十]+倍|\d+倍|\d+番)",
]
ENTITY = [
    r"[\u4e00-\u9fff]{2,6}(?:公司|机构|大学|学院|集团|基金|协会|部门|委员会|平台|系统|框架|协议|标准|组织|银行|医院|研究所|实验室)",
    r"[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+",
]
CAUSAL = "导致 使得 造成 引起 证明 发现 表明 显示 研究结果 数据表明 统计显示 调查指出 报告指出 因此 所以 由此可见 这说明了 这意味着".split()
LIMIT = 30
TRACED, COMPARE, BEYOND = "已溯源", "需对比", "超源"


def claims(rows: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(key, pos, claim, anchor, type): figures, then names, then one statement of cause of each sentence, an anchor once per row, the first ``limit``.

    Works within the row up to the explode, so nothing is shuffled. Null and blank texts have no claims.
    """
    sentences = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[。！？\n.!?]+"), trimmed), lambda s: utf16_length(s) >= 3)

    def of(sentence: Column) -> Column:
        shown = F.when(utf16_length(sentence) <= 80, sentence).otherwise(F.concat(truncated(sentence, 80), F.lit("...")))

        def found(pattern: str, kind: str) -> Column:
            return F.transform(F.regexp_extract_all(sentence, F.lit(wide(pattern)), 0), lambda a: F.struct(shown.alias("claim"), a.alias("anchor"), F.lit(kind).alias("type"), a.alias("once")))

        first = F.coalesce(*[F.when(F.instr(sentence, w) > 0, F.lit(w)) for w in CAUSAL])
        cause = F.filter(F.array(F.struct(shown.alias("claim"), first.alias("anchor"), F.lit("causal").alias("type"), F.concat(F.lit("causal:"), truncated(sentence, 30)).alias("once"))), lambda c: c["anchor"].isNotNull() & (utf16_length(sentence) >= 8))
        return F.concat(*[found(p, "numeric") for p in NUMERIC], *[found(p, "entity") for p in ENTITY], cause)

    every = F.flatten(F.transform(sentences, of))
    once = F.aggregate(
        every,
        F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<claim:string,anchor:string,type:string>>").alias("kept")),
        lambda a, c: F.when(F.array_contains(a["seen"], c["once"]), a).otherwise(
            F.struct(F.concat(a["seen"], F.array(c["once"])).alias("seen"), F.concat(a["kept"], F.array(F.struct(c["claim"].alias("claim"), c["anchor"].alias("anchor"), c["type"].alias("type")))).alias("kept"))
        ),
    )["kept"]
    return rows.select(key, F.posexplode(F.slice(once, 1, limit)).alias("pos", "c")).select(key, "pos", "c.claim", "c.anchor", "c.type")


def context_sentence(text: Column, at: Column, length: Column) -> Column:
    """The sentence around a place, its closing mark included, trimmed and cut to two hundred characters."""
    before = F.regexp_extract(F.substring(text, F.lit(1), at - 1), r"([^。！？\n.!?]*)\z", 1)
    after = F.regexp_extract(F.substring(text, at + length, F.length(text)), r"\A([^。！？\n.!?]*[。！？\n.!?]?)", 1)
    whole = trimmed(F.concat(before, F.substring(text, at, length), after))
    return F.when(utf16_length(whole) > 200, F.concat(truncated(whole, 200), F.lit("..."))).otherwise(whole)


def located(rows: DataFrame, anchor: str, kind: str, source: str) -> DataFrame:
    """Rows of claims with their source text, with ``status``, ``source_text`` and ``diff_note``.

    Traced: the anchor itself, or for figures a number in the source that is equal or within five per cent. To be compared: the first
    six tenths of a name or word. Otherwise null. The context is taken where the matched string first stands.
    """
    a, s = F.col(anchor), F.coalesce(F.col(source), F.lit(""))
    exact = F.expr(f"instr(coalesce(`{source}`, ''), `{anchor}`)")
    number = F.regexp_extract(a, r"([0-9]+(?:\.[0-9]+)?)", 1)
    value = F.expr("try_cast(_number as double)")
    near = F.filter(
        F.regexp_extract_all(s, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0),
        lambda x: (x.cast("double") == F.col("_value")) | (F.when(F.col("_value") != 0, F.abs(x.cast("double") - F.col("_value")) / F.abs(F.col("_value"))).otherwise(F.abs(x.cast("double"))).between(1e-300, 0.05 - 1e-15)),
    )
    part = F.substring(a, F.lit(1), F.greatest(F.lit(2), F.ceil(F.length(a) * 0.6)).cast("int"))
    numeric = F.col(kind) == "numeric"
    found = (
        rows.withColumn("_exact", exact)
        .withColumn("_number", number)
        .withColumn("_value", value)
        .withColumn("_near", F.when(numeric & (F.col("_exact") == 0) & F.col("_value").isNotNull(), F.get(near, F.lit(0))))
        .withColumn("_part", F.when(~numeric & (F.col("_exact") == 0), part))
        .withColumn("_match", F.when(F.col("_exact") > 0, a).when(F.col("_near").isNotNull(), F.col("_near")).when(F.expr(f"instr(coalesce(`{source}`, ''), _part)") > 0, F.col("_part")))
        .withColumn("_at", F.expr(f"instr(coalesce(`{source}`, ''), _match)"))
    )
    status = F.when(F.col("_match").isNull(), F.lit(None)).when((F.col("_exact") > 0) | F.col("_near").isNotNull(), TRACED).otherwise(COMPARE)
    note = F.when(F.col("_near").isNotNull() & (F.col("_near").cast("double") != F.col("_value")), F.concat(F.lit("source: "), "_near", F.lit(", note: "), a)).when(status == COMPARE, F.concat(F.lit("found in part: "), "_part"))
    return found.select(*rows.columns, status.alias("status"), F.when(F.col("_match").isNotNull(), context_sentence(s, F.col("_at"), F.length("_match"))).alias("source_text"), note.alias("diff_note"))


def quote_stands(source: Column, quote: Column) -> Column:
    """Whether a quotation is in the source, white space aside."""
    return F.contains(squeezed(source), squeezed(quote))


def settled(rows: DataFrame, answer_status: str, answer_quote: str, source: str) -> DataFrame:
    """Statuses of claims that a comparison answered: a quotation that the source lacks, and every unknown answer, is beyond the source."""
    status = F.when((F.col(answer_status) == COMPARE) & (F.coalesce(F.col(answer_quote), F.lit("")) != "") & ~quote_stands(F.col(source), F.col(answer_quote)), BEYOND).when(F.col(answer_status) == COMPARE, COMPARE).otherwise(BEYOND)
    return rows.withColumn("status", status)


def status_counts(verified: DataFrame, key: str) -> DataFrame:
    return verified.groupBy(key).agg(*[F.count_if(F.coalesce("status", F.lit(BEYOND)) == s).alias(n) for n, s in (("traced", TRACED), ("needs_compare", COMPARE), ("out_of_scope", BEYOND))])


def only_verified(notes: DataFrame, verification: str = "verification") -> DataFrame:
    """Notes without a claim beyond the source; a null list has none."""
    return notes.where(~F.coalesce(F.exists(verification, lambda v: v["status"] == BEYOND), F.lit(False)))


