"""The quality gate: nine rules over a text, and the verdict.

Rules are column expressions: a cheap group on patterns, and a dear group on tokens and paragraphs that runs only on rows which the
cheap group lets pass. All work within the row, so no rule shuffles. A null text is judged as an empty one.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, trimmed, utf16_length, wide
from ..functions.tokens import token_stats, tokens
from .profiles import DEFAULTS

# Advertising phrases and click-bait.
AD_PHRASES = ["点击这里", "立即购买", "限时优惠", "抢购", "广告", "推广", "赞助", "点击链接", "buy now", "click here", "limited offer", "special offer", "order now", "shop now", "save big", "best price", "free trial", "sign up now", "subscribe now", "100% free", "no credit card", "act now"]
BAIT_PHRASES = ["你绝对想不到", "惊呆了", "炸裂", "you won't believe", "shocking", "amazing trick", "this one weird trick", "doctors hate", "they don't want you to know"]
AD_PATTERNS = ["限[时期限].{0,3}[优特惠抢]", "点击.{0,3}(这里|链接|进入)", "(?:🔥|💰|🎁|👉).{0,5}(?:优惠|抢购|福利|免费)", "(?i)(?:100%|FREE|LIMITED).{0,10}(?:trial|offer|time)"]
# Residue of markup and of wrong decoding.
HTML_PATTERNS = [r"(?i)<[a-z][a-z0-9]*\s[^>]*>", r"(?i)</[a-z][a-z0-9]*>", r"(?i)<(?:script|style|iframe|object|embed)[^>]*>", r"&[a-z]{2,8};", r"&#[0-9]{2,5};"]
MOJIBAKE_PATTERNS = ["锟斤拷", "烫烫烫", "屯屯屯", "[ÂÃÄÅÆÇÈÉÊËÌÍÎÏ]{3,}", "�{3,}"]
# Addresses.
LINK_PATTERNS = [r"https?://\S+", r"www\.\S+\.\S+"]
# Fixed value: characters that are no noise.
CLEAN_RANGES = r"\x{20}-\x{24F}\x{370}-\x{3FF}\x{400}-\x{4FF}\x{600}-\x{6FF}\x{900}-\x{97F}\x{E00}-\x{E7F}\x{2000}-\x{206F}\x{2200}-\x{22FF}\x{2500}-\x{257F}\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FE00}-\x{FE0F}\x{FF00}-\x{FFEF}\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{20000}-\x{2A6DF}\t\n\r"
#: Rules in the order of their reasons.
CHEAP = ("length", "quality", "html", "mojibake", "links")
DEAR = ("stuffing", "density", "noise", "paragraphs")
#: Paragraphs compared at most, and tokens that a paragraph needs to be compared.
SAMPLED, PARAGRAPH_TOKENS = 40, 8


def factor(length: Column) -> Column:
    """How far thresholds widen with length."""
    return F.greatest(F.lit(1.0), F.log10(length + 10))


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def cheap_metrics(rows: DataFrame, text: str) -> DataFrame:
    c = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(c)
    links = F.concat(*[F.regexp_extract_all(c, F.lit(wide(p)), 0) for p in LINK_PATTERNS])
    return rows.select(
        "*",
        utf16_length(c).alias("len"),
        (_sum([(F.instr(low, p) > 0).cast("int") for p in AD_PHRASES + BAIT_PHRASES]) + _sum([F.regexp_count(c, F.lit(p)) for p in AD_PATTERNS])).alias("quality_hits"),
        _sum([F.regexp_count(c, F.lit(wide(p))) for p in HTML_PATTERNS]).alias("html_hits"),
        _sum([F.regexp_count(c, F.lit(p)) for p in MOJIBAKE_PATTERNS]).alias("mojibake_hits"),
        F.size(links).alias("link_count"),
        F.aggregate(links, F.lit(0), lambda a, x: a + utf16_length(x)).alias("link_chars"),
        F.regexp_count(c, F.lit(rf"{WHITE}*[|·•»›▸→]{WHITE}*")).alias("separators"),
    )


def sampled_places(n: Column) -> Column:
    """1-based places of the paragraphs that are compared: all up to the limit, else the ends and equal steps between them."""
    step = n / float(SAMPLED)
    inner = F.transform(F.sequence(F.lit(1), F.lit(SAMPLED - 2)), lambda i: F.least(n - 1, F.floor(i * step).cast("int")) + 1)
    many = F.array_distinct(F.concat(F.array(F.lit(1)), inner, F.array(n)))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= SAMPLED, F.sequence(F.lit(1), n)).otherwise(many)


def dear_metrics(rows: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    """Metrics on tokens and paragraphs; rows outside ``where`` are measured as empty texts, which costs nothing."""
    c = F.coalesce(F.col(text) if where is None else F.when(where, F.col(text)), F.lit(""))
    with_tokens = rows.withColumn("_stats", token_stats(tokens(c, 2)))
    whole = F.filter(F.transform(F.split(c, rf"\n{WHITE}*\n"), trimmed), lambda p: p != "")
    parts = with_tokens.withColumn("_all", whole).withColumn("_parts", F.transform(sampled_places(F.size("_all")), lambda i: F.get(F.col("_all"), i - 1)))
    sets = parts.withColumn("_sets", F.filter(F.transform("_parts", lambda p: F.array_distinct(tokens(p, 2))), lambda s: F.size(s) >= PARAGRAPH_TOKENS))

    def likeness(a: Column, b: Column) -> Column:
        shared = F.size(F.array_intersect(a, b))
        return shared / (F.size(a) + F.size(b) - shared)

    pairs = F.flatten(F.transform("_sets", lambda a, i: F.transform(F.slice(F.col("_sets"), i + 2, F.greatest(F.size("_sets") - i - 1, F.lit(0))), lambda b: likeness(a, b))))
    return sets.select(
        *rows.columns,
        F.col("_stats.total").alias("token_total"),
        F.col("_stats.different").alias("token_distinct"),
        F.col("_stats.top").alias("token_top"),
        (F.regexp_count(c, F.lit(f"[^{CLEAN_RANGES}]")) / F.greatest(utf16_length(c), F.lit(1))).alias("noise_ratio"),
        F.coalesce(F.array_max(pairs), F.lit(0.0)).alias("paragraph_similarity"),
    )


def _limit(name: str, limits: dict[str, Column] | None) -> Column:
    return limits[name] if limits else F.lit(float(DEFAULTS[name]))


def _scaled(name: str, share: float, limits) -> Column:
    base = _limit(name, limits)
    return F.greatest(base, F.floor(base * factor(F.col("len")) * share))


def statuses(limits: dict[str, Column] | None = None, selection: bool = False) -> dict[str, Column]:
    """Status of each rule, ok, warn or block, from the metrics; ``limits`` are columns of a joined threshold table."""
    n, f = F.col("len"), factor(F.col("len"))
    at = lambda name: _limit(name, limits)
    least, few = (F.greatest(F.lit(20), F.floor(at("min_length") * 0.6)), F.greatest(F.lit(40), F.floor(at("warn_length") * 0.6))) if selection else (at("min_length"), at("warn_length"))

    def two(value: Column, block: Column, warn: Column) -> Column:
        return F.when(value >= block, "block").when(value >= warn, "warn").otherwise("ok")

    per_hundred = F.col("link_count") / F.nullif(n / 100.0, F.lit(0.0))
    link_warn = F.greatest(F.lit(0.3), at("link_warn") * F.least(F.lit(1.5), 1 + (f - 1) * 0.3))
    many = F.col("link_count") >= 5
    widen = F.least(F.lit(2.0), 1 + (f - 1) * 0.5)
    rate = F.col("token_top") / F.nullif(n / 100.0, F.lit(0.0))
    total = F.col("token_total")
    ratio = F.col("token_distinct") / F.nullif(total, F.lit(0))
    thin = 1 / F.sqrt(F.log10(total + 10))
    return {
        "length": F.when(n < least, "block").when(n < few, "warn").when((at("max_length") > 0) & (n > at("max_length")), "block").when((at("warn_max_length") > 0) & (n > at("warn_max_length")), "warn").otherwise("ok"),
        "quality": two(F.col("quality_hits"), _scaled("quality_block", 0.6, limits), _scaled("quality_warn", 0.5, limits)),
        "html": two(F.col("html_hits"), _scaled("html_block", 0.7, limits), _scaled("html_warn", 0.6, limits)),
        "mojibake": two(F.col("mojibake_hits"), _scaled("mojibake_block", 0.7, limits), _scaled("mojibake_warn", 0.6, limits)),
        "links": F.when(n < 100, "ok").when((F.col("link_chars") / n > at("link_ratio")) & many & (per_hundred > at("link_block")), "block").when(F.col("separators") >= 5, "warn").when((per_hundred > link_warn) & many, "warn").otherwise("ok"),
        "stuffing": F.when((n < at("stuffing_min_length")) | (F.col("token_distinct") < 10) | (F.col("token_top") < at("stuffing_min_count")) | (rate < at("stuffing_warn") * widen), "ok").when(rate >= at("stuffing_block") * widen, "block").otherwise("warn"),
        "density": F.when(total < 20, "ok").when(ratio < at("min_density") * F.greatest(F.lit(0.3), thin), "block").when(ratio < at("warn_density") * F.greatest(F.lit(0.5), thin), "warn").otherwise("ok"),
        "noise": F.when(n < 50, "ok").when(F.col("noise_ratio") > at("max_noise"), "block").when(F.col("noise_ratio") > at("warn_noise"), "warn").otherwise("ok"),
        "paragraphs": F.when(F.col("paragraph_similarity") >= at("paragraph_block"), "block").when(F.col("paragraph_similarity") >= at("paragraph_warn"), "warn").otherwise("ok"),
    }


def judged(rows: DataFrame, text: str, limits: dict[str, Column] | None = None, selection: bool = False) -> DataFrame:
    """Rows with ``rules`` (name and status of every rule that ran), ``blocks``, ``warns``, ``summary`` and ``passed``.

    One pass: rows that a cheap rule blocks go through the dear group as empty texts. Warnings add up: from a number on that grows with length they block.
    """
    of = statuses(limits, selection)
    struct = lambda names: F.array(*[F.struct(F.lit(k).alias("rule"), of[k].alias("status")) for k in names])
    cheap = cheap_metrics(rows, text).withColumn("_cheap", struct(CHEAP))
    stopped = F.exists("_cheap", lambda r: r["status"] == "block")
    full = dear_metrics(cheap.withColumn("_stopped", stopped), text, ~F.col("_stopped"))
    both = full.select(*rows.columns, "len", F.when(F.col("_stopped"), F.col("_cheap")).otherwise(F.concat("_cheap", struct(DEAR))).alias("rules"))
    count = lambda status: F.size(F.filter("rules", lambda r: r["status"] == status))
    patience = F.greatest(F.lit(3), F.least(F.lit(6), F.floor(factor(F.col("len")) * 1.8)))
    found = both.withColumn("blocks", count("block")).withColumn("warns", count("warn"))
    escalated = (F.col("blocks") == 0) & (F.col("warns") >= patience)
    first = F.get(F.filter("rules", lambda r: r["status"] == "block"), F.lit(0))["rule"]
    return found.withColumn("summary", F.when(escalated, "escalated").otherwise(first)).withColumn("passed", (F.col("blocks") == 0) & ~escalated).drop("len")


def forced(judgements: DataFrame, force: bool) -> DataFrame:
    """With force, everything goes on; the verdict stays visible in ``passed``."""
    return judgements.withColumn("admitted", F.lit(True) if force else F.col("passed"))
