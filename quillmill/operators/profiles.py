"""Content profiles: which kind of text a row is, and the thresholds that go with it."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, WHITE, trimmed, utf16_length, wide

PROFILES = ("dense", "balanced", "sparse")
# Thresholds by profile, in the order of PROFILES.
THRESHOLDS: dict[str, tuple[float, float, float]] = {
    "cross_batch": (0.75, 0.65, 0.55),
    "vault_high": (0.8, 0.7, 0.6),
    "vault_mid": (0.65, 0.55, 0.45),
    "review_min": (4, 6, 7),
    "min_density": (0.15, 0.15, 0.15),
    "warn_density": (0.5, 0.5, 0.5),
    "max_noise": (0.75, 0.7, 0.65),
    "warn_noise": (0.45, 0.4, 0.35),
    "min_length": (50, 80, 30),
    "warn_length": (150, 300, 100),
    "max_length": (100000, 50000, 20000),
    "warn_max_length": (50000, 20000, 10000),
    "link_ratio": (0.55, 0.4, 0.35),
    "link_block": (1.5, 1, 0.8),
    "link_warn": (1, 0.5, 0.4),
    "quality_block": (2, 3, 5),
    "quality_warn": (1, 1, 2),
    "stuffing_block": (5, 3, 2),
    "stuffing_warn": (3, 1.5, 1),
    "stuffing_min_length": (300, 200, 150),
    "stuffing_min_count": (8, 5, 3),
    "html_block": (5, 5, 5),
    "html_warn": (2, 2, 2),
    "mojibake_block": (3, 3, 3),
    "mojibake_warn": (1, 1, 1),
    "paragraph_block": (0.9, 0.85, 0.85),
    "paragraph_warn": (0.75, 0.7, 0.7),
}
# Thresholds where no profile is given.
DEFAULTS: dict[str, float] = {k: v[1] for k, v in THRESHOLDS.items()} | {"min_length": 50, "warn_length": 200}

# Units of measure, and words of narration.
UNITS = "mV|kV|V|mW|kW|MW|GW|TW|W|mWh|kWh|MWh|GWh|mA|kA|A|Ω|mΩ|Hz|kHz|MHz|GHz|μF|mF|nF|pF|°C|°F|mm|cm|m|km|kg|t|Pa|kPa|MPa|bar|ppm|ppb|dB|dBm"
NARRATIVE = "然而 但是 却 不禁 渐渐 终于 忽然 突然 似乎 仿佛 依然 仍然 默默 悄悄 缓缓 淡淡 深深 轻轻 回忆 想起 记得 故事 情感 感受 心情 思绪 目光 微笑 沉默 叹息".split()


def threshold_table(spark: SparkSession, overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per profile; overrides replace single thresholds of a profile."""
    names = list(THRESHOLDS)
    rows = [(p, *(float((overrides or {}).get(p, {}).get(n, THRESHOLDS[n][k])) for n in names)) for k, p in enumerate(PROFILES)]
    return spark.createDataFrame(rows, "profile string, " + ", ".join(f"{n} double" for n in names))


def chosen_profile(manual: Column, auto: Column) -> Column:
    """A profile set by hand, else the detected one, else balanced."""
    return F.coalesce(F.when(manual.isin(*PROFILES), manual), F.when(auto.isin(*PROFILES), auto), F.lit("balanced"))


def without_noise(text: Column) -> Column:
    """Text without code, tags, links, entities and counters of readers."""
    # What is removed, in this order, and what stands for it.
    for pattern, by in (
        (r"```[\s\S]*?```", " "),
        (r"`[^`]+`", " "),
        (r"<[^>]+>", " "),
        (r"https?://\S+", " "),
        (r"!\[([^\]]*)\]\([^)]+\)", "$1 "),
        (r"\[([^\]]*)\]\([^)]+\)", "$1 "),
        (r"&\w+;", " "),
        (r"(?:阅读|阅读数|点赞|在看|转发|收藏)\s*\d+", " "),
        (r"🎧\s*\d+人", " "),
    ):
        text = F.regexp_replace(text, wide(pattern), by)
    return text


def _per_thousand(count: Column, text: Column) -> Column:
    return count * 1000.0 / F.greatest(utf16_length(text), F.lit(1))


def term_density(text: Column) -> Column:
    """English words of three letters or more that aren't stop words, and terms joined by a slash or a hyphen, per thousand characters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS if w.isascii()])
    words = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[a-zA-Z]{3,}(?![A-Za-z0-9_])"), 0), lambda w: ~F.array_contains(stop, F.lower(w)))
    joined = F.regexp_count(text, F.lit("[a-zA-Z]+/[a-zA-Z]+")) + F.regexp_count(text, F.lit("[a-zA-Z]+-[a-zA-Z]+"))
    return _per_thousand(F.size(words) + joined, text)


def data_points(text: Column) -> Column:
    """Distinct percentages, measures, years and dates, and Chinese magnitudes."""
    # The patterns.
    years = F.filter(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{4}(?:[-/年]\d{1,2}(?:[-/月]\d{1,2})?)?(?!\d)"), 0), lambda y: F.substring(y, 1, 4).cast("int").between(1900, 2100))
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(text, F.lit(r"(?:约|近|超|达)?\d+(?:\.\d+)?%"), 0),
            F.regexp_extract_all(text, F.lit(wide(rf"(?iu)\d+(?:\.\d+)?\s*(?:{UNITS})")), 0),
            years,
            F.regexp_extract_all(text, F.lit(wide(r"\d+(?:\.\d+)?\s*(?:万亿|亿|千万|百万|万|千)\s*(?:元|美元|欧元|人|台|套|条|座|个|辆|次)?")), 0),
        )
    )


def data_density(text: Column) -> Column:
    return _per_thousand(F.size(data_points(text)), text)


def paragraph_length(text: Column) -> Column:
    """Mean length of the non-blank paragraphs, 0 for none."""
    sizes = F.transform(F.filter(F.transform(F.split(text, rf"\n{WHITE}*\n"), trimmed), lambda p: p != ""), utf16_length)
    return F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0), lambda a, b: a + b) / F.size(sizes)).otherwise(0.0)


def narrative_density(text: Column) -> Column:
    return _per_thousand(reduce(add, [F.regexp_count(text, F.lit(w)) for w in NARRATIVE]), text)


def densities(rows: DataFrame, text: str) -> DataFrame:
    """Rows with what the classification rests on; the cleaned text is computed once."""
    clean = rows.withColumn("_clean", without_noise(F.col(text)))
    c = F.col("_clean")
    return clean.select("*", F.regexp_count(F.col(text), F.lit(r"```[\s\S]*?```")).alias("code_blocks"), term_density(c).alias("term_density"), data_density(c).alias("data_density"), paragraph_length(c).alias("avg_paragraph"), narrative_density(c).alias("narrative_density")).drop("_clean")


def classified(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``profile``: dense, sparse or balanced. Null and short texts are balanced."""
    found = densities(rows, text)
    profile = (
        F.when(F.col(text).isNull() | (utf16_length(F.col(text)) < 100), "balanced")
        .when((F.col("code_blocks") >= 1) | (F.col("term_density") >= 5) | (F.col("data_density") >= 4), "dense")
        .when((F.col("avg_paragraph") > 300) & (F.col("narrative_density") >= 2), "sparse")
        .otherwise("balanced")
    )
    return found.withColumn("profile", profile)
