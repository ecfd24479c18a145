"""Text functions with the length and white-space rules of UTF-16 strings, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as trimming sees it, the byte-order mark included.
WHITE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Characters beyond the basic plane, which take two UTF-16 units.
WIDE = "[\U00010000-\U0010ffff]"

# The words that tokenisation leaves out.
STOP_WORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 吗 呢 吧 啊 哦 嗯 把 被 让 给 从 向 往 对 比 跟 那 哪 什么 怎么 为什么 谁 怎样 如何 可以 能 可能 应该 需要 已经 正在 还是 但是 而且 因为 所以 如果 虽然 然后 或者 "
    "the a an and or but in on at to for of with by from is are was were be been it its this that these those they we he she his her our your their has have had do does"
).split()


_SPACES = {r"[\s\S]": r"[\x{0}-\x{10FFFF}]", r"[^\s]": f"[^{WHITE[1:]}", r"\S": f"[^{WHITE[1:]}", r"\s": WHITE}


def wide(pattern: str) -> str:
    """A pattern whose ``\\s`` and ``\\S`` know Unicode white space and the byte-order mark, as in the tables' own rules."""
    return re.sub(r"\[\\s\\S\]|\[\^\\s\]|\\S|\\s", lambda m: _SPACES[m[0]], pattern)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def truncated(text: Column, units: int = 10_000) -> Column:
    """The first ``units`` code units; a character that would be cut in two stays out.

    Texts without characters beyond the basic plane, nearly all, take the short way.
    """
    short = F.substring(text, 1, units)
    wide = F.regexp_count(short, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    walk = F.aggregate(
        F.split(short, ""),
        F.struct(F.lit(0).alias("taken"), F.lit(0).alias("used")),
        lambda a, c: F.struct((a["taken"] + F.when(a["used"] + utf16_length(c) <= units, 1).otherwise(0)).alias("taken"), (a["used"] + utf16_length(c)).alias("used")),
    )["taken"]
    return F.when(wide == 0, short).otherwise(F.substring(short, F.lit(1), walk.cast("int")))


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, rf"{WHITE}+", " "))


def without_front_matter(text: Column, strict: bool = True) -> Column:
    """Drop a leading block between dashes: the strict form is whole lines and trims, the lax form is any text up to the next dashes."""
    if strict:
        return trimmed(F.regexp_replace(text, wide(r"\A\x{FEFF}?---\s*\n[\s\S]*?\n---\s*(?:\n|\z)"), ""))
    return F.regexp_replace(text, r"\A---[\s\S]*?---\n*", "")


def note_title(text: Column, stem: Column) -> Column:
    """Front-matter title, else the first first-level heading, else the first non-blank line, else the file's stem."""
    front = F.regexp_extract(text, wide(r"\A\x{FEFF}?---\s*\n([\s\S]*?)\n---"), 1)
    named = F.regexp_replace(F.regexp_extract(front, r"(?m)^title:[ \t]*(.+)$", 1), r"^[\"'\s]+|[\"'\s]+$", "")
    body = without_front_matter(text)
    heading = F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+)$", 1))
    first = F.trim(F.regexp_extract(body, r"(?m)^[ \t]*(\S.*)$", 1))
    empty = F.lit("")
    return F.coalesce(F.nullif(named, empty), F.nullif(heading, empty), F.nullif(first, empty), stem)


# Patterns of images in a clipboard's text, in the order removed.
IMAGE_NOISE = [
    r"(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=]+",
    r"!\[.*?\]\(.*?\)",
    r"(?i)<img[^>]*\/?>",
    r"(?i)<figure[\s\S]*?<\/figure>",
    r"(?i)<figcaption[\s\S]*?<\/figcaption>",
    r"(?i)<picture[\s\S]*?<\/picture>",
    r"(?im)^https?:\/\/[^\s]+\.(?:jpg|jpeg|png|gif|webp|svg|bmp|ico)(?:\?[^\s]*)?$",
    r"(?im)^[\w-]+\.(?:jpg|jpeg|png|gif|webp|svg|bmp|ico)\s*$",
    r"(?im)^图(?:片)?\s*$",
]


def image_noise_removed(text: Column) -> Column:
    """Drop images in every notation that a clipboard holds, and collapse the blank lines that they leave."""
    for pattern in IMAGE_NOISE:
        text = F.regexp_replace(text, wide(pattern), "")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))
