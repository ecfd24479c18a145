"""Review scores: parsing, defaults for rows a reviewer passed over, grades and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "array<struct<index:double,insight_score:double,knowledge_score:double,final_score:double,verdict:string,reason:string>>"
KEEP, DROP = "保留", "丢弃"


def rounded(x: Column) -> Column:
    """Halves go up, for negative numbers too."""
    return F.floor(x + 0.5)


def parsed(rows: DataFrame, key: str, raw: str, expected: str, least: int = 6) -> DataFrame:
    """(key, idx, insight, knowledge, final, verdict, reason): one row per expected note.

    ``raw`` is a JSON array; indexes count from 1, those beyond the expected number are ignored, of several answers the last counts.
    Scores are held to 1..5, a missing final score is their sum, and the verdict is made anew. Notes without an answer, and all notes of
    an output that doesn't parse, are kept with 3 + 3.
    """
    array = F.from_json(F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)(\[.*\])", 1), ITEM)
    answers = rows.select(key, F.col(expected).alias("_n"), F.posexplode(array).alias("_pos", "r"))
    index = F.greatest(F.lit(0), F.coalesce(F.col("r.index"), F.lit(1.0)).cast("int") - 1)
    held = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), rounded(F.coalesce(F.col(c), F.lit(3.0))))).cast("int")
    scored = answers.select(key, "_n", "_pos", index.alias("idx"), held("r.insight_score").alias("insight"), held("r.knowledge_score").alias("knowledge"), F.col("r.final_score").alias("_f"), F.coalesce("r.reason", F.lit("")).alias("reason")).where(F.col("idx") < F.col("_n"))
    scored = scored.withColumn("final", F.coalesce(rounded(F.col("_f")).cast("int"), F.col("insight") + F.col("knowledge")))
    last = scored.groupBy(key, "idx").agg(F.max_by(F.struct("insight", "knowledge", "final", "reason"), "_pos").alias("s"))
    wanted = rows.select(key, F.explode(F.when(F.col(expected) > 0, F.sequence(F.lit(0), F.col(expected) - 1)).otherwise(F.array().cast("array<int>"))).alias("idx"))
    full = wanted.join(last, [key, "idx"], "left")
    final = F.coalesce("s.final", F.lit(6))
    return full.select(key, "idx", F.coalesce("s.insight", F.lit(3)).alias("insight"), F.coalesce("s.knowledge", F.lit(3)).alias("knowledge"), final.alias("final"), F.when(final >= least, KEEP).otherwise(DROP).alias("verdict"), F.coalesce("s.reason", F.lit("default")).alias("reason"))


def grade(final: Column) -> Column:
    return F.when(final >= 8, "优").when(final >= 6, "良").when(final >= 4, "中").otherwise("差")


def kept_in_order(notes: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Notes that the review keeps, best first; equal scores keep their order."""
    return notes.join(reviews.where(F.col("verdict") == KEEP).select(key, "idx", "final"), [key, "idx"]).orderBy(key, F.desc("final"), "idx")


def places(reviews: DataFrame, key: str) -> DataFrame:
    """(key, idx, place) of the kept notes, best first; equal scores keep their order."""
    order = Window.partitionBy(key).orderBy(F.desc("final"), "idx")
    return reviews.where(F.col("verdict") == KEEP).select(key, "idx", F.row_number().over(order).alias("place"))


def survivors(pending: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Pending rows whose note passed the later filters."""
    return pending.join(notes.select(key).distinct(), key, "left_semi")


def summary(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(F.col("verdict") == KEEP).alias("kept"), F.count_if(F.col("verdict") == DROP).alias("discarded"), F.avg("final").alias("mean_score"))


def shown(notes: DataFrame, mode: str = "all", search: str = "") -> DataFrame:
    """Notes in a list: all, those with issues, or those fully traced; and a search in title and content without regard to case."""
    issues = F.coalesce(F.col("needs_compare_count"), F.lit(0)) + F.coalesce(F.col("out_of_scope_count"), F.lit(0))
    found = notes.where(issues > 0) if mode == "issues" else notes.where((issues == 0) & (F.coalesce(F.col("traced_count"), F.lit(0)) > 0)) if mode == "traced" else notes
    if search:
        word = F.lit(search.lower())
        found = found.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), word) | F.contains(F.lower(F.coalesce("content", F.lit(""))), word))
    return found


def edited(note_title: Column, note_content: Column, new_title: Column, new_content: Column, verification: Column) -> Column:
    """Verification of an edited note: cleared if title or content changed."""
    same = note_title.eqNullSafe(new_title) & note_content.eqNullSafe(new_content)
    return F.when(same, verification)


# What a list says of a note as a whole.
LABELS = ("综合判断 · 超源", "综合判断 · 需对比", "综合判断 · 已溯源", "综合判断")


def label(traced: Column, compare: Column, beyond: Column) -> Column:
    """The gravest finding of a note: beyond the source, to be compared, traced, or none."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    return F.when(some(beyond), LABELS[0]).when(some(compare), LABELS[1]).when(some(traced), LABELS[2]).otherwise(LABELS[3])


def restored(notes: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Notes together with duplicates (key, title, content) that come back as notes of their own: a new key, no tags, nothing verified."""
    back = removed.select(F.concat(F.lit("restored-"), F.col(key)).alias(key), "title", "content", F.array().cast("array<string>").alias("tags"))
    return notes.unionByName(back, allowMissingColumns=True)
