"""Queries of this package over the project's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import contamination, history, main_body, mixing, mojibake, near_dups, pii, spam
from .common import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an evaluation item wholly or in part."""
    return contamination.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notes that say nearly the same."""
    return near_dups.near_duplicate_pairs(table(spark, folder, "notes"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages made of keywords, links or tags."""
    return spam.spam_pages(extracts(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each page's main body."""
    return main_body.find_body(extracts(spark, folder))


def p3_body(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each page as text, laid out as it was."""
    return main_body.body_text(extracts(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notes and entries of the history that hold nearly the same content."""
    return history.known_already(table(spark, folder, "notes"), table(spark, folder, "dedup_features")).select("id", "path")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose content holds wrongly decoded text."""
    return mojibake.find_garbled(extracts(spark, folder)).select("page_id").distinct()


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged pages with their text put right as far as it can be recovered."""
    return mojibake.restored(extracts(spark, folder))


def extracts(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages; failed ones hold no text."""
    return table(spark, folder, "url_extracts").where("success")


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each plan's mixture, with the times each is taken."""
    return mixing.selection(*(table(spark, folder, name) for name in ("documents", "mix_plans", "mix_targets")))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every plan and source."""
    return mixing.shares(*(table(spark, folder, name) for name in ("documents", "mix_plans", "mix_targets")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every e-mail address, phone number, identity number, street address and name."""
    return pii.find_personal(table(spark, folder, "documents"), table(spark, folder, "name_parts")).select("doc_id", "kind", "start_pos")


def p8_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a typed placeholder for every personal value."""
    return pii.mask_personal(table(spark, folder, "documents"), table(spark, folder, "name_parts"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every note with its class of equal texts and its group of near-duplicates."""
    return near_dups.near_duplicate_groups(table(spark, folder, "notes"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_body": p3_body, "p4_found": p4_found, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p7_selection": p7_selection, "p7_shares": p7_shares, "p8_found": p8_found, "p8_masked": p8_masked, "p1_groups": p1_groups}

#: Units are split by putting spaces around Han characters and in place of everything that is neither letter nor digit.
_UNITS = "list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '([\\x{{4E00}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda u: u <> '')"
SQL = {
    "p6_found": f"""
WITH i AS (SELECT item_id, {_UNITS.format('text')} AS u FROM (SELECT DISTINCT item_id, text FROM eval_items WHERE text IS NOT NULL)),
d AS (SELECT doc_id, {_UNITS.format('text')} AS u FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(13, len(u)) AS n, array_to_string(u[k:k + 12], ' ') AS w
       FROM (SELECT item_id, u, unnest(range(1, greatest(1, len(u) - 12) + 1)) AS k FROM i WHERE len(u) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT DISTINCT doc_id, n, array_to_string(u[k:k + n - 1], ' ') AS w
       FROM (SELECT doc_id, u, n, unnest(range(1, len(u) - n + 2)) AS k FROM d, lengths WHERE len(u) >= n))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, w)
""",
}
