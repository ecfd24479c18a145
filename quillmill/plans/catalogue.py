"""The queries of the core over the project's tables, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, tokens
from ..functions.similarity import fitted
from ..operators import claims, dedup, dense, gate, notes, profiles, related, review, titles, vectors
from ..sources import readers, state
from ..streaming import changes
from . import oracle
from .registry import NOTES, QUERIES, SQL, distinct_notes, query, table

# ---- gate ---------------------------------------------------------------------------------------------------------------------
_METRIC = {"length": "len", "quality": "quality_hits", "html": "html_hits", "mojibake": "mojibake_hits", "links": "link_count", "stuffing": "token_top", "density": "token_distinct", "noise": "noise_ratio", "paragraphs": "paragraph_similarity"}
_STATUS_SQL = oracle.gate_statuses(oracle.limits())


def _rule(rule: str) -> None:
    metric = _METRIC[rule]

    @query(f"gate_{rule}", f"WITH {oracle.gate_metrics()} SELECT doc_id, {metric} AS metric, {_STATUS_SQL[rule]} AS status FROM m")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = gate.cheap_metrics(table(spark, folder, "documents").select("doc_id", "text"), "text")
        if rule in gate.DEAR:
            rows = gate.dear_metrics(rows, "text")
        return rows.select("doc_id", F.col(metric).alias("metric"), gate.statuses()[rule].alias("status"))


for _r in _METRIC:
    _rule(_r)

_by_profile = oracle.gate_statuses(oracle.limits("profile"))
_cheap = " + ".join(f"({_by_profile[r]} = 'block')::INT" for r in gate.CHEAP)
_all_block = " + ".join(f"({_by_profile[r]} = 'block')::INT" for r in _METRIC)
_first = lambda rules: "CASE " + " ".join(f"WHEN {_by_profile[r]} = 'block' THEN '{r}'" for r in rules) + " END"
_warns = lambda rules: " + ".join(f"({_by_profile[r]} = 'warn')::INT" for r in rules)


@query(
    "gate_verdict",
    f"""WITH {oracle.gate_metrics()}, {oracle.densities()},
j AS (SELECT doc_id, profile, f, {_cheap} AS cb, CASE WHEN {_cheap} > 0 THEN {_cheap} ELSE {_all_block} END AS blocks, CASE WHEN {_cheap} > 0 THEN {_warns(gate.CHEAP)} ELSE {_warns(list(_METRIC))} END AS warns,
  CASE WHEN {_cheap} > 0 THEN {_first(gate.CHEAP)} ELSE {_first(list(_METRIC))} END AS first FROM m JOIN prof USING (doc_id))
SELECT doc_id, profile, blocks, warns, CASE WHEN blocks = 0 AND warns >= greatest(3, least(6, floor(f * 1.8))) THEN 'escalated' ELSE first END AS summary,
  blocks = 0 AND warns < greatest(3, least(6, floor(f * 1.8))) AS passed FROM j""",
)
def gate_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: each document's profile, and the gate's verdict with that profile's thresholds."""
    rows = profiles.classified(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "text", "profile")
    limits = F.broadcast(profiles.threshold_table(spark))
    joined = rows.join(limits, "profile")
    judged = gate.judged(joined, "text", {k: F.col(k) for k in profiles.THRESHOLDS})
    return judged.select("doc_id", "profile", "blocks", "warns", "summary", "passed")


@query("profile_densities", f"WITH {oracle.densities()} SELECT doc_id, profile, code_blocks, round(term_density, 6) AS term_density, round(data_density, 6) AS data_density, round(avg_paragraph, 6) AS avg_paragraph, round(narrative_density, 6) AS narrative_density FROM prof")
def profile_densities(spark: SparkSession, folder: str) -> DataFrame:
    rows = profiles.classified(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "profile", "code_blocks", *[F.round(c, 6).alias(c) for c in ("term_density", "data_density", "avg_paragraph", "narrative_density")])


# ---- tokens and vectors -------------------------------------------------------------------------------------------------------
@query("token_counts", f"SELECT doc_id, token, count(*) AS cnt FROM (SELECT doc_id, unnest({oracle.tokens('text', 3)}) AS token FROM documents) GROUP BY ALL")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), "doc_id", F.col("text")).select("doc_id", "token", "cnt")


_DOC_VECTORS = oracle.vectors("documents", "doc_id", "text")


@query("idf_table", f"WITH {_DOC_VECTORS} SELECT k AS token, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    found = vectors.counts(docs, "doc_id", "text")
    return vectors.idf(found, vectors.corpus_size(docs, "doc_id", "text")).select("token", "df", F.round("idf", 9).alias("idf"))


@query("bm25_norms", f"WITH {_DOC_VECTORS} SELECT doc_id, n_tokens, round(norm, 6) AS norm FROM vn")
def bm25_norms(spark: SparkSession, folder: str) -> DataFrame:
    long = vectors.vectors(table(spark, folder, "documents").where("text is not null"), "doc_id", "text")
    return vectors.norms(long, "doc_id").select("doc_id", "n_tokens", F.round("norm", 6).alias("norm"))


@query("top_tokens", f"WITH {_DOC_VECTORS} SELECT doc_id, r AS rank, k AS token FROM vr WHERE r <= 5")
def top_tokens(spark: SparkSession, folder: str) -> DataFrame:
    long = vectors.vectors(table(spark, folder, "documents").where("text is not null"), "doc_id", "text")
    return vectors.top(long, "doc_id").select("doc_id", "rank", "token")


@query(
    "fnv64_vocabulary",
    rf"""SELECT DISTINCT token, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS hash FROM (
SELECT token, list_reduce(list_transform(string_split(token, ''), lambda c: unicode(c)::UHUGEINT), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h
FROM (SELECT DISTINCT unnest({oracle.tokens('text', 3)}) AS token FROM documents))""",
)
def fnv64_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(tokens.tokens(F.col("text"), 3)).alias("token")).distinct()
    return words.select("token", hashing.fnv64("token").alias("hash"))


@query("fnv32_titles", f"SELECT title, {oracle.fnv32('title')} AS hash FROM (SELECT DISTINCT title FROM notes)")
def fnv32_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notes").select("title").distinct().select("title", hashing.fnv32_lossy("title").alias("hash"))


# ---- duplicates ---------------------------------------------------------------------------------------------------------------
_PAIRS = f"""n AS {NOTES}, {oracle.vectors('n', 'id', 'content', 'batch')},
tops AS (SELECT batch, id, list(k) AS top FROM vr WHERE r <= 5 GROUP BY ALL),
b AS (SELECT n.batch, n.id, n.content AS t, length(n.content) AS len, coalesce(top, []) AS top, coalesce(norm, 0) AS norm, coalesce(n_tokens, 0) AS nt FROM n LEFT JOIN tops USING (batch, id) LEFT JOIN vn USING (batch, id) WHERE n.content IS NOT NULL),
p AS (SELECT x.batch, x.id AS later, y.id AS earlier, x.t AS xt, y.t AS yt, x.len AS xl, y.len AS yl, x.norm AS xn, y.norm AS yn, x.nt AS xk, y.nt AS yk,
  coalesce(len(list_intersect(x.top, y.top)) / nullif(len(list_distinct(x.top || y.top)), 0), 0) AS o
  FROM b x JOIN b y ON x.batch = y.batch AND y.id < x.id AND abs(x.len - y.len) / greatest(x.len, y.len) <= 0.3),
q AS (SELECT * FROM p WHERE o > 0 OR least(xl, yl) <= 30),
dots AS (SELECT q.batch, later, earlier, sum(a.w * c.w) AS d FROM q JOIN v a ON a.batch = q.batch AND a.id = later JOIN v c ON c.batch = q.batch AND c.id = earlier AND c.k = a.k GROUP BY ALL),
s AS (SELECT q.batch, later, earlier, CASE WHEN xl < 100 AND yl < 100 THEN CASE WHEN 1 - levenshtein(xt, yt) / greatest(xl, yl) >= 0.7 THEN 1 - levenshtein(xt, yt) / greatest(xl, yl) END
  ELSE 0.5 * CASE WHEN xk < 3 OR yk < 3 THEN 0 ELSE least(1, coalesce(d, 0) / (xn * yn)) END + 0.3 * o END AS similarity FROM q LEFT JOIN dots USING (batch, later, earlier)),
pairs AS (SELECT batch, later, earlier, similarity FROM s WHERE similarity > 0.65)"""


@query("batch_near_dups", f"WITH {_PAIRS} SELECT batch, later, earlier, round(similarity, 6) AS similarity FROM pairs")
def batch_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    pairs = dedup.batch_pairs(distinct_notes(spark, folder), "id", "content", "id", ("batch",))
    return pairs.select("batch", "later", "earlier", F.round("similarity", 6).alias("similarity"))


_TITLED = (
    _PAIRS.replace("n.content AS t, length(n.content) AS len,", f"n.content AS t, length(n.content) AS len, list_distinct({oracle.tokens('coalesce(n.title, ' + chr(39) * 2 + ')', 3)}) AS tt,")
    .replace("x.nt AS xk, y.nt AS yk,", "x.nt AS xk, y.nt AS yk, coalesce(len(list_intersect(x.tt, y.tt)) / nullif(len(list_distinct(x.tt || y.tt)), 0), 0) AS tj,")
    .replace("+ 0.3 * o END AS similarity", "+ 0.3 * o + 0.2 * tj END AS similarity")
)


@query("batch_titled_dups", f"WITH {_TITLED} SELECT batch, later, earlier, round(similarity, 6) AS similarity FROM pairs")
def batch_titled_dups(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with titles in the score."""
    pairs = dedup.batch_pairs(distinct_notes(spark, folder), "id", "content", "id", ("batch",), title="title")
    return pairs.select("batch", "later", "earlier", F.round("similarity", 6).alias("similarity"))


@query(
    "batch_dropped",
    f"""WITH RECURSIVE {_PAIRS},
nodes AS (SELECT batch, id, list(earlier) FILTER (earlier IS NOT NULL) AS before, row_number() OVER (PARTITION BY batch ORDER BY id) AS n FROM (SELECT batch, later AS id, earlier FROM pairs UNION SELECT batch, earlier, NULL FROM pairs) GROUP BY batch, id),
walk AS (SELECT DISTINCT batch, 0::BIGINT AS n, []::VARCHAR[] AS kept FROM pairs UNION ALL
  SELECT w.batch, x.n, CASE WHEN len(list_intersect(w.kept, coalesce(x.before, []))) > 0 THEN w.kept ELSE list_append(w.kept, x.id) END FROM walk w JOIN nodes x ON x.batch = w.batch AND x.n = w.n + 1),
last AS (SELECT batch, arg_max(kept, n) AS kept FROM walk GROUP BY batch)
SELECT batch, later, min(earlier) AS earlier FROM pairs JOIN last USING (batch) WHERE NOT list_contains(kept, later) AND list_contains(kept, earlier) GROUP BY batch, later""",
)
def batch_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Notes dropped by the greedy pass over each batch, with the kept note that each repeats."""
    return dedup.greedy_kept(dedup.batch_pairs(distinct_notes(spark, folder), "id", "content", "id", ("batch",)), ("batch",))


def _fingerprints(long: str, key: str, order: str, weight: str) -> str:
    """Fingerprints of long rows (key, k, weight) with their hashes in ``h64``."""
    return f"""(SELECT {key}, sum(CASE WHEN v > 0 AND b < 32 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN v > 0 AND b >= 32 THEN 1::BIGINT << (b - 32) ELSE 0 END)::BIGINT AS hi FROM
(SELECT {key}, b, list_reduce([0.0::DOUBLE] || list(CASE WHEN ((CASE WHEN b < 32 THEN h0 ELSE h1 END) >> (b % 32)) & 1 = 1 THEN {weight} ELSE -{weight} END ORDER BY {order}), lambda s, x: trunc(s + x)) AS v
 FROM (SELECT x.*, (h64 % 4294967296)::BIGINT AS h0, (h64 // 4294967296)::BIGINT AS h1 FROM {long} x JOIN hashes USING (k)), (SELECT unnest(range(64))::INT AS b) GROUP BY {key}, b) GROUP BY {key})"""


def _named(sql: str) -> str:
    """The CTEs of vectors under other names, so that a second set can stand beside the first."""
    return re.sub(r"\b(sz|tx|tc|df|idf|v|vn|vr)\b", r"\1_t", sql)


_TITLE_COSINES = rf"""old_t AS (SELECT * FROM old WHERE title IS NOT NULL), {_named(oracle.vectors('old_t', 'id', 'title'))},
x_t AS (SELECT id, {oracle.length('title')} AS len, unnest({oracle.tokens('title', 3)}) AS k FROM new WHERE title IS NOT NULL), y_t AS (SELECT id, k, max(len) AS len, count(*) AS cnt FROM x_t GROUP BY ALL),
w_t AS (SELECT id, k, cnt / (cnt + 1.5 * (0.25 + 0.75 * len / avg_len)) * coalesce(idf_t, ln(n_docs + 1) + 1) AS w FROM y_t LEFT JOIN idf_t USING (k) CROSS JOIN sz_t),
n1_t AS (SELECT id, count(*) AS nt, sqrt(sum(w * w)) AS norm FROM w_t GROUP BY id), n2_t AS (SELECT id, count(*) AS nt, sqrt(sum(w * w)) AS norm FROM v_t GROUP BY id),
d_t AS (SELECT a, b, sum(x.w * y.w) AS dot FROM p JOIN w_t x ON x.id = a JOIN v_t y ON y.id = b AND y.k = x.k GROUP BY ALL),
titles AS (SELECT p.a, p.b, greatest(0, least(1, coalesce(dot, 0) / (n1_t.norm * n2_t.norm))) AS title FROM p JOIN n1_t ON n1_t.id = p.a JOIN n2_t ON n2_t.id = p.b LEFT JOIN d_t ON d_t.a = p.a AND d_t.b = p.b WHERE n1_t.nt >= 3 AND n2_t.nt >= 3)"""


def _matches_sql(titled: bool) -> str:
    title = _TITLE_COSINES if titled else "titles AS (SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS title WHERE false)"
    return f"""WITH n AS (SELECT * FROM {NOTES} WHERE content IS NOT NULL), old AS (SELECT * FROM n WHERE batch = 1), new AS (SELECT * FROM n WHERE batch > 1), {oracle.vectors('old', 'id', 'content')},
n2 AS (SELECT count(*) AS d2, avg({oracle.length('content')}) AS a2 FROM new),
tx2 AS (SELECT id, {oracle.length('content')} AS len, unnest({oracle.tokens('content', 3)}) AS k, generate_subscripts({oracle.tokens('content', 3)}, 1) - 1 AS pos FROM new),
tc2 AS (SELECT id, k, max(len) AS len, count(*) AS cnt, min(pos) AS pos FROM tx2 GROUP BY ALL),
v2 AS (SELECT id, k, len, pos, cnt / (cnt + 1.5 * (0.25 + 0.75 * len / ((n_docs * avg_len + d2 * a2) / (n_docs + d2)))) * coalesce(idf, ln(n_docs + 1) + 1) AS w FROM tc2 LEFT JOIN idf USING (k) CROSS JOIN sz CROSS JOIN n2),
all_tokens AS (SELECT DISTINCT k FROM (SELECT k FROM v UNION ALL SELECT k FROM v2)), hashes AS (SELECT k, {oracle.fnv64('k')} AS h64 FROM all_tokens),
f1 AS {_fingerprints('v', 'id', 'pos', 'w')}, f2 AS {_fingerprints('v2', 'id', 'pos', 'w')},
r1 AS (SELECT id, list(k) AS top FROM vr WHERE r <= 5 GROUP BY id), r2 AS (SELECT id, list(k) AS top FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY round(w, 12) DESC, pos) AS r FROM v2) WHERE r <= 5 GROUP BY id),
m1 AS (SELECT id, count(*) AS nt, sqrt(sum(w * w)) AS norm FROM v GROUP BY id), m2 AS (SELECT id, count(*) AS nt, sqrt(sum(w * w)) AS norm FROM v2 GROUP BY id),
p AS (SELECT f2.id AS a, f1.id AS b FROM f2 JOIN f1 ON bit_count(xor(f2.lo, f1.lo)) + bit_count(xor(f2.hi, f1.hi)) < 3),
q AS (SELECT a, b, {oracle.length('x.content')} AS la, {oracle.length('y.content')} AS lb, coalesce(r2.top, []) AS ta, coalesce(r1.top, []) AS tb FROM p JOIN new x ON x.id = a JOIN old y ON y.id = b LEFT JOIN r2 ON r2.id = a LEFT JOIN r1 ON r1.id = b),
s AS (SELECT *, coalesce(len(list_intersect(ta, tb)) / nullif(len(list_distinct(ta || tb)), 0), 0) AS o FROM q WHERE abs(la - lb) <= 0.3 * greatest(la, lb)),
d AS (SELECT a, b, sum(x.w * y.w) AS dot FROM s JOIN v2 x ON x.id = a JOIN v y ON y.id = b AND y.k = x.k GROUP BY ALL),
c0 AS (SELECT s.a, s.b, o, CASE WHEN m2.nt < 3 OR m1.nt < 3 OR m1.nt IS NULL OR m2.nt IS NULL THEN 0 ELSE greatest(0, least(1, coalesce(dot, 0) / (m1.norm * m2.norm))) END AS content FROM s LEFT JOIN d USING (a, b) LEFT JOIN m2 ON m2.id = a LEFT JOIN m1 ON m1.id = b WHERE o > 0 OR least(la, lb) <= 30),
{title}, c AS (SELECT c0.a, c0.b, CASE WHEN title IS NOT NULL THEN 0.5 * content + 0.3 * o + 0.2 * title ELSE 0.6 * content + 0.4 * o END AS score FROM c0 LEFT JOIN titles ON titles.a = c0.a AND titles.b = c0.b),
best AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM c)
SELECT new.id AS id, b AS other, round(CASE WHEN score IS NOT NULL AND {oracle.length('content')} < 100 THEN least(score * 1.15, 1) ELSE score END, 6) AS score FROM new LEFT JOIN (SELECT * FROM best WHERE r = 1) ON a = new.id"""


@query("corpus_matches", _matches_sql(False))
def corpus_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of later batches with their best partner in the first batch."""
    rows = distinct_notes(spark, folder).where("content is not null")
    return dedup.corpus_matches(rows.where("batch > 1"), rows.where("batch = 1"), "id", "content").select("id", "other", F.round("score", 6).alias("score"))


@query("titled_matches", _matches_sql(True))
def titled_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The same with titles in the score."""
    rows = distinct_notes(spark, folder).where("content is not null")
    return dedup.corpus_matches(rows.where("batch > 1"), rows.where("batch = 1"), "id", "content", "title").select("id", "other", F.round("score", 6).alias("score"))


@query(
    "simhash_pairs",
    f"""WITH t AS (SELECT id, unnest({oracle.tokens('content', 3)}) AS k FROM {NOTES} WHERE content IS NOT NULL), c AS (SELECT id, k, count(*)::DOUBLE AS w FROM t GROUP BY ALL),
e0 AS (SELECT DISTINCT path, mtime, tokens FROM dedup_features WHERE path IS NOT NULL), e1 AS (SELECT path, arg_max(tokens, (coalesce(mtime, -1), tokens)) AS tokens FROM e0 GROUP BY path),
e AS (SELECT path, x.token AS k, sum(x.cnt)::DOUBLE AS w FROM (SELECT path, unnest(tokens) AS x FROM e1) WHERE x.token IS NOT NULL AND NOT starts_with(x.token, 'W:') GROUP BY ALL),
hashes AS (SELECT k, {oracle.fnv64('k')} AS h64 FROM (SELECT k FROM c UNION SELECT k FROM e)),
a AS {_fingerprints('c', 'id', 'k', 'w')}, b AS {_fingerprints('e', 'path', 'k', 'w')}
SELECT id AS a, path AS b, bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS distance FROM a, b
WHERE a.lo + a.hi <> 0 AND b.lo + b.hi <> 0 AND bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) < 3""",
)
def simhash_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Notes and entries of the history in force whose fingerprints differ in fewer than three bits.

    Both sides vote by their counts, over n-grams and words alone: marked dictionary words are left out, as the client's list is not at hand.
    """
    notes_long = vectors.counts(distinct_notes(spark, folder).where("content is not null"), "id", "content").select(F.col("id").alias("key"), "token", F.col("cnt").cast("double").alias("w"))
    entries = changes.latest(table(spark, folder, "dedup_features").where("path is not null").select("path", F.struct(F.coalesce("mtime", F.lit(-1)), "tokens").alias("at"), "tokens"), "path", "at")
    spread = entries.select(F.col("path").alias("key"), F.explode("tokens").alias("t")).where("t.token is not null and not startswith(t.token, 'W:')")
    entry_long = spread.groupBy("key", F.col("t.token").alias("token")).agg(F.sum("t.cnt").cast("double").alias("w"))
    sides = [state.checkpointed(dedup.voted(long)).where("simhash <> 0") for long in (notes_long, entry_long)]
    return dedup.fingerprint_pairs(*sides)


@query(
    "nearest_vectors",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS vec_id, b.vec_id AS other, round(greatest(0, least(1, list_cosine_similarity(q.v, b.v))), 12) AS s FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS n FROM p)
SELECT vec_id, CASE WHEN s >= 0.3 THEN other END AS other, CASE WHEN s >= 0.3 THEN round(s, 9) END AS similarity FROM r WHERE n = 1""",
)
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    found = dense.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 0.3)
    return found.select("vec_id", "other", F.round("similarity", 9).alias("similarity"))


@query("fitted_vectors", "SELECT vec_id, round(list_sum(list_transform((embedding::DOUBLE[])[1:32], lambda x: x * x)), 9) AS energy, 32 AS dimension FROM embeddings")
def fitted_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vector = fitted(F.col("embedding"), 32)
    return table(spark, folder, "embeddings").select("vec_id", F.round(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x), 9).alias("energy"), F.size(vector).alias("dimension"))


_TITLES = "t AS (SELECT DISTINCT title AS t FROM notes WHERE length(title) > 0)"


@query("title_edits", f"WITH {_TITLES}, p AS (SELECT a.t AS a, b.t AS b FROM t a JOIN t b ON a.t < b.t AND substr(a.t, 1, 6) = substr(b.t, 1, 6)), {oracle.edit_similarities('p', 'a', 'b')} SELECT a, b, round(similarity, 9) AS similarity FROM es")
def title_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edit similarity of different titles that begin alike."""
    rows = table(spark, folder, "notes").where("length(title) > 0").select("title", F.substring("title", 1, 6).alias("start"))
    return dedup.group_edits(rows, "start", "title")


@query(
    "title_pairs",
    rf"""WITH {_TITLES}, p AS MATERIALIZED (SELECT a.t AS a, b.t AS b FROM t a JOIN t b ON a.t < b.t AND least(length(a.t), length(b.t)) >= 0.69 * greatest(length(a.t), length(b.t))
  AND levenshtein(a.t, b.t) <= CASE WHEN regexp_matches(a.t || b.t, '[^\x00-\x{{7FF}}‐-₿]') THEN 1.0 ELSE 0.65 END * greatest(length(a.t), length(b.t))), {oracle.edit_similarities('p', 'a', 'b')}
SELECT a, b, round(similarity, 9) AS similarity FROM es WHERE similarity >= 0.7 - 1e-9""",
)
def title_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Different titles whose edit similarity is at least 0.7."""
    found = dedup.edit_pairs(table(spark, folder, "notes").select("title").distinct(), "title", 0.7)
    return found.select("a", "b", F.round("similarity", 9).alias("similarity"))


# ---- search -------------------------------------------------------------------------------------------------------------------
_KEYWORDS = f"SELECT doc_id, list_distinct({oracle.tokens('text', 2)}) AS k FROM documents"


@query(
    "related_documents",
    f"""WITH kw AS ({_KEYWORDS}), x AS (SELECT doc_id, len(k) AS n, unnest(k) AS w FROM kw),
p AS (SELECT a.doc_id AS query, b.doc_id AS other, count(*) / (max(a.n) + max(b.n) - count(*)) AS s FROM x a JOIN x b USING (w) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, other) AS n FROM p WHERE s >= 0.08)
SELECT query, other, round(s, 9) AS similarity FROM r WHERE n <= 5""",
)
def related_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = related.related(docs.where("doc_id % 100 = 0"), docs, "doc_id", "text")
    return found.select("query", "other", F.round("similarity", 9).alias("similarity"))


def _diverse_sql(steps: int = 10) -> str:
    """The choices one after the other: each step takes the best of what is left."""
    out = f"""WITH kw AS ({_KEYWORDS}), x AS (SELECT doc_id, len(k) AS n, unnest(k) AS w FROM kw),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (max(a.n) + max(b.n) - count(*)) AS s FROM x a JOIN x b USING (w) GROUP BY ALL),
q AS (SELECT doc_id AS query FROM kw WHERE doc_id % 100 = 0), c AS (SELECT query, doc_id AS other, coalesce(s, 0) AS similarity FROM q JOIN kw ON doc_id <> query LEFT JOIN j ON j.a = query AND j.b = doc_id),
p1 AS (SELECT query, 1 AS rank, arg_min(other, (-(0.6 * similarity), other)) AS other FROM c GROUP BY query)"""
    for k in range(2, steps + 1):
        out += f""",
t{k} AS (SELECT c.query, c.other, max(coalesce(j.s, 0)) AS penalty FROM c JOIN p{k - 1} p ON p.query = c.query LEFT JOIN j ON j.a = p.other AND j.b = c.other WHERE (c.query, c.other) NOT IN (SELECT query, other FROM p{k - 1}) GROUP BY ALL),
p{k} AS (SELECT * FROM p{k - 1} UNION ALL SELECT query, {k}, arg_min(other, (-(0.6 * similarity - 0.4 * penalty), other)) FROM t{k} JOIN c USING (query, other) GROUP BY query)"""
    return out + f" SELECT query, rank, other, round(similarity, 9) AS similarity FROM p{steps} JOIN c USING (query, other)"


@query("related_diverse", _diverse_sql())
def related_diverse(spark: SparkSession, folder: str) -> DataFrame:
    """All documents compete, as far from the query as they may be."""
    docs = table(spark, folder, "documents").select("doc_id", tokens.keyword_set(F.col("text")).alias("keywords"))
    found = related.diverse_of_all(docs.where("doc_id % 100 = 0"), docs, "doc_id", "keywords")
    return found.select("query", "rank", "other", F.round("similarity", 9).alias("similarity"))


# ---- claims and notes ---------------------------------------------------------------------------------------------------------
@query("claims", oracle.claims_sql("documents", "doc_id", "text"))
def document_claims(spark: SparkSession, folder: str) -> DataFrame:
    return claims.claims(table(spark, folder, "documents"), "doc_id", "text")


_CLAIMS = oracle.claims_sql("n", "id", "content").strip()[len("WITH ") :]


@query(
    "claims_traced",
    f"""WITH n AS (SELECT DISTINCT id, content FROM notes WHERE content IS NOT NULL), cl AS (WITH {_CLAIMS}),
e AS (SELECT path, arg_max(content_preview, (mtime, content_preview)) AS content_preview FROM dedup_features WHERE path IS NOT NULL AND content_preview IS NOT NULL AND mtime IS NOT NULL GROUP BY path),
src AS (SELECT id, path, content_preview FROM n JOIN e ON substr(content, 1, 60) = substr(content_preview, 1, 60)),
j AS (SELECT cl.*, path, coalesce(content_preview, '') AS body FROM cl LEFT JOIN src USING (id)), {oracle.located('j', 'body')}
SELECT id, pos, claim, anchor, type, path, status, source_text, diff_note FROM lo""",
)
def claims_traced(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of every note's content, traced in the history entries (the last of each path) of the same beginning; without such an entry they are traced in nothing."""
    rows = distinct_notes(spark, folder).where("content is not null").select("id", "content").distinct()
    entries = table(spark, folder, "dedup_features").where("path is not null and content_preview is not null and mtime is not null")
    known = entries.groupBy("path").agg(F.max_by("content_preview", F.struct("mtime", "content_preview")).alias("content_preview"))
    beginning = lambda c: F.substring(F.col(c), 1, 60)
    source = rows.withColumn("start", beginning("content")).join(known.withColumn("start", beginning("content_preview")), "start").select("id", "path", "content_preview")
    found = claims.claims(rows, "id", "content").join(source, "id", "left")
    return claims.located(found, "anchor", "type", "content_preview").drop("content_preview")


@query("note_counts", "SELECT batch, count(*) AS notes, coalesce(sum(traced_count), 0) AS traced, coalesce(sum(needs_compare_count), 0) AS needs_compare, coalesce(sum(out_of_scope_count), 0) AS out_of_scope, count(*) FILTER (NOT coalesce(len(list_filter(verification, lambda v: v.status = '超源')) > 0, false)) AS verified FROM notes GROUP BY batch")
def note_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "notes")
    beyond = F.coalesce(F.exists("verification", lambda v: v["status"] == claims.BEYOND), F.lit(False))
    return rows.groupBy("batch").agg(F.count("*").alias("notes"), *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("traced_count", "traced"), ("needs_compare_count", "needs_compare"), ("out_of_scope_count", "out_of_scope"))], F.count_if(~beyond).alias("verified"))


@query("valid_notes", rf"SELECT id, NOT ({oracle.trim(chr(39) * 2 + ' || coalesce(title, ' + chr(39) * 2 + ')')} = '' OR length(coalesce(content, '')) < 10) AS valid, len(regexp_extract_all(coalesce(content, ''), '(?m)^##\s+')) > 1 AS several_topics FROM (SELECT DISTINCT id, title, content FROM notes)")
def valid_notes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "notes").select("id", "title", "content").distinct()
    return rows.select("id", notes.is_valid(F.col("title"), F.col("content")).alias("valid"), F.array_contains(notes.issues(F.col("title"), F.col("content")), "several_topics").alias("several_topics"))


@query(
    "note_tags",
    f"""SELECT id, CASE WHEN len(list_filter(coalesce(tags, []), lambda t: length(t) >= 2 AND NOT list_contains(['none', 'null', 'n/a', 'na', '无', '没有', '空', '未标注', '暂无', '待补充'], lower(t)))) > 0 THEN tags
ELSE (list_filter(c, lambda k: contains(k, 'note') OR contains('note', k)) || list_filter(c, lambda k: NOT (contains(k, 'note') OR contains('note', k))))[1:6] END AS tags
FROM (SELECT id, tags, {oracle.tag_candidates('title', 'content')} AS c FROM (SELECT DISTINCT id, title, content, tags FROM notes))""",
)
def note_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "notes").select("id", "title", "content", "tags").distinct()
    return rows.select("id", notes.ensured_tags(F.col("tags"), F.col("title"), F.col("content"), ["note"]).alias("tags"))


@query("clean_titles", f"WITH d AS (SELECT DISTINCT title FROM notes), {oracle.clean_titles('d', 'title', 'a')} SELECT title, clean FROM ac")
def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    return titles.cleaned(table(spark, folder, "notes").select("title").distinct(), "title", "clean")


@query("drawn_titles", f"WITH d AS (SELECT DISTINCT id, content FROM notes), {oracle.drawn_titles('d', 'content', 't_')} SELECT id, drawn FROM t_d")
def drawn_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles drawn from the contents."""
    return titles.drawn(table(spark, folder, "notes").select("id", "content").distinct(), "content", "drawn").select("id", "drawn")


@query("chunks", oracle.chunks("documents", "doc_id", "text", 1000, 100))
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return notes.chunked(table(spark, folder, "documents"), "doc_id", "text", 1000, 100)


@query("paragraphs", rf"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\n{oracle.WS}*\n'), lambda p: {oracle.trim('p')}), lambda p: p <> '')) AS paragraphs FROM documents")
def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", rf"\n{text.WHITE}*\n"), text.trimmed), lambda p: p != "")
    return table(spark, folder, "documents").select("doc_id", F.size(parts).alias("paragraphs"))


@query("parsed_outputs")
def parsed_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as if a model had written them."""
    return notes.notes_of(table(spark, folder, "documents"), "doc_id", "text")


@query("review_scores", """WITH r AS (SELECT o_orderkey AS k, o_custkey % 4 AS n, row_number() OVER () AS x FROM orders)
SELECT o_orderkey AS k, i AS idx, CASE WHEN i = 0 THEN greatest(1, least(5, (o_custkey % 7)))::INT ELSE 3 END AS insight, CASE WHEN i = 0 THEN greatest(1, least(5, (o_orderkey % 9)))::INT ELSE 3 END AS knowledge,
CASE WHEN i = 0 THEN greatest(1, least(5, (o_custkey % 7))) + greatest(1, least(5, (o_orderkey % 9))) ELSE 6 END::INT AS final,
CASE WHEN (CASE WHEN i = 0 THEN greatest(1, least(5, (o_custkey % 7))) + greatest(1, least(5, (o_orderkey % 9))) ELSE 6 END) >= 6 THEN '保留' ELSE '丢弃' END AS verdict
FROM (SELECT o_orderkey, o_custkey, unnest(range(0, o_custkey % 4)) AS i FROM orders)""")
def review_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Review outputs built from the orders' keys: the first note is scored, the others take the default."""
    raw = F.format_string('Scores: [{"index": 1, "insight_score": %d, "knowledge_score": %d, "verdict": "保留"}, {"index": 99, "insight_score": 5}]', F.col("o_custkey") % 7, F.col("o_orderkey") % 9)
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), raw.alias("raw"), (F.col("o_custkey") % 4).cast("int").alias("n"))
    return review.parsed(rows, "k", "raw", "n").drop("reason")


# ---- sources and sinks --------------------------------------------------------------------------------------------------------
@query("text_rows", f"SELECT page_id, {oracle.length('content')} AS len FROM url_extracts WHERE {oracle.trim('content')} <> ''")
def text_rows(spark: SparkSession, folder: str) -> DataFrame:
    return readers.text_rows(table(spark, folder, "url_extracts"), "content").select("page_id", text.utf16_length(F.col("content")).alias("len"))


@query("web_addresses", r"SELECT page_id, coalesce(lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://[^\s/]+', 1)) IN ('http', 'https'), false) AS web FROM url_extracts")
def web_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "url_extracts").select("page_id", readers.is_web_address(F.col("url")).alias("web"))


@query("folder_scan", "SELECT path, mtime FROM dedup_features WHERE path = 'archive' OR starts_with(path, 'archive/')")
def folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dedup_features").where(readers.in_folder(F.col("path"), "archive")).select("path", "mtime")


@query("front_matter", rf"SELECT doc_id, md5({oracle.trim('regexp_replace(text, ' + oracle.quoted(chr(92) + 'A' + chr(92) + 'x{FEFF}?---' + chr(92) + 's*' + chr(92) + 'n[' + chr(92) + 's' + chr(92) + 'S]*?' + chr(92) + 'n---' + chr(92) + 's*(?:' + chr(92) + 'n|' + chr(92) + 'z)') + ', ' + oracle.quoted('') + ')')}) AS body FROM documents")
def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(text.without_front_matter(F.col("text"))).alias("body"))


_FRONT = r"regexp_extract(text, '\A\x{FEFF}?---" + oracle.WS + r"*\n((?s:.*?))\n---', 1)"
_BODY = oracle.trim("regexp_replace(text, " + oracle.quoted(r"\A\x{FEFF}?---" + oracle.WS + r"*\n(?s:.*?)\n---" + oracle.WS + r"*(?:\n|\z)") + ", '')")


@query(
    "note_titles",
    rf"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_extract({_FRONT}, '(?m)^title:[ \t]*(.+)$', 1), '^["''\s]+|["''\s]+$', '', 'g'), ''), nullif(trim(regexp_extract(b, '(?m)^#[ \t]+(.+)$', 1)), ''), nullif(trim(regexp_extract(b, '(?m)^[ \t]*(\S.*)$', 1)), ''), doc_id::VARCHAR) AS title
FROM (SELECT doc_id, text, {_BODY} AS b FROM documents)""",
)
def note_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.note_title(F.col("text"), F.col("doc_id").cast("string")).alias("title"))


def _without_images(value: str) -> str:
    ending = "(?:jpg|jpeg|png|gif|webp|svg|bmp|ico)"
    no_space = "[^" + oracle.WS[1:]
    for pattern in (
        "(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=]+", r"!\[.*?\]\(.*?\)", "(?i)<img[^>]*/?>", r"(?is)<figure.*?</figure>", r"(?is)<figcaption.*?</figcaption>", r"(?is)<picture.*?</picture>",
        rf"(?im)^https?://{no_space}+\.{ending}(?:\?{no_space}*)?$", rf"(?im)^[A-Za-z0-9_-]+\.{ending}{oracle.WS}*$", rf"(?im)^图(?:片)?{oracle.WS}*$", r"\n{3,}",
    ):
        value = f"regexp_replace({value}, {oracle.quoted(pattern)}, {'chr(10) || chr(10)' if pattern.startswith(chr(92) + 'n') else oracle.quoted('')}, 'g')"
    return oracle.trim(value)


@query("clipboard_texts", f"SELECT DISTINCT id, {_without_images('content')} AS content FROM notes WHERE source = 'clipboard'")
def clipboard_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "notes").where("source = 'clipboard'")
    return rows.select("id", text.image_noise_removed(F.col("content")).alias("content")).distinct()


_HEAD = f"substr({oracle.FILLED.format('text')}, 1, 500)"


@query("truncated_texts", rf"SELECT doc_id, md5(replace(regexp_replace(h, '[\x{{10000}}-\x{{10FFFF}}]\z', ''), chr(64976), '')) AS head FROM (SELECT doc_id, {_HEAD} AS h FROM documents)")
def truncated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The beginning of every document by code units; characters beyond the basic plane count as two."""
    return table(spark, folder, "documents").select("doc_id", F.md5(text.truncated(F.col("text"), 500)).alias("head"))


_STEM = rf"substr({oracle.trim('regexp_replace(coalesce(title, ' + chr(39) * 2 + '), ' + oracle.quoted('[' + chr(92) * 2 + '/:*?' + chr(34) + '<>|#^' + chr(92) + '[' + chr(92) + ']' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 't]') + ', ' + oracle.quoted('-') + ', ' + oracle.quoted('g') + ')')}, 1, 100)"


@query("file_names", f"WITH n AS (SELECT id, CASE WHEN {_STEM} = '' THEN 'note' ELSE {_STEM} END AS stem FROM {NOTES}), r AS (SELECT id, stem, row_number() OVER (PARTITION BY stem ORDER BY id) - 1 AS k FROM n) SELECT id, CASE WHEN k = 0 THEN stem WHEN k <= 99 THEN stem || ' ' || k END AS file FROM r")
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = distinct_notes(spark, folder).select("id", notes.file_stem(F.col("title"), F.current_timestamp()).alias("stem"))
    return notes.numbered_names(rows, "stem", "id").select("id", "file")


@query(
    "markdown_notes",
    rf"""SELECT id, '---' || chr(10) || 'title: ' || {oracle.yaml("coalesce(title, '')")} || chr(10) || CASE WHEN coalesce(source, '') <> '' THEN 'source: ' || {oracle.yaml('source')} || chr(10) ELSE '' END
|| CASE WHEN len(coalesce(tags, [])) > 0 THEN 'tags: [' || array_to_string(list_transform(tags, lambda x: {oracle.yaml('x')}), ', ') || ']' || chr(10) ELSE '' END || '---' || chr(10) || chr(10)
|| {oracle.trim("regexp_replace(coalesce(content, ''), " + oracle.quoted(r"\n*来源[:：][^\n]*" + oracle.WS + r"*\z") + ", '')")} || chr(10) AS body
FROM (SELECT DISTINCT id, title, content, source, tags FROM notes)""",
)
def markdown_notes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "notes").select("id", "title", "content", "source", "tags").distinct()
    return rows.select("id", notes.markdown(F.coalesce("title", F.lit("")), F.col("content"), F.col("source"), F.col("tags")).alias("body"))


# ---- state and changes --------------------------------------------------------------------------------------------------------
@query("history_tail", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_tail(spark: SparkSession, folder: str) -> DataFrame:
    return state.history_tail(table(spark, folder, "events").select("event_id", "ts", "event_type"), "ts", "event_id")


@query("first_entries", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_entries(spark: SparkSession, folder: str) -> DataFrame:
    return state.first_entry(table(spark, folder, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query(
    "change_bursts",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 3600 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, min(ts) AS burst_start, max(ts) AS burst_end, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last FROM i GROUP BY user_id, island""",
)
def change_bursts(spark: SparkSession, folder: str) -> DataFrame:
    return changes.bursts(table(spark, folder, "events"), "user_id", "ts", "event_type", "event_id", 3600)


@query(
    "index_after_changes",
    """WITH e AS (SELECT user_id, event_type, event_id, ts, coalesce(ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events), false) AS late FROM events),
last AS (SELECT user_id, late, arg_max(event_type, (coalesce(ts, TIMESTAMP '0001-01-01'), event_id)) AS event_type, arg_max(event_id, (coalesce(ts, TIMESTAMP '0001-01-01'), event_id)) AS event_id FROM e GROUP BY ALL)
SELECT user_id, event_type, event_id FROM last WHERE NOT late AND user_id NOT IN (SELECT user_id FROM last WHERE late) UNION ALL SELECT user_id, event_type, event_id FROM last WHERE late AND event_type <> 'error'""",
)
def index_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """An index of users' last events: those up to the middle of the time make it, all later ones are the feed that keeps it current; errors remove."""
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts")
    at = F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp")).alias("ts"), "event_id").alias("at")
    middle = rows.agg(((F.unix_micros(F.min(F.col("ts").cast("timestamp"))) + F.unix_micros(F.max(F.col("ts").cast("timestamp")))) / 2).alias("middle"))
    split = rows.crossJoin(F.broadcast(middle)).select("user_id", "event_type", "event_id", at, F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) > F.col("middle"), F.lit(False)).alias("late"))
    base = changes.latest(split.where("not late").drop("late"), "user_id", "at")
    feed = split.where("late").drop("late").withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("modify"))
    return changes.upserted(base, feed, "user_id", "at").select("user_id", "event_type", "event_id")


from . import catalogue_more  # noqa: E402, F401  registers its queries
