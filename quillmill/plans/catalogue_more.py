"""Further queries of the core: choices of profile, pages, outputs and answers of services, caches, feeds, and what lists show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionary, labels, text
from ..operators import claims, dedup, dense, gate, notes, profiles, review, services, vectors
from ..sources import html, readers, state
from ..streaming import changes
from . import oracle
from .registry import NOTES, distinct_notes, query, table

_STATUS = oracle.gate_statuses(oracle.limits())

# ---- gate and profiles --------------------------------------------------------------------------------------------------------
_AUTO = oracle.densities()


@query(
    "profile_choice",
    f"""WITH {_AUTO}, c AS (SELECT doc_id, CASE WHEN manual IN ('dense', 'balanced', 'sparse') THEN manual ELSE profile END AS profile FROM (SELECT doc_id, CASE lower(trim(source)) WHEN 'web_clip' THEN 'sparse' WHEN 'minutes' THEN 'dense' ELSE 'auto' END AS manual FROM documents) JOIN prof USING (doc_id))
SELECT doc_id, profile, (CASE profile WHEN 'dense' THEN 60 WHEN 'sparse' THEN 30 ELSE 80 END)::DOUBLE AS min_length, (CASE profile WHEN 'dense' THEN 0.75 WHEN 'sparse' THEN 0.55 ELSE 0.65 END)::DOUBLE AS cross_batch FROM c""",
)
def profile_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles set by hand for two sources, the detected ones elsewhere, and their thresholds with one of them overridden."""
    rows = profiles.classified(table(spark, folder, "documents").select("doc_id", "text", "source"), "text")
    source = F.lower(F.trim("source"))
    manual = F.when(source == "web_clip", "sparse").when(source == "minutes", "dense").otherwise("auto")
    chosen = rows.select("doc_id", profiles.chosen_profile(manual, F.col("profile")).alias("profile"))
    return chosen.join(profiles.threshold_table(spark, {"dense": {"min_length": 60}}), "profile").select("doc_id", "profile", "min_length", "cross_batch")


@query("gate_selection", f"WITH m AS (SELECT id, {oracle.length('coalesce(content, ' + chr(39) * 2 + ')')} AS len FROM (SELECT DISTINCT id, content FROM notes)) SELECT id, CASE WHEN len < 30 THEN 'block' WHEN len < 120 THEN 'warn' WHEN len > 50000 THEN 'block' WHEN len > 20000 THEN 'warn' ELSE 'ok' END AS status FROM m")
def gate_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The length rule on selected pieces of text."""
    rows = gate.cheap_metrics(table(spark, folder, "notes").select("id", "content").distinct(), "content")
    return rows.select("id", gate.statuses(selection=True)["length"].alias("status"))


_BLOCKED = " OR ".join(f"{_STATUS[r]} = 'block'" for r in _STATUS)
_WARNED = " + ".join(f"({_STATUS[r]} = 'warn')::INT" for r in _STATUS)


@query("gate_forced", f"WITH {oracle.gate_metrics()} SELECT doc_id, true AS admitted, NOT ({_BLOCKED}) AND ({_WARNED}) < greatest(3, least(6, floor(f * 1.8))) AS passed FROM m")
def gate_forced(spark: SparkSession, folder: str) -> DataFrame:
    """The gate with force: everything goes on, the verdict stays visible."""
    judged = gate.judged(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return gate.forced(judged, True).select("doc_id", "admitted", "passed")


# ---- pages --------------------------------------------------------------------------------------------------------------------
def _squeezed(value: str) -> str:
    return f"regexp_replace({value}, '{oracle.WS}+', ' ', 'g')"


_PAGE = "'Notes' || coalesce(text, '') || 'Last line.' || chr(10) || chr(10) || '【配图说明】' || chr(10) || '[图] A picture'"
_READ = oracle.trim(_squeezed(_PAGE))


@query("html_pages", f"WITH p AS (SELECT doc_id, {_READ} AS c FROM documents) SELECT doc_id, {oracle.length('c')} >= 100 AS success, CASE WHEN {oracle.length('c')} >= 100 THEN md5(c) END AS content, 'Notes' AS title, CASE WHEN {oracle.length('c')} >= 100 THEN '2024-01-02' END AS publish_date, CASE WHEN {oracle.length('c')} < 50 THEN 'REQUIRES_JS' WHEN {oracle.length('c')} < 100 THEN 'CONTENT_TOO_SHORT' END AS error_code FROM p")
def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages among menus, advertising and footers; the body is read back."""
    body = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit('<!doctype html><html><head><title>Site</title><meta name="date" content="2024-01-02"><script>if (1 < 2) { a = "</p>" }</script></head><body><nav>Home About</nav><header>Site</header><article><h1>Notes</h1><div class="share">Share this</div><p>'),
        body,
        F.lit('<p>Last line.<div class="ad-top">Buy now</div><!-- note --><ul class="related"><li>One<li>Two</ul><img alt="A picture"><span hidden>gone</span></article><footer>End</footer></body></html>'),
    )
    rows = html.extract_pages(table(spark, folder, "documents").select("doc_id", page.alias("html")), "html")
    return rows.select("doc_id", "read.success", F.md5("read.content").alias("content"), "read.title", "read.publish_date", "read.error_code")


@query(
    "source_titles",
    rf"""WITH u AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN coalesce(error, '') || ' ' || coalesce(error_code, '') ELSE 'HTTP ' || (400 + page_id % 110)::VARCHAR END AS message FROM url_extracts)
SELECT page_id, CASE WHEN regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) <> '' THEN lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) ELSE substr(url, 1, 50) END AS title,
CASE WHEN contains(lower(url), 'siliconflow') THEN 'SiliconFlow' WHEN contains(lower(url), 'deepseek') THEN 'DeepSeek' WHEN contains(lower(url), 'openai') THEN 'OpenAI' WHEN contains(lower(url), 'hunyuan') THEN 'Hunyuan' ELSE 'AI' END AS provider,
CASE WHEN regexp_matches(message, '401|Unauthorized') THEN 'API Key 无效或已过期，请在设置中更新' WHEN regexp_matches(message, '429|Too Many Requests') THEN '请求过于频繁或额度不足，请稍后重试' WHEN contains(message, '402') THEN 'API 额度不足，请检查账户余额'
WHEN regexp_matches(message, '500|502|503') THEN 'API 服务暂时不可用，请稍后重试' WHEN regexp_matches(message, 'timeout|ETIMEDOUT|ECONNREFUSED') THEN '网络连接超时，请检查 API URL 或网络设置' WHEN regexp_matches(message, 'Failed to fetch|network') THEN '网络连接失败，请检查网络或 API URL' ELSE message END AS message FROM u""",
)
def source_titles(spark: SparkSession, folder: str) -> DataFrame:
    """What pages are called, which service their address would belong to, and what their errors mean."""
    own = F.concat(F.coalesce("error", F.lit("")), F.lit(" "), F.coalesce("error_code", F.lit("")))
    message = F.when(F.col("page_id") % 2 == 0, own).otherwise(F.concat(F.lit("HTTP "), (400 + F.col("page_id") % 110).cast("string")))
    rows = table(spark, folder, "url_extracts").select("page_id", "url", message.alias("message"))
    return rows.select("page_id", labels.source_title(F.lit("url"), F.col("url")).alias("title"), labels.provider(F.coalesce("url", F.lit(""))).alias("provider"), labels.friendly_error(F.col("message")).alias("message"))


@query(
    "fetched_pages",
    f"""WITH u AS (SELECT page_id, url, CASE WHEN url IS NULL THEN NULL WHEN length(url) % 2 = 1 THEN {oracle.trim("repeat(url || ' ', 3)")} ELSE {oracle.trim(_squeezed("'Page' || repeat(url || ' ', 10)"))} END AS c FROM url_extracts)
SELECT page_id, url IS NOT NULL AS success, md5(c) AS content, CASE WHEN url IS NOT NULL THEN 'Page' END AS title, CASE WHEN url IS NULL THEN 'EMPTY_HTML' END AS error_code FROM u""",
)
def fetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses read through a stand-in for the network: every other page needs scripts and is tried again through a renderer."""
    from html import escape

    def fetch(url: str | None) -> str | None:
        if url is None:
            return None
        return '<html><body><div id="app"></div></body></html>' if len(url) % 2 else f"<article><h1>Page</h1><p>{escape((url + ' ') * 10)}</article>"

    rows = readers.fetched(table(spark, folder, "url_extracts").select("page_id", "url"), "url", fetch, lambda url: "# Page\n" + (url + " ") * 3)
    return rows.select("page_id", "read.success", F.md5("read.content").alias("content"), "read.title", "read.error_code")


@query("backlinks", f"SELECT id, content || chr(10) || chr(10) || '[[' || id || ']]' || chr(10) AS content FROM {NOTES} WHERE content IS NOT NULL")
def backlinks(spark: SparkSession, folder: str) -> DataFrame:
    rows = distinct_notes(spark, folder).where("content is not null")
    return rows.select("id", notes.backlink(F.col("content"), F.col("id")).alias("content"))


@query("discovery_scan", "SELECT path, mtime FROM dedup_features WHERE path IS NOT NULL")
def discovery_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The scan of a search index, where no folder means all."""
    rows = table(spark, folder, "dedup_features").where("path is not null")
    return rows.where(readers.in_folder(F.col("path"), "", empty_means_all=True)).select("path", "mtime")


# ---- outputs and answers ------------------------------------------------------------------------------------------------------
_GOOD = "(SELECT DISTINCT id, title, content FROM notes WHERE trim(content) <> '')"


@query(
    "json_outputs",
    f"""WITH d0 AS (SELECT * FROM {_GOOD}), g AS (SELECT *, coalesce(title, '') AS given FROM d0), {oracle.clean_titles('g', 'given', 't_')}, {oracle.drawn_titles('d0', 'content', 'u_')}
SELECT t_c.id AS id, CASE WHEN {oracle.trim('t_c.given')} = '' THEN u_d.drawn WHEN t_c.clean <> '' THEN t_c.clean ELSE t_c.given END AS title, md5(t_c.content) AS content FROM t_c JOIN u_d ON t_c.id = u_d.id AND t_c.content = u_d.content AND t_c.title IS NOT DISTINCT FROM u_d.title""",
)
def json_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Notes packed into JSON among other words, as a model writes them, and parsed back; titles are cleaned or drawn from the content."""
    rows = table(spark, folder, "notes").select("id", "title", "content").distinct().where("trim(content) <> ''")
    packed = F.to_json(F.struct(F.array(F.struct(F.coalesce("title", F.lit("")).alias("title"), "content")).alias("notes")))
    raw = F.concat(F.lit("Here you are { not json:\n```json\n"), packed, F.lit("\n```\nDone }"))
    return notes.notes_of(rows.select("id", raw.alias("raw")), "id", "raw").select("id", "title", F.md5("content").alias("content"))


@query("tags_parsed", "SELECT id, list_filter(tags, lambda t: t <> '') AS tags FROM (SELECT DISTINCT id, tags FROM notes WHERE tags IS NOT NULL AND len(list_filter(tags, lambda t: t IS NULL OR regexp_matches(t, '[,，\\[\\]\"'']|^\\s|\\s$'))) = 0)")
def tags_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Tags written as a list in text and read back; tags that hold separators themselves can't be told apart and are left out on both sides."""
    rows = table(spark, folder, "notes").where("tags is not null").select("id", "tags").distinct()
    rows = rows.where(~F.exists("tags", lambda t: t.isNull() | t.rlike(r"[,，\[\]\"']|^\s|\s$")))
    raw = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("]"))
    return rows.select("id", notes.tags_of(raw).alias("tags"))


@query(
    "quotes_checked",
    f"""WITH v AS (SELECT id, content, unnest(verification) AS v FROM (SELECT DISTINCT id, content, verification FROM notes)), s AS (SELECT id, v.claim AS claim, v.status AS status, v.source_text AS q, trim({_squeezed("coalesce(content, '')")}) AS c FROM v)
SELECT id, claim, CASE WHEN status = '需对比' AND coalesce(q, '') <> '' AND NOT contains(c, trim({_squeezed('q')})) THEN '超源' WHEN status = '需对比' THEN '需对比' ELSE '超源' END AS status FROM s""",
)
def quotes_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of earlier comparisons, settled against the notes' own contents: a quotation that isn't there is beyond the source."""
    rows = table(spark, folder, "notes").select("id", F.coalesce("content", F.lit("")).alias("content"), "verification").distinct().select("id", "content", F.explode("verification").alias("v"))
    flat = rows.select("id", "content", F.col("v.claim").alias("claim"), F.col("v.status").alias("answer"), F.col("v.source_text").alias("quote"))
    return claims.settled(flat, "answer", "quote", "content").select("id", "claim", "status")


@query(
    "review_grades",
    """WITH r AS (SELECT o_orderkey AS k, unnest(range(0, 3)) AS idx, o_custkey, o_orderkey FROM orders), s AS (SELECT k, idx, CASE WHEN idx = 0 THEN greatest(1, least(5, o_custkey % 7)) + greatest(1, least(5, o_orderkey % 9)) ELSE 6 END AS final FROM r)
SELECT k, idx, final, CASE WHEN final >= 8 THEN '优' WHEN final >= 6 THEN '良' WHEN final >= 4 THEN '中' ELSE '差' END AS grade, round(avg(final) OVER (PARTITION BY k), 6) AS mean, CASE WHEN final >= 6 THEN row_number() OVER (PARTITION BY k, final >= 6 ORDER BY final DESC, idx) END AS place FROM s""",
)
def review_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Grades, the mean of each review, and the place of the kept notes, best first."""
    raw = F.format_string('[{"index": 1, "insight_score": %d, "knowledge_score": %d}]', F.col("o_custkey") % 7, F.col("o_orderkey") % 9)
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), raw.alias("raw"), F.lit(3).alias("n"))
    scored = state.checkpointed(review.parsed(rows, "k", "raw", "n"))
    kept = review.places(scored, "k")
    means = scored.groupBy("k").agg(F.round(F.avg("final"), 6).alias("mean"))
    return scored.join(means, "k").join(kept, ["k", "idx"], "left").select("k", "idx", "final", review.grade(F.col("final")).alias("grade"), "mean", "place")


@query(
    "notes_shown",
    """SELECT id, coalesce(needs_compare_count, 0) > 0 OR coalesce(out_of_scope_count, 0) > 0 AS issues, coalesce(traced_count, 0) > 0 AND coalesce(needs_compare_count, 0) = 0 AND coalesce(out_of_scope_count, 0) = 0 AS traced,
contains(lower(coalesce(title, '')), 'the') OR contains(lower(coalesce(content, '')), 'the') AS found,
CASE WHEN coalesce(out_of_scope_count, 0) > 0 THEN '综合判断 · 超源' WHEN coalesce(needs_compare_count, 0) > 0 THEN '综合判断 · 需对比' WHEN coalesce(traced_count, 0) > 0 THEN '综合判断 · 已溯源' ELSE '综合判断' END AS label
FROM (SELECT DISTINCT id, title, content, traced_count, needs_compare_count, out_of_scope_count FROM notes)""",
)
def notes_shown(spark: SparkSession, folder: str) -> DataFrame:
    """Each note's label, and the lists of results in which it stands."""
    rows = state.checkpointed(table(spark, folder, "notes").select("id", "title", "content", "traced_count", "needs_compare_count", "out_of_scope_count").distinct())
    out = rows.select("id", review.label(F.col("traced_count"), F.col("needs_compare_count"), F.col("out_of_scope_count")).alias("label"))
    for name, found in (("issues", review.shown(rows, "issues")), ("traced", review.shown(rows, "traced")), ("found", review.shown(rows, search="The"))):
        out = out.join(found.select("id", F.lit(True).alias(name)), "id", "left")
    return out.na.fill(False, ["issues", "traced", "found"])


@query(
    "edited_notes",
    f"""WITH n AS (SELECT DISTINCT id, title, content, verification FROM notes)
SELECT id, CASE WHEN title IS NOT DISTINCT FROM t AND content IS NOT DISTINCT FROM c THEN coalesce(len(verification), 0) ELSE 0 END AS checks FROM (SELECT *, {oracle.trim('title')} AS t, {oracle.trim('content')} AS c FROM n)
UNION ALL SELECT 'restored-' || id, 0 FROM n WHERE content IS NULL""",
)
def edited_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes trimmed by hand lose their verification if that changes them; notes without content come back as removed ones do."""
    rows = table(spark, folder, "notes").select("id", "title", "content", "verification").distinct()
    after = rows.select("id", "title", "content", review.edited(F.col("title"), F.col("content"), text.trimmed(F.col("title")), text.trimmed(F.col("content")), F.col("verification")).alias("verification"))
    both = review.restored(after, rows.where("content is null").select("id", "title", "content"), "id")
    return both.select("id", F.coalesce(F.array_size("verification"), F.lit(0)).alias("checks"))


@query("surviving_pending", "SELECT DISTINCT id FROM notes WHERE needs_compare_count > 0 AND id IN (SELECT id FROM notes WHERE NOT coalesce(len(list_filter(verification, lambda v: v.status = '超源')) > 0, false))")
def surviving_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that wait for a comparison and are still there after the filter of verified ones."""
    rows = table(spark, folder, "notes")
    return review.survivors(rows.where("needs_compare_count > 0").select("id").distinct(), claims.only_verified(rows), "id")


# ---- matches ------------------------------------------------------------------------------------------------------------------
_NEAR = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS vec_id, b.vec_id AS other, round(greatest(0, least(1, list_cosine_similarity(q.v, b.v))), 12) AS s FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS n FROM p), sem AS (SELECT vec_id, CASE WHEN s >= 0.3 THEN other END AS so, CASE WHEN s >= 0.3 THEN s END AS ss FROM r WHERE n = 1)"""


@query(
    "merged_matches",
    f"""WITH {_NEAR}, lex AS (SELECT vec_id, label AS lo, (vec_id % 700) / 1000.0::DOUBLE AS ls FROM embeddings WHERE vec_id % 100 = 0),
m AS (SELECT vec_id, CASE WHEN coalesce(ss, 0) > coalesce(ls, 0) THEN so ELSE lo END AS other, greatest(coalesce(ls, 0), coalesce(ss, 0)) AS similarity FROM lex FULL JOIN sem USING (vec_id))
SELECT vec_id, other::BIGINT AS other, round(similarity, 9) AS similarity, CASE WHEN similarity >= 0.5 THEN 'pending_high' WHEN similarity >= 0.35 THEN 'pending' ELSE 'keep' END AS band FROM m""",
)
def merged_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches by vectors merged with other matches of the same rows, and the band of each."""
    rows = table(spark, folder, "embeddings")
    semantic = dense.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 0.3).withColumnRenamed("similarity", "score")
    lexical = rows.where("vec_id % 100 = 0").select("vec_id", F.col("label").cast("long").alias("other"), (F.col("vec_id") % 700 / 1000.0).alias("score"))
    found = dedup.merged_matches(lexical, semantic, "vec_id")
    return found.select("vec_id", "other", F.round("similarity", 9).alias("similarity"), dedup.band_of(F.col("similarity"), 0.5, 0.35).alias("band"))


@query(
    "failed_vectors",
    "SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 0 END AS zero, CASE WHEN vec_id % 7 <> 0 THEN round(greatest(0, least(1, list_cosine_similarity((embedding::DOUBLE[])[1:32], (embedding::DOUBLE[])[33:64]))), 9) END AS halves FROM embeddings",
)
def failed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that a service failed to give (marked by their first number) stay out of every comparison."""
    from ..functions.similarity import cosine, fitted

    marked = F.when(F.col("vec_id") % 7 == 0, F.concat(F.array(F.lit(-99999.0)), F.col("embedding").cast("array<double>"))).otherwise(F.col("embedding").cast("array<double>"))
    rows = table(spark, folder, "embeddings").select("vec_id", fitted(marked, 64).alias("v"))
    nothing = F.array_repeat(F.lit(0.0), 64)
    return rows.select("vec_id", cosine(F.col("v"), nothing).cast("int").alias("zero"), F.round(cosine(F.slice("v", 1, 32), F.slice("v", 33, 32)), 9).alias("halves"))


# ---- state and changes --------------------------------------------------------------------------------------------------------
@query(
    "cache_states",
    """WITH live AS (SELECT path, max(mtime) AS mtime FROM dedup_features WHERE path IS NOT NULL GROUP BY path), cache AS (SELECT DISTINCT path, mtime FROM dedup_features WHERE path IS NOT NULL AND coalesce(simhash_fp, '') <> ''),
x AS (SELECT live.path, live.mtime, cache.path IS NOT NULL AS hit FROM live LEFT JOIN cache ON cache.path = live.path AND cache.mtime = live.mtime)
SELECT path, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS state FROM x UNION ALL SELECT path, 'kept' FROM cache SEMI JOIN live ON cache.path = live.path AND cache.mtime = live.mtime""",
)
def cache_states(spark: SparkSession, folder: str) -> DataFrame:
    """Files against a cache of their features: hits, misses, and what a cleaning of the cache keeps."""
    rows = table(spark, folder, "dedup_features").where("path is not null")
    live = rows.groupBy("path").agg(F.max("mtime").alias("mtime"))
    cache = rows.where("coalesce(simhash_fp, '') <> ''").select("path", "mtime").distinct()
    hits, misses = state.cache_split(live, cache, ["path", "mtime"])
    named = [df.select("path", F.lit(name).alias("state")) for df, name in ((hits, "hit"), (misses, "miss"), (state.cleaned_cache(cache, live, ["path", "mtime"]), "kept"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "fresh_pages",
    "WITH n AS (SELECT max(fetched_at) AS now FROM url_extracts), u AS (SELECT DISTINCT page_id, fetched_at FROM url_extracts WHERE fetched_at IS NOT NULL) SELECT page_id, fetched_at FROM u, n WHERE fetched_at >= now - INTERVAL 2592000 SECOND ORDER BY fetched_at DESC, page_id LIMIT 200",
)
def fresh_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of fetched pages: those of the last thirty days, of these the 200 used last."""
    rows = table(spark, folder, "url_extracts").select("page_id", "fetched_at").where("fetched_at is not null").distinct()
    now = rows.agg(F.max("fetched_at")).first()[0]
    return state.fresh(rows, "fetched_at", F.lit(now), 2_592_000, 200, "page_id")


@query("first_submissions", "SELECT hash, arg_min(page_id, (fetched_at, page_id)) AS page_id FROM (SELECT md5(content) AS hash, page_id, fetched_at FROM url_extracts WHERE content IS NOT NULL AND fetched_at IS NOT NULL) GROUP BY hash")
def first_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Of pages with equal contents the one that came first."""
    rows = table(spark, folder, "url_extracts").where("content is not null and fetched_at is not null").select(F.md5("content").alias("hash"), "page_id", F.struct("fetched_at", "page_id").alias("at"))
    return changes.first_submissions(rows, "hash", "at").select("hash", "page_id")


@query(
    "split_renames",
    """WITH e AS (SELECT ts, 'note-' || user_id AS path, 'old-' || (event_id % 50) AS old_path, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' WHEN 2 THEN 'delete' ELSE 'rename' END AS op FROM events)
SELECT ts, path, op FROM e WHERE op <> 'rename' UNION ALL SELECT ts, old_path, 'delete' FROM e WHERE op = 'rename' UNION ALL SELECT ts, path, 'modify' FROM e WHERE op = 'rename'""",
)
def split_renames(spark: SparkSession, folder: str) -> DataFrame:
    """A feed of file changes where a rename removes the old path and upserts the new one."""
    op = F.element_at(F.array(*map(F.lit, ("create", "modify", "delete", "rename"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, folder, "events").select("ts", F.concat(F.lit("note-"), "user_id").alias("path"), F.concat(F.lit("old-"), F.col("event_id") % 50).alias("old_path"), op.alias("op"))
    return changes.split_renames(rows)


_SPLIT = "(SELECT min(batch) + (max(batch) - min(batch)) / 2 FROM notes)"


@query(
    "frequencies_after_changes",
    f"""WITH n AS {NOTES}, t AS (SELECT DISTINCT id, batch, source, unnest({oracle.tokens('content', 3)}) AS token FROM n WHERE content IS NOT NULL), c AS (SELECT token, CASE WHEN batch <= {_SPLIT} AND coalesce(source, '') = 'clipboard' THEN 0 ELSE 1 END AS sign FROM t)
SELECT token, sum(sign)::BIGINT AS df FROM c GROUP BY token HAVING sum(sign) > 0""",
)
def frequencies_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequencies of the early batches, kept current as clipboard notes among them go and the late batches come."""
    rows = distinct_notes(spark, folder).where("content is not null")
    ends = rows.agg(F.min("batch").alias("a"), F.max("batch").alias("b")).first()
    late = F.col("batch") > (ends.a or 0) + ((ends.b or 0) - (ends.a or 0)) / 2
    of = lambda df: vectors.counts(df, "id", "content").select("token")
    base = of(rows.where(~late)).groupBy("token").agg(F.count("*").alias("df"))
    gone = of(rows.where(~late & (F.coalesce("source", F.lit("")) == "clipboard"))).withColumn("sign", F.lit(-1))
    come = of(rows.where(late)).withColumn("sign", F.lit(1))
    return changes.frequencies_after(base, gone.unionByName(come))


# ---- dictionary ---------------------------------------------------------------------------------------------------------------
_GRAMS = " || ".join(f"CASE WHEN length(r) >= {n} THEN list_transform(range(1, length(r) - {n} + 2), lambda i: substr(r, i, {n})) ELSE [] END" for n in (1, 2, 3, 4))
_CUTS = " UNION ALL ".join(f"SELECT gram, n, substr(gram, 1, {k}) AS a, substr(gram, {k + 1}) AS b FROM c WHERE length(gram) > {k} AND n >= 5" for k in (1, 2, 3))


@query(
    "dictionary_words",
    rf"""WITH c AS (SELECT gram, count(*) AS n FROM (SELECT unnest(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[\x{{4E00}}-\x{{9FFF}}]+'), lambda r: {_GRAMS}))) AS gram FROM documents) GROUP BY gram),
t AS (SELECT sum(n) AS total FROM c WHERE length(gram) = 1), k AS ({_CUTS}), s AS (SELECT k.gram AS word, max(k.n) AS n, min(k.n * total / (x.n * y.n::DOUBLE)) AS bond FROM k JOIN c x ON x.gram = a JOIN c y ON y.gram = b CROSS JOIN t GROUP BY k.gram)
SELECT word, n FROM s WHERE bond >= 20""",
)
def dictionary_words(spark: SparkSession, folder: str) -> DataFrame:
    """Han words of the corpus, for segmentation."""
    return dictionary.words(table(spark, folder, "documents"), "text")


@query("word_counts")
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary words in every document, by the best path through the corpus' own dictionary."""
    rows = table(spark, folder, "documents")
    return dictionary.word_counts(rows, "doc_id", "text", state.checkpointed(dictionary.words(rows, "text")))


# ---- services, with deterministic stand-ins -----------------------------------------------------------------------------------
@query("deep_notes")
def deep_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of documents chunk by chunk, from a client that needs no network."""
    return services.deep_notes(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", size=1000, overlap=100).select("doc_id", "chunk_pos", "note_pos", "title", "content")


@query("embedded_texts", "SELECT doc_id, 64 AS dimension FROM documents")
def embedded_texts(spark: SparkSession, folder: str) -> DataFrame:
    return services.embedded(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.size("vector").alias("dimension"))


@query("reviewed_notes", f"SELECT batch, idx::INT AS idx, 6 AS final, false AS success FROM (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY id) - 1 AS idx FROM {NOTES}) WHERE batch IS NOT NULL")
def reviewed_notes(spark: SparkSession, folder: str) -> DataFrame:
    """A review whose service fails: every note of the batch keeps the default."""

    def broken(prompt: str) -> str:
        raise services.ServiceError("no network", retry=False)

    rows = distinct_notes(spark, folder).where("batch is not null")
    return services.reviewed(rows, "batch", "id", "title", "content", broken).select("batch", "idx", "final", "success")


@query("compared_claims", "SELECT DISTINCT id, v.claim AS claim, '超源' AS status FROM (SELECT id, unnest(verification) AS v FROM notes) WHERE v.claim IS NOT NULL AND v.status <> '已溯源'")
def compared_claims(spark: SparkSession, folder: str) -> DataFrame:
    """A comparison whose service quotes what no source holds: every claim is beyond the source."""

    def inventing(prompt: str) -> str:
        return '[{"index": 0, "status": "需对比", "source_text": "words that no source holds"}, {"index": "x"}]'

    rows = table(spark, folder, "notes").select("id", F.coalesce("content", F.lit("")).alias("content"), F.explode("verification").alias("v")).where("v.claim is not null and v.status <> '已溯源'")
    return services.compared(rows.select("id", "content", F.col("v.claim").alias("claim")), "id", "claim", "content", inventing).select("id", "claim", "status")
