"""Operators on small tables, against brute force and stated cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions.similarity import hamming
from quillmill.operators import claims, dedup, dense, gate, notes, profiles, related, review, services, titles, vectors
from quillmill.sources import html, readers, state
from quillmill.streaming import changes


FIXED = {
    "stop": (113, "db6dbea3"), "ads": (22, "264818ea"), "bait": (9, "1d18e4e7"), "ad patterns": (4, "b68c456e"), "html": (5, "d70bf22d"), "mojibake": (5, "f1b30084"), "links": (2, "74e260a4"), "numeric": (8, "4e59765c"),
    "entity": (2, "a7a17689"), "causal": (18, "4b1b7d93"), "thresholds": (27, "ef9bac20"), "narrative": (30, "81d53551"), "classes": (91, "50e1252a"), "containers": (10, "2719b2ae"), "concepts": (40, "f4203325"),
    "terms": (34, "0c0285fc"), "fragments": (8, "215c280b"), "garbage": (10, "785dd97e"), "providers": (4, "06a7c8f4"), "images": (9, "856de62d"),
}


def statuses(spark, texts, selection=False):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    judged = gate.judged(rows, "t", selection=selection).collect()
    return {r.id: ({x.rule: x.status for x in r.rules}, r.passed, r.summary) for r in judged}


def test_gate_rules(spark):
    prose = "这是一段内容充实的文字，讲述了许多不同的事情。" * 3 + "每个人都有自己的看法，山川河流与城市街道各有风景，读书写字之余也要出门走走，看看春天的花和秋天的月。" * 2
    texts = ["短", None, prose + "立即购买 限时优惠 抢购 赞助 推广", prose + "锟斤拷 锟斤拷 烫烫烫 屯屯屯 " * 2, prose + "<div a=1></div><p b=2></p><script x></script>" * 2, "x " * 200, "☃" * 80, prose]
    got = statuses(spark, texts)
    assert got[0][0]["length"] == got[1][0]["length"] == "block" and not got[1][1]
    assert got[2][0]["quality"] == "block" and got[3][0]["mojibake"] == "block" and got[4][0]["html"] == "block"
    assert set(got[0][0]) == set(gate.CHEAP)  # the dear group never ran
    assert got[6][0]["noise"] == "block"
    assert got[7][0]["noise"] == "ok"
    assert statuses(spark, ["选中的文本" * 7], selection=True)[0][0]["length"] == "warn"
    empty = spark.createDataFrame([], "id int, t string")
    assert gate.judged(empty, "t").count() == 0


def test_profiles(spark):
    rows = spark.createDataFrame([("```x```" + "字" * 120,), ("字" * 320 + "然而突然终于" * 2,), ("字" * 120,), ("short",), (None,)], "t string")
    assert [r.profile for r in profiles.classified(rows, "t").collect()] == ["dense", "sparse", "balanced", "balanced", "balanced"]
    table = profiles.threshold_table(spark, {"dense": {"min_length": 7}})
    assert {r.profile: r.min_length for r in table.collect()} == {"dense": 7.0, "balanced": 80.0, "sparse": 30.0}


def test_greedy_is_sequential(spark):
    rng = random.Random(5)
    for _ in range(4):
        n = 14
        edges = sorted({(max(a, b), min(a, b)) for a, b in (rng.sample(range(n), 2) for _ in range(20))})
        kept, expected = [], {}
        for i in range(n):
            match = next((j for j in kept if (i, j) in edges), None)
            if match is None:
                kept.append(i)
            else:
                expected[i] = match
        got = dedup.greedy_kept(spark.createDataFrame(edges, "later int, earlier int")).collect()
        assert {r.later: r.earlier for r in got} == expected


def test_fingerprint_bands_find_all(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(30)]
    prints = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]
    rows = spark.createDataFrame(list(enumerate(prints)), "key int, simhash long")
    got = {(r.a, r.b) for r in dedup.fingerprint_pairs(rows, rows).collect()}
    assert got == {(a, b) for a, b in itertools.product(range(len(prints)), repeat=2) if bin(prints[a] ^ prints[b]).count("1") < 3}
    assert rows.select(hamming(F.lit(5), F.lit(2))).first()[0] == 3


def test_batch_pairs(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma omega quality review summary window garden"
    rows = [(1, body), (2, body), (3, body + " extra"), (4, "totally different words about another matter " * 3), (5, "tiny text"), (6, "tiny texts"), (7, None), (8, "")]
    df = spark.createDataFrame([(0, *r) for r in rows], "g int, id int, t string")
    got = {(r.later, r.earlier): r.similarity for r in dedup.batch_pairs(df, "id", "t", "id", ("g",)).collect()}
    assert (2, 1) in got and (3, 1) in got and (6, 5) in got and got[2, 1] == pytest.approx(0.8)
    assert not any(4 in k or 7 in k or 8 in k for k in got)


def test_matches(spark):
    pairs = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "c", 0.9)], "id int, other string, score double")
    keys = spark.createDataFrame([(1, 50), (2, 500), (3, 10)], "id int, len int")
    got = {r.id: (r.other, r.score and round(r.score, 9)) for r in dedup.best_match(pairs, keys, "id", "other", "score", "len").collect()}
    assert got == {1: ("a", 0.575), 2: ("c", 0.9), 3: (None, None)}
    semantic = spark.createDataFrame([(1, "s", 0.575), (2, "t", 0.95)], "id int, other string, score double")
    lexical = spark.createDataFrame([(1, "a", 0.575), (2, "c", 0.9), (3, None, None)], "id int, other string, score double")
    merged = {r.id: (r.other, r.similarity) for r in dedup.merged_matches(lexical, semantic, "id").collect()}
    assert merged == {1: ("a", 0.575), 2: ("t", 0.95), 3: (None, 0.0)}
    bands = spark.createDataFrame([(0.9,), (0.6,), (0.1,)], "s double").select(dedup.band_of(F.col("s"), 0.8, 0.55)).collect()
    assert [r[0] for r in bands] == ["pending_high", "pending", "keep"]


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id int, v array<double>")
    got = {r.id: r.other for r in dense.nearest(rows, rows, "id", "v", 0.8, dimension=2).collect()}
    assert got == {1: 2, 2: 1, 3: None, 5: None}
    assert dense.nearest(rows.limit(0), rows, "id", "v", 0.8).count() == 0


def test_greedy_settles_long_chains(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(54)], "later int, earlier int").coalesce(1)
    assert {(r.later, r.earlier) for r in dedup.greedy_kept(edges).collect()} == {(k, k - 1) for k in range(1, 55, 2)}
    with pytest.raises(ValueError):
        dedup.greedy_kept(spark.createDataFrame([(1, 2), (2, 1)], "later int, earlier int"))


def test_related_and_diverse(spark):
    index = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "y", "w"]), ("c", ["q"]), ("d", [])], "k string, kw array<string>")
    got = {(r.query, r.other): r.similarity for r in related.keyword_jaccard(index, index, "k", "kw").collect()}
    assert got == {("a", "b"): 0.5, ("b", "a"): 0.5}
    candidates = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.8), ("q", "c", 0.1)], "query string, other string, similarity double")
    ranked = [(r.rank, r.other) for r in related.diverse(candidates, index.withColumnRenamed("kw", "keywords"), "k", top=3).orderBy("rank").collect()]
    assert ranked == [(1, "a"), (2, "b"), (3, "c")]


def test_claims(spark):
    rows = spark.createDataFrame([(1, "增长12.55%。因此市场导致变化很大！Acme Research Group said 2024年5月6日"), (2, None), (3, "")], "id int, t string")
    got = [(r.anchor, r.type) for r in claims.claims(rows, "id", "t").where("id = 1").orderBy("pos").collect()]
    assert ("55%", "numeric") in got and ("导致", "causal") in got and ("Acme Research Group", "entity") in got and ("12.55%", "numeric") not in got
    pairs = [("5%", "numeric", "it grew 5% last year. Next."), ("100", "numeric", "about 103 people"), ("100", "numeric", "about 200"), ("Acme Research Group", "entity", "Acme Research is big"), ("x", "numeric", None)]
    found = claims.located(spark.createDataFrame(pairs, "a string, k string, s string"), "a", "k", "s").collect()
    assert [r.status for r in found] == [claims.TRACED, claims.TRACED, None, claims.COMPARE, None]
    assert found[0].source_text == "it grew 5% last year."


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('{"notes": [{"title": "A title", "content": "Some content here", "tags": ["x"]}]}', [("A title", "Some content here")]),
        ('```json\n[{"title": "T one", "content": "c"}]\n```', [("T one", "c")]),
        ("---\ntitle: First\ntags: a, b\n---\nBody one\n---\ntitle: Second\n---\nBody two", [("First", "Body one"), ("Second", "Body two")]),
        ("1. **Alpha point**\ntext a\n2. **Beta point**\ntext b", [("Alpha point", "text a"), ("Beta point", "text b")]),
        ("## Heading here\ncontent", [("Heading here", "content")]),
        ("无符合标准的原子笔记", []),
        (None, []),
        ("   ", []),
        ("just a line of prose", [("just a line of prose", "just a line of prose")]),
    ],
)
def test_parse_output(spark, raw, expected):
    found = notes.notes_of(spark.createDataFrame([(1, raw)], "id int, raw string"), "id", "raw").orderBy("pos").collect()
    assert [(n.title, n.content) for n in found] == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("**标题**", "标题"),
        ("1. 标题", "标题"),
        ("1、标题", "标题"),
        ("① 标题", "标题"),
        ("### 标题", "标题"),
        ("标题：", "标题"),
        ("标题，", "标题"),
        ("，标题名称，", "标题名称，"),  # a separator at the front leaves the one at the end alone
        ("A", ""),
        ("", ""),
        (None, None),
        ("的如", "的如"),
        ("主题内容较长的标题用于测试：详细说明文字内容会被截断", "主题内容较长的标题用于测试"),
        ("第一部分较长的内容用于测试截断，第二部分内容会被忽略", "第一部分较长的内容用于测试截断"),
        ("Sound Check 技术的作用和原理详细说明超过二十个字符", "Sound Check"),
        ("这是一个比较长的中文标题用于测试安全截断功能确保长度足够", "这是一个比较长的中文标题用于测试安全截断功能"),
        ("关于城市公共交通系统中常见的资源分配问题", "关于城市公共交通系统中常见的资源分配问题"),
        ("他们在报告里认为这样的安排可能会带来不少新的麻烦和争论", ""),
    ],
)
def test_clean_title(spark, raw, expected):
    rows = spark.createDataFrame([(raw,)], "title string")
    assert titles.cleaned(rows, "title", "clean").first().clean == expected


def test_good_titles(spark):
    rows = spark.createDataFrame([("流媒体平台如Apple的So",), ("流媒体平台如iOS",), ("abc",), ("abcd",), ("x" * 26,), ("他们都认为这个办法其实还不错",)], "t string")
    assert [r[0] for r in rows.select(titles.is_good(F.col("t"))).collect()] == [False, True, False, True, False, False]
    texts = [("一二三四五六七八九十一二三四五六 Soundcheck", "一二三四五六七八九十一二三四五六"), ("short", "short"), ("一二三四五六七八九十一二三四五六七的多余", "一二三四五六七八九十一二三四五六七"), ("x" * 30, "x" * 12)]
    cut = spark.createDataFrame(texts, "t string, e string").select(titles.safe_cut(F.col("t")).alias("c"), "e").collect()
    assert [r.c for r in cut] == [r.e for r in cut]


@pytest.mark.parametrize(("content", "expected"), [(None, ""), ("", ""), ("第一行标题\n正文", "第一行标题"), ("a", ""), ("他们在报告里认为这样的安排可能会带来不少新的麻烦！后面还有", "他们在报告里认为这样的安排可能会带来")])
def test_drawn_titles(spark, content, expected):
    assert titles.drawn(spark.createDataFrame([(content,)], "c string"), "c", "t").first().t == expected


def test_tags_files(spark):
    rows = spark.createDataFrame([("t", "**缓存**是（Cache）的「要点」"), ("", "")], "title string, content string")
    assert rows.select(notes.tag_candidates(F.col("title"), F.col("content"))).first()[0][:3] == ["缓存", "Cache", "要点"]
    valid = rows.select(notes.is_valid(F.col("title"), F.col("content"))).collect()
    assert [r[0] for r in valid] == [True, False]
    names = spark.createDataFrame([(i, "same") for i in range(102)], "i int, stem string")
    got = {r.i: r.file for r in notes.numbered_names(names, "stem", "i").collect()}
    assert got[0] == "same" and got[1] == "same 1" and got[99] == "same 99" and got[100] is None
    body = spark.createDataFrame([("a: b", "text\n来源：x", "src", ["t1"])], "t string, c string, s string, g array<string>").select(notes.markdown(*map(F.col, "tcsg"))).first()[0]
    assert body == '---\ntitle: "a: b"\nsource: src\ntags: [t1]\n---\n\ntext\n'


def test_chunks():
    text = ("句子。" * 300 + "\n\n") * 4
    parts = notes.split_chunks(text, 1000, 100)
    assert all(len(p) <= 1001 for p in parts) and parts[0] == text[: len(parts[0])] and text.endswith(parts[-1])
    assert notes.split_chunks("short", 1000) == ["short"] and notes.split_chunks(None, 1000) == []
    # wide characters take two units; one that is cut belongs to the piece that holds its first
    wide = "a" * 999 + "😀" + "b" * 500
    assert notes.split_chunks(wide, 1000, 0) == ["a" * 999 + "😀", "b" * 500]
    assert notes.split_chunks("😀" * 400, 1000) == ["😀" * 400]
    # the last paragraph of the second half, a sentence, a hard cut
    assert notes.split_chunks("x" * 700 + "\n\n" + "y" * 700, 1000, 0)[0] == "x" * 700
    assert notes.split_chunks("x" * 700 + "。" + "y" * 700, 1000, 0)[0] == "x" * 700 + "。"
    assert notes.split_chunks("x" * 1500, 1000, 0) == ["x" * 1000, "x" * 500]


def test_fixed_lists():
    """The fixed values, pinned by their number and a hash of their text."""
    import hashlib

    from quillmill.functions import labels, text
    from quillmill.operators import claims, gate, profiles
    from quillmill.sources import html

    lists = {
        "stop": text.STOP_WORDS, "ads": gate.AD_PHRASES, "bait": gate.BAIT_PHRASES, "ad patterns": gate.AD_PATTERNS, "html": gate.HTML_PATTERNS, "mojibake": gate.MOJIBAKE_PATTERNS, "links": gate.LINK_PATTERNS, "numeric": claims.NUMERIC, "entity": claims.ENTITY, "causal": claims.CAUSAL,
        "thresholds": [f"{k} {v}" for k, v in profiles.THRESHOLDS.items()], "narrative": profiles.NARRATIVE, "classes": sorted(html.NOISE_CLASSES), "containers": html.CONTAINERS, "concepts": titles.CORE_CONCEPTS, "terms": titles.KNOWN_TERMS, "fragments": titles.FRAGMENTS, "garbage": notes.GARBAGE_TAGS, "providers": [a for a, _ in labels.PROVIDERS], "images": text.IMAGE_NOISE,
    }
    assert {k: (len(v), hashlib.sha256("\n".join(v).encode()).hexdigest()[:8]) for k, v in lists.items()} == FIXED


def test_calls(spark):

    asked: list = []

    def client(request):
        asked.append((request.max_tokens, request.json_mode))
        return services.Answer("", "length") if len(asked) == 1 else services.Answer('{"notes": []}')

    assert services.asked(client, "p", max_tokens=100) == '{"notes": []}' and asked == [(100, True), (200, True)]
    asked.clear()
    assert services.asked(lambda r: "" if r.json_mode else "plain", "p") == "plain"
    with pytest.raises(services.ServiceError):
        services.asked(lambda r: "", "p")
    clock = [0.0]
    calls: list = []

    def failing(x):
        calls.append(x)
        raise services.ServiceError("down")

    cool = services.CoolDown(failing, 300, lambda: clock[0])
    for at in (0, 10, 299, 301):
        clock[0] = at
        with pytest.raises(services.ServiceError):
            cool(at)
    assert calls == [0, 301]
    rows = spark.createDataFrame([(1, 0, "t", "c" * 20), (1, 1, None, "d" * 20)], "k int, p int, title string, content string")
    good = services.reviewed(rows, "k", "p", "title", "content", lambda p: '[{"index": 2, "insight_score": 5, "knowledge_score": 4}]').orderBy("idx").collect()
    assert [(r.idx, r.final, r.success) for r in good] == [(0, 6, True), (1, 9, True)]
    left = spark.createDataFrame([(1, "a claim", "The source says so."), (1, "b claim", "The source says so.")], "k int, claim string, source string")
    said = services.compared(left, "k", "claim", "source", lambda p: '[{"index": 0, "status": "需对比", "source_text": "source  says", "diff_note": "n"}]').orderBy("claim").collect()
    assert [(r.status, r.source_text, r.reason) for r in said] == [("需对比", "source  says", None), ("超源", None, "not answered")]
    assert "only x" in services.extraction_prompt("t", preferences=["x"], strict=True) and len(services.review_prompt([("t", "c" * 900)])) < 800 and "[1] b" in services.comparison_prompt("s", ["a", "b"])


def test_chain_of_repeats_is_settled(spark):
    """A chain longer than any fixed number of rounds: every other row is kept."""
    chain = spark.createDataFrame([(f"{i + 1:03d}", f"{i:03d}") for i in range(60)], "later string, earlier string")
    dropped = {r.later: r.earlier for r in dedup.greedy_kept(chain).collect()}
    assert dropped == {f"{i:03d}": f"{i - 1:03d}" for i in range(1, 61, 2)}


def test_title_matches(spark):
    body = "the old harbour keeps its quiet market near seven bright lanterns while merchants count copper"
    old = spark.createDataFrame([("a", body, "quiet harbour market stories"), ("b", body, "unrelated copper lantern notes")], "id string, c string, t string")
    new = spark.createDataFrame([("n", body, "quiet harbour market stories"), ("m", body, None)], "id string, c string, t string")
    plain = {r.id: (r.other, r.score) for r in dedup.corpus_matches(new, old, "id", "c").collect()}
    titled = {r.id: (r.other, r.score) for r in dedup.corpus_matches(new, old, "id", "c", "t").collect()}
    assert plain["n"][0] == titled["n"][0] == "a" and titled["n"][1] == pytest.approx(0.5 * (plain["n"][1] - 0.4) / 0.6 + 0.3 + 0.2) and titled["m"] == plain["m"]


def test_review(spark):
    raw = 'x [{"index":1,"insight_score":9,"knowledge_score":0},{"index":2,"insight_score":2,"knowledge_score":2,"final_score":7.5},{"index":9}] y'
    rows = spark.createDataFrame([(1, raw, 3), (2, "nonsense", 2), (3, None, 0)], "k int, raw string, n int")
    got = {(r.k, r.idx): (r.insight, r.knowledge, r.final, r.verdict) for r in review.parsed(rows, "k", "raw", "n").collect()}
    assert got == {(1, 0): (5, 1, 6, "保留"), (1, 1): (2, 2, 8, "保留"), (1, 2): (3, 3, 6, "保留"), (2, 0): (3, 3, 6, "保留"), (2, 1): (3, 3, 6, "保留")}


def test_html(spark):
    long = "Real content of the page. " * 10
    page = f'<html><head><title>T</title><meta name="date" content="2024-01-02"></head><body><nav>menu</nav><article><h1>Head</h1><p>{long}<p>two<div class="ad-x">buy</div><!-- c --><img alt="pic"></article></body></html>'
    got = html.extract(page)
    assert got["success"] and got["title"] == "Head" and got["publish_date"] == "2024-01-02" and "buy" not in got["content"] and got["content"].endswith("[图] pic")
    assert html.extract("")["error_code"] == html.extract(None)["error_code"] == "EMPTY_HTML"
    assert html.extract('<meta http-equiv="Refresh" content="0;url=http://x.example/">')["redirect_url"] == "http://x.example/"
    assert html.extract("<body><div></div></body>")["error_code"] == "REQUIRES_JS"
    assert html.extract("<body><p>" + "word " * 15 + "</p></body>")["error_code"] == "CONTENT_TOO_SHORT"
    rows = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert [r.read.success for r in html.extract_pages(rows, "html").orderBy("id").collect()] == [True, False]
    assert html.reader_text("# A\nbody") == ("A", "body") and html.reader_text("Title: B\n---\nbody") == ("B", "body")


def test_sources(spark, tmp_path):
    for name in ("a.md", "b.txt", "c.png"):
        (tmp_path / name).write_text("text")
    assert readers.notes_folder(spark, str(tmp_path)).count() == 2
    rows = spark.createDataFrame([("x/a",), ("x",), ("xy/a",)], "p string")
    assert [r[0] for r in rows.select(readers.in_folder(F.col("p"), "x")).collect()] == [True, True, False]
    urls = spark.createDataFrame([("http://a",), ("HTTPS://b/c",), ("ftp://c",), (None,)], "u string")
    assert [r[0] for r in urls.select(readers.is_web_address(F.col("u"))).collect()] == [True, True, False, False]
    readers.write_markdown(spark.createDataFrame([("n", "body"), (None, "x")], "file string, body string"), "file", "body", str(tmp_path / "out"))
    assert (tmp_path / "out" / "n.md").read_text() == "body"
    state.write_state(urls, str(tmp_path / "state"), 3)
    assert state.read_state(spark, str(tmp_path / "state"), 3).count() == 4 and state.read_state(spark, str(tmp_path / "state"), 2).count() == 0


def test_changes(spark, tmp_path):
    events = spark.createDataFrame([(1, "rename", "new", "old"), (2, "modify", "m", None)], "ts int, op string, path string, old_path string")
    assert {(r.path, r.op) for r in changes.split_renames(events).collect()} == {("old", "delete"), ("new", "modify"), ("m", "modify")}
    index = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    feed = spark.createDataFrame([("a", 2, "modify"), ("b", 2, "delete"), ("b", 1, "modify"), ("d", 5, "modify")], "k string, v int, op string")
    assert {tuple(r) for r in changes.upserted(index, feed, "k", "v").collect()} == {("a", 2), ("c", 1), ("d", 5)}
    folder = tmp_path / "in"
    feed.write.parquet(str(folder))
    stream = spark.readStream.schema(feed.schema).parquet(str(folder))
    running = changes.maintain(stream, str(tmp_path / "index"), "k", "v", str(tmp_path / "cp"))
    running.processAllAvailable()
    running.stop()
    assert {tuple(r) for r in changes.current_index(spark, str(tmp_path / "index")).collect()} == {("a", 2), ("d", 5)}


def test_services(spark):
    rows = spark.createDataFrame([(1, "first long sentence here\nsecond long sentence"), (2, None)], "id int, t string")
    got = services.extracted_notes(rows, "id", "t").collect()
    assert any(r.id == 1 and r.content for r in got)

    def broken(_):
        raise services.ServiceError("down", retry=False)

    assert {r.error for r in services.extracted_notes(rows, "id", "t", broken).collect()} == {"down"}
    assert all(len(r.vector) == 64 for r in services.embedded(rows, "id", "t").collect())
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise services.ServiceError("again")
        return "ok"

    assert services.with_retries(flaky, tries=3, sleep=lambda _: None) == "ok" and len(calls) == 3


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, "alpha")], "id int, t string")
    found = vectors.idf(vectors.counts(rows, "id", "t"), vectors.corpus_size(rows, "id", "t")).collect()
    import math

    assert {r.token: round(r.idf, 9) for r in found} == {t: round(math.log(4 / (df + 1)) + 1, 9) for t, df in (("alpha", 3), ("beta", 2), ("gamma", 1))}


def test_all_documents_compete_for_diversity(spark):
    from quillmill.functions import tokens
    from quillmill.plans import catalogue

    folder = "/root/testdata/sf0.001"
    docs = catalogue.table(spark, folder, "documents").select("doc_id", tokens.keyword_set(F.col("text")).alias("k"))
    sets = {r.doc_id: set(r.k or []) for r in docs.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    expected = []
    for q in (d for d in sets if d % 100 == 0):
        left, taken = sorted(set(sets) - {q}), []
        while left and len(taken) < 10:
            taken.append(max(left, key=lambda c: (0.6 * alike(q, c) - (1 - 0.6) * max((alike(c, t) for t in taken), default=0.0), -c)))
            left.remove(taken[-1])
            expected.append((q, len(taken), taken[-1], round(alike(q, taken[-1]), 9)))
    got = [(r.query, r["rank"], r.other, round(r.similarity, 9)) for r in catalogue.QUERIES["related_diverse"](spark, folder).collect()]
    assert expected and sorted(got) == sorted(expected)


def test_edit_pairs_against_brute_force(spark):
    rng = random.Random(3)
    texts = {"", "a", "b", "ab", "abc", "abd", "abcd", "abce"} | {"".join(rng.choices("abcd", k=rng.randrange(1, 14))) for _ in range(250)}
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    every = rows.select(F.col("t").alias("a")).crossJoin(rows.select(F.col("t").alias("b"))).where("a < b and a <> ''")
    true = {(r.a, r.b) for r in every.where("1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.7 - 1e-9").collect()}
    got = [(r.a, r.b) for r in dedup.edit_pairs(rows, "t", 0.7).collect()]
    assert len(true) > 50 and set(got) == true and len(got) == len(true)


def test_claims_come_from_the_content_and_are_traced_in_history(spark):
    from quillmill.plans import catalogue

    folder = "/root/testdata/sf0.001"
    rows = catalogue.distinct_notes(spark, folder).where("content is not null").select("id", "content").distinct()
    every = {(r.id, r.anchor) for r in claims.claims(rows, "id", "content").collect()}
    got = catalogue.QUERIES["claims_traced"](spark, folder).collect()
    entries = [r for r in spark.read.parquet(f"{folder}/dedup_features.parquet").collect() if r.path and r.content_preview]
    previews = {r.path: r.content_preview for r in sorted(entries, key=lambda r: (r.mtime or 0, r.content_preview))}
    assert {(r.id, r.anchor) for r in got} == every
    assert all(r.status is None for r in got if r.path is None) and any(r.status == claims.TRACED for r in got)
    assert all(r.source_text.removesuffix("...") in previews[r.path] for r in got if r.status)


def test_whole_tables_are_cut_and_indexed(spark):
    import hashlib

    from quillmill.plans import catalogue

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    head = lambda t: t.encode("utf-16-le")[:1000].decode("utf-16-le", "ignore")
    got = {r.doc_id: r.head for r in catalogue.QUERIES["truncated_texts"](spark, folder).collect()}
    assert got == {k: None if t is None else hashlib.md5(head(t).encode()).hexdigest() for k, t in texts.items()}
    last = {}
    for r in sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        last[r.user_id] = r
    users = {r.user_id: r.event_id for r in catalogue.QUERIES["index_after_changes"](spark, folder).collect()}
    assert all(users.get(u) == r.event_id for u, r in last.items() if r.event_type != "error") and set(users) <= set(last)
