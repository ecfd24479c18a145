"""Search in blocks, counts within the row, the dictionary, labels, pages and versions of an index, on small stated cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import dictionary, labels
from quillmill.functions.text import wide
from quillmill.functions.tokens import Segmenter
from quillmill.operators import related, vectors
from quillmill.sources import html, readers
from quillmill.streaming import changes


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(related, "BLOCK_WORDS", block)
    monkeypatch.setattr(related, "CELLS", 64)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, rng.sample(words, rng.randint(0, 9))) for k in range(60)] + [(60, None), (None, ["w1"]), (61, ["w1", "w1", "w2"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    sets = {k: set(w or []) for k, w in rows if k is not None}
    expected = set()
    for q in range(0, 60, 5):
        found = sorted(((-len(sets[q] & s) / len(sets[q] | s), k) for k, s in sets.items() if k != q and sets[q] & s), key=lambda x: x)
        expected |= {(q, k, round(-s, 9)) for s, k in found[:4] if -s >= 0.1}
    got = related.keyword_search(df.where("id % 5 = 0 and id < 60"), df.repartition(3), "id", "words", 0.1, 4).collect()
    assert {(r.query, r.other, round(r.similarity, 9)) for r in got} == expected
    assert related.keyword_search(df.limit(0), df, "id", "words", 0.1, 4).count() == 0
    assert related.keyword_search(df, df.limit(0), "id", "words", 0.1, 4).count() == 0


def test_counts_within_the_row(spark):
    df = spark.createDataFrame([("g", 1, "Cat dog cat 测试字 x"), ("g", 2, None), ("h", 3, "")], "grp string, id long, t string")
    got = {(r.grp, r.id, r.token): (r.cnt, r.pos, r.len) for r in vectors.counts(df, "id", "t", ("grp",)).collect()}
    assert got == {("g", 1, "cat"): (2, 0, 17), ("g", 1, "dog"): (1, 1, 17), ("g", 1, "测试字"): (1, 3, 17)}
    assert vectors.counts(df.limit(0), "id", "t").count() == 0


def test_segmentation():
    words = {"ab": 100, "abc": 1, "c": 50, "bc": 100, "a": 50}
    assert Segmenter(words, 1000).cut("abc") == ["a", "bc"] and Segmenter(words, 1000).cut("zz") == ["z", "z"]
    # where words begin but none of one character does, there is no way on by one character
    assert Segmenter({"xyz": 1}, 1000).cut("xyz") == ["xyz"] and Segmenter({}, 1).cut("") == []


def test_dictionary(spark):
    rng = random.Random(1)
    others = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都然没日于起还发成事只作当想看文无开手十用主行方又如前所本见经头面公同三已老从动两长知民样现分将外但身些与高意进把法此实回二理美点月明其种声全工己话儿者向情部正名定女问力机给等几很业最间新什打便位因重被走电四第门相次东政海口使教西再平真听世气信北少关并内加化由却代军产入先山五太水万市眼体别处总才场师书比住员九笑性通目华报立马命张活难神数件安表原车白应路期叫死常提感金何更反合放做系计或司利受光王果亲界及今京务制解各任至清物台象记边共风战干接它许八特觉望直服毛林题建南度统色字请交爱让认算论百吃义科怎元社术结六功指思非流每青管夫连远资队跟带花快条院变联"
    texts = [("".join(rng.sample(others, 12)) + "葡萄" + "".join(rng.sample(others, 12)),) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, (t,) in enumerate(texts)] + [(99, None)], "id long, t string")
    words = {r.word: r.n for r in dictionary.words(df, "t", least=20).collect()}
    assert words == {"葡萄": 60}
    counts = dictionary.word_counts(df, "id", "t", dictionary.words(df, "t", least=20)).collect()
    assert {r.id for r in counts} == set(range(60)) and {(r.token, r.cnt) for r in counts} == {("W:葡萄", 1)}


def test_labels(spark):
    rows = spark.createDataFrame([("https://API.OpenAI.com/v1", "HTTP 429"), ("https://user@Site.example:80/a?b", "no network"), ("plain words " * 9, "odd")], "u string, m string")
    got = rows.select(labels.provider(F.col("u")), labels.source_title(F.lit("url"), F.col("u")), labels.friendly_error(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("OpenAI", "api.openai.com", "请求过于频繁或额度不足，请稍后重试"), ("AI", "site.example", "网络连接失败，请检查网络或 API URL"), ("AI", ("plain words " * 9)[:50], "odd")]


def test_wide_patterns(spark):
    df = spark.createDataFrame([("a　b",), ("a﻿b",), ("a b",), ("ab",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(wide(r"a\sb"))).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(F.col("t").rlike(wide(r"a\Sb"))).collect()] == [False] * 4


def test_noise_is_told_by_exact_class():
    page = "<article><div class='Menu'>{0}</div><div class='AD-x'>kept</div><div class='ad-x'>gone</div><div class='menu'>gone</div></article>".format("Real text of the page. " * 8)
    got = html.extract(page)["content"]
    assert "Real text" in got and "kept" in got and "gone" not in got
    deep = "<article>" + "<div>" * 2000 + "word " * 60 + "</div>" * 2000 + "</article>"
    assert html.extract(deep)["content"] == ("word " * 60).strip()


def test_versions_of_an_index(spark, tmp_path):
    path = str(tmp_path / "index")
    assert changes.current_version(spark, path) is None and changes.current_index(spark, path) is None
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    rows.write.parquet(f"{path}/v=0")
    rows.withColumn("v", F.lit(2)).write.parquet(f"{path}/v=3")
    (tmp_path / "index" / "v=9").mkdir()  # a version that was never finished
    assert changes.current_version(spark, path) == 3 and changes.current_index(spark, path).first().v == 2


def test_markdown_files_may_be_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("one", "text"), (None, "left out")], "file string, body string")
    for _ in range(2):
        readers.write_markdown(rows, "file", "body", str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["one.md"] and (tmp_path / "out" / "one.md").read_text() == "text"


def test_group_edits_and_edit_pairs_of_large_groups(spark, monkeypatch):
    """Every pair of a group once, whatever the blocks; long texts, texts beyond the basic plane and lone groups too."""
    from pyspark.sql import functions as F

    from quillmill.operators import dedup

    monkeypatch.setattr(dedup, "CELL", 50)
    monkeypatch.setattr(dedup, "_FEW", 8)
    rng = random.Random(7)
    texts = {"".join(rng.choices("abcé𝄞", k=rng.randrange(1, 14))) for _ in range(180)} | {"ab" * n for n in (31, 32, 33, 40, 41, 600, 601)}
    rows = spark.createDataFrame([(f"{len(t) % 3}" if len(t) < 9 else t[:2], t) for t in texts] + [("x", None), (None, "x")], "g string, t string")
    both = rows.selectExpr("g", "t as a").join(rows.selectExpr("g as g2", "t as b"), F.expr("g = g2 and a < b"))
    want = sorted((r.a, r.b, r.s) for r in both.selectExpr("a", "b", "round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 9) as s").collect())
    parts = dedup.group_edits(rows, "g", "t")
    assert sorted(map(tuple, parts.collect())) == want and len(want) > 1000
    # a group above CELL was more than one task's work
    assert parts.groupBy(F.spark_partition_id()).count().count() > 2
    every = rows.selectExpr("t as a").crossJoin(rows.selectExpr("t as b")).where("a < b").distinct()
    close = {(r.a, r.b) for r in every.where("1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.7 - 1e-9").collect()}
    got = [(r.a, r.b) for r in dedup.edit_pairs(rows, "t", 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == close and ("ab" * 600, "ab" * 601) in close


def test_batch_candidates_are_judged_where_they_meet(spark):
    """Texts that share a rare word but can't reach the threshold don't move on, and only rows of a pair have their weights written."""
    from quillmill.operators import dedup

    filler = lambda k: " ".join(f"w{k}x{n}" for n in range(30))
    rows = [(k, 1, f"zebra zebra zebra {filler(k)}") for k in range(20)] + [(100, 1, filler("q") + " end"), (101, 1, filler("q") + " stop"), (102, 2, filler("q"))]
    df = spark.createDataFrame(rows, "id long, g int, t string")
    pairs, full, long = dedup.batch_candidates(df, "id", "t", "id", ("g",))
    assert [(r.g, r.later, r.earlier) for r in pairs.collect()] == [(1, 101, 100)]
    assert {r.id for r in long.select("id").collect()} == {100, 101} and full.count() == 23
    # without groups, and in parts of a few rows, the same
    assert [(r.later, r.earlier) for r in dedup.batch_pairs(df.where("id <> 102"), "id", "t", "id").collect()] == [(101, 100)]


def test_diverse_of_all_in_blocks_with_little_kept(spark, monkeypatch):
    """Blocks of queries and few kept similarities give the same choices as everything at once."""
    rng = random.Random(5)
    rows = [(k, [f"w{rng.randrange(25)}" for _ in range(rng.randrange(0, 9))]) for k in range(40)] + [(None, ["w1"]), (40, None)]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    asked = df.where("id % 5 = 0")
    whole = sorted(map(tuple, related.diverse_of_all(asked, df, "id", "words", top=4).collect()))
    monkeypatch.setattr(related, "DIVERSE_WORDS", 40)
    monkeypatch.setattr(related, "DIVERSE_KEPT", 2)
    assert sorted(map(tuple, related.diverse_of_all(asked, df, "id", "words", top=4).collect())) == whole and len(whole) == 9 * 4
