"""Scalar functions against independent models and known values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import hashing, similarity, text, tokens

ROWS = ["使用Python实现", "Über straße привет naïve", "hello the world 12 a", "中", "中文", "a🔥b　 x", "", "混合abc词语 再来"]


def model_tokens(t: str, n: int) -> list[str]:
    import re

    out = []
    for run in re.findall("[a-z0-9_一-鿿]+", t.lower()):
        if re.search("[一-鿿]", run):
            k = n if len(run) >= n else 2
            out += [run[i : i + k] for i in range(len(run) - k + 1)] if len(run) >= 2 else []
        elif len(run) >= 2:
            out.append(run)
    return [t for t in out if t not in text.STOP_WORDS]


@pytest.mark.parametrize("n", [2, 3])
def test_tokens(spark, n):
    df = spark.createDataFrame([(t,) for t in ROWS], "t string")
    got = {r.t: r.x for r in df.select("t", tokens.tokens(F.col("t"), n).alias("x")).collect()}
    assert got == {t: model_tokens(t, n) for t in ROWS}


def test_token_stats(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a"],), ([],)], "v array<string>")
    assert [tuple(r.s) for r in df.select(tokens.token_stats(F.col("v")).alias("s")).collect()] == [(5, 3, 3), (0, 0, 0)]


def test_lengths_and_white_space(spark):
    df = spark.createDataFrame([("a🔥b",), ("　 x﻿",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.utf16_length(F.col("t"))).collect()] == [4, 4, 0, None]
    assert [r[0] for r in df.select(text.trimmed(F.col("t"))).collect()] == ["a🔥b", "x", "", None]
    assert [r[0] for r in df.select(text.is_blank(F.col("t"))).collect()] == [False, False, True, True]
    assert [r[0] for r in df.select(text.truncated(F.col("t"), 2)).collect()] == ["a", "　 ", "", None]


def test_titles_and_front_matter(spark):
    rows = [("---\ntitle: \"A b\"\n---\nbody", "stem"), ("# Head\nx", "stem"), ("\n first line \n", "stem"), ("", "stem")]
    df = spark.createDataFrame(rows, "t string, s string")
    assert [r[0] for r in df.select(text.note_title(F.col("t"), F.col("s"))).collect()] == ["A b", "Head", "first line", "stem"]
    assert df.select(text.without_front_matter(F.col("t"))).first()[0] == "body"


def test_image_noise(spark):
    noisy = "a ![x](y.png) b\nhttps://h.example/p.jpg?x=1\nphoto.webp\n图片\n<figure>z</figure>\n\n\n\nend"
    assert spark.createDataFrame([(noisy,)], "t string").select(text.image_noise_removed(F.col("t"))).first()[0].split() == ["a", "b", "end"]


def test_hashes(spark):
    df = spark.createDataFrame([("a",), ("hello",), ("中文测试",), (None,)], "s string")
    assert [r[0] for r in df.select(hashing.fnv32_lossy("s")).collect()] == ["e40c292c", "a82fb4a1", "51d819e4", None]

    def model(s):
        h = 0xCBF29CE484222325
        for unit in np.frombuffer(s.encode("utf-16-le"), np.uint16):
            h = (h ^ int(unit)) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    assert [r[0] for r in df.select(hashing.fnv64("s")).collect()] == [model("a"), model("hello"), model("中文测试"), None]


def test_simhash(spark):
    df = spark.createDataFrame([([], []), (["x", "y"], [3.0, 0.4]), (["x"], [5.0]), (None, None)], "t array<string>, w array<double>")
    got = [r[0] for r in df.select(hashing.simhash("t", "w")).collect()]
    x = hashing.fnv64_array(__import__("pandas").Series(["x"])).view(np.int64)[0]
    assert got[0] == 0 and got[2] == x and got[3] is None
    assert hashing.simhash_of(np.array([1], np.uint64), np.array([0.4])) == 0  # a vote below one vanishes


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=4), st.lists(st.sampled_from("abcd"), max_size=4)), min_size=1, max_size=8))
def test_jaccard_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r, (a, b) in zip(df.select(similarity.jaccard(F.col("a"), F.col("b")).alias("x"), similarity.jaccard(F.col("b"), F.col("a")).alias("y")).collect(), pairs, strict=True):
        union = set(a) | set(b)
        assert r.x == r.y == (len(set(a) & set(b)) / len(union) if union else 0.0)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 9.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, None]
    assert df.select(similarity.fitted(F.col("a"), 3)).first()[0] == [1.0, 0.0, 0.0]
    edits = spark.createDataFrame([("kitten", "sitten"), ("", "a"), ("a", "abcdef")], "a string, b string")
    assert [round(r[0], 6) for r in edits.select(similarity.edit_similarity(F.col("a"), F.col("b"))).collect()] == [round(5 / 6, 6), 0.0, round(1 / 6, 6)]


def test_segmenter():
    cutter = tokens.Segmenter({"研究": 100, "研究生": 60, "生命": 80, "命": 5, "起源": 50}, 1000)
    assert cutter.cut("研究生命起源") == ["研究", "生命", "起源"]
    assert cutter.cut("xyz") == ["x", "y", "z"]
    assert math.isclose(cutter.unknown, math.log(1 / 1000))
