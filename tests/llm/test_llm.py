"""Operators for training text on small tables: brute force, round trips, and the awkward cases of each docstring."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bags, contamination, history, main_body, mixing, mojibake, near_dups, pii, prose, spam

WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def overlap(a: list[str], b: list[str]) -> float:
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


# ---- evaluation texts ---------------------------------------------------------------------------------------------------------
def test_contamination(spark, clash):
    rng = random.Random(3)
    item = " ".join(rng.choices(WORDS, k=40))
    units = item.split()
    docs = [(1, "Intro. " + ", ".join(units[5:18]).upper() + "! End"), (2, " ".join(units[5:17])), (3, "短句测试全部命中，再说"), (4, None), (5, ""), (1, "Intro. " + ", ".join(units[5:18]).upper() + "! End"), (None, item), (6, "x " * 50_000 + item)]
    items = [(10, item), (11, "短句测试"), (12, None), (13, "..."), (None, item), (10, item)]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    i = clash(spark.createDataFrame(items, "item_id long, text string"))
    for block in (contamination.BLOCK_CHARS, 100):
        got = {(r.doc_id, r.item_id): r for r in contamination.leaked_items(d, i, block_chars=block).collect()}
        assert set(got) == {(1, 10), (3, 11), (6, 10)}
    first = got[1, 10]
    assert docs[0][1][first.start_pos - 1 : first.end_pos].lower().startswith(units[5]) and first.windows == 1
    assert got[6, 10].windows == 28
    assert contamination.leaked_items(d.limit(0), i).count() == contamination.leaked_items(d, i.limit(0)).count() == 0


# ---- near-duplicates ----------------------------------------------------------------------------------------------------------
def corpus(n: int, seed: int) -> list[tuple[str, str, str]]:
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        if k % 3 and rows:
            words = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(0, 12)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                rng.shuffle(words)
        else:
            words = rng.choices(WORDS, k=rng.randrange(20, 70))
        rows.append((f"n{k:04d}", "", " ".join(words)))
    return rows


def test_near_duplicates_against_brute_force(spark, clash):
    rows = corpus(240, 1)
    rows += [("same1", "T", rows[0][2]), ("same2", "T", rows[0][2]), ("null", None, None), ("blank", "x", " 　"), rows[5], ("empty", "", "!!")]
    df = clash(spark.createDataFrame(rows, "id string, title string, content string"))
    got = {(r.id_a, r.id_b) for r in near_dups.near_duplicate_pairs(df).collect()}
    texts = {i: bags.word_tokens(((t or "") + " " + c).lower()) for i, t, c in rows if c and c.strip()}
    keys = sorted(texts)
    exact = {(a, b): overlap(texts[a], texts[b]) for x, a in enumerate(keys) for b in keys[x + 1 :] if texts[a]}
    true = {p for p, s in exact.items() if s >= 0.6}
    assert got <= true
    assert ("same1", "same2") in got and len(got) >= 0.97 * len(true)
    groups = near_dups.near_duplicate_groups(df).collect()
    by_id = {r.id: r.group_key for r in groups}
    assert all(by_id[a] == by_id[b] for a, b in got) and "null" not in by_id
    assert near_dups.near_duplicate_pairs(df.limit(0)).count() == 0


def test_no_pair_is_lost(spark):
    rng = random.Random(5)
    rows = []
    for k in range(150):  # pairs with 46 to 48 of 61 to 62 words in common: overlaps just above 0.6
        words = rng.sample(WORDS, 80)
        n = 46 + k % 3
        rows += [(f"x{k:03d}", "", " ".join(words[:61])), (f"y{k:03d}", "", " ".join(words[:n] + words[61 : 61 + 61 - n]))]
    texts = {i: set(c.split()) for i, _, c in rows}
    keys = sorted(texts)
    true = {(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if len(texts[a] & texts[b]) / len(texts[a] | texts[b]) >= 0.6}
    got = [(r.id_a, r.id_b) for r in near_dups.near_duplicate_pairs(spark.createDataFrame(rows, "id string, title string, content string")).collect()]
    assert len(true) >= 150 and set(got) == true and len(got) == len(true)


def test_bound_is_exact_in_large_groups():
    rng = np.random.default_rng(0)
    n = 300
    sets = [np.unique(rng.choice(400, 60)) for _ in range(n)]
    for k in range(0, n, 3):
        sets[k] = np.unique(np.concatenate([sets[0][: rng.integers(30, 55)], rng.choice(400, 8)]))
    flat = np.concatenate([bags.mix(s.astype(np.uint64)) >> np.uint64(32) for s in sets]).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = bags.bitmaps(flat, starts)
    size = np.diff(starts)
    place = (np.uint64(7) << np.uint64(near_dups._SIZE_BITS)) | size.astype(np.uint64)
    found = np.concatenate(list(near_dups.qualifying(place.view(np.int64), np.arange(n), bits, 0.6, False)))
    got = {tuple(sorted(p)) for p in found.tolist()}
    true = {(i, j) for i in range(n) for j in range(i + 1, n) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.6}
    assert true <= got and len(true) > 100


@pytest.mark.parametrize(("least", "two_sided"), [(0.6, False), (0.5, True)])
def test_large_groups_meet_few_pairs_and_lose_none(monkeypatch, least, two_sided):
    rng = np.random.default_rng(1)
    n = 3000
    size = rng.integers(40, 160, n)
    sets = [rng.choice(600, k, replace=False) for k in size]
    for k in range(0, n, 3):  # near copies of another set, up to a few elements at its end
        like = sets[rng.integers(n)]
        sets[k] = np.unique(np.concatenate([like[: len(like) - rng.integers(0, 20)], rng.choice(600, 5)]))
    size = np.array([len(x) for x in sets])
    flat = (bags.mix(np.concatenate(sets).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    bits = bags.bitmaps(flat, np.concatenate([[0], np.cumsum(size)]))
    skipped = (rng.random(n) * (size - np.ceil(least * size - 1e-9) + 1)).astype(int)
    side = rng.integers(0, 2, n) if two_sided else np.zeros(n, int)
    i, j = np.nonzero(side[:, None] < side) if two_sided else np.triu_indices(n, 1)
    part = least / (1 + least) * (size[i] + size[j]) - 0.01
    fits = (size[i] - skipped[i] >= part) & (size[j] - skipped[j] >= part)
    i, j, part = i[fits], j[fits], part[fits]
    ones = np.bitwise_count(bits).sum(axis=1).astype(int)
    common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1)
    good = (common + (size - ones)[i] >= part) & (common + (size - ones)[j] >= part)
    pairs = {tuple(sorted(p)) for p in zip(i[good].tolist(), j[good].tolist(), strict=True)}

    place = (skipped.astype(np.uint64) << np.uint64(48)) | np.uint64(7 << near_dups._SIZE_BITS) | (side.astype(np.uint64) << np.uint64(near_dups._SIZE_BITS - 1)) | size.astype(np.uint64)
    words, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: words.append(x.size) or count(x))
    found = np.concatenate(list(near_dups.qualifying(place.view(np.int64), np.arange(n), bits, least, two_sided)))
    assert {tuple(sorted(p)) for p in found.tolist()} == pairs and len(pairs) > 100
    # bitmaps meet for the pairs that sizes and places allow, and few others; most pairs are settled by their first words
    assert sum(words) < 9 * fits.sum()


@pytest.mark.parametrize("others", [20, 500])
def test_sets_of_unknown_size_are_kept(others):
    size = np.array([near_dups._BIG, near_dups._BIG, 30_000] + [50] * others)
    bits = np.full((len(size), bags.BITMAP_WORDS), ~np.uint64(0))
    bits[3:] = np.random.default_rng(2).integers(0, 2**62, (others, bags.BITMAP_WORDS), np.uint64)
    place = (np.uint64(7) << np.uint64(near_dups._SIZE_BITS)) | size.astype(np.uint64)
    found = np.concatenate(list(near_dups.qualifying(place.view(np.int64), np.arange(len(size)), bits, 0.6, False)))
    assert {(0, 1), (0, 2), (1, 2)} <= {tuple(sorted(p)) for p in found.tolist()}


def test_history(spark, tmp_path):
    rows = corpus(150, 2)
    old, new = rows[:90], rows[60:]
    features = [(f"f/{i}", k, [(t, c) for t, c in Counter(history.content_tokens(t.lower())).items()]) for k, (i, _, t) in enumerate(old)]
    features += [("f/n0000", 9999, [("otherword", 3)]), ("f/n0000", 0, None), (None, 1, [("abcd", 1)]), ("f/none", 1, None)]
    f = spark.createDataFrame(features, "path string, mtime long, tokens array<struct<token:string,cnt:int>>")
    n = spark.createDataFrame([*new, ("null", None, None)], "id string, title string, content string")
    force = {p: t for p, m, t in sorted((x for x in features if x[0]), key=lambda x: x[1])}
    texts = {i: history.content_tokens(c.lower()) for i, _, c in new}
    exact = {(i, p): overlap(t, [x for w, c in (ts or []) if history._counted(w) for x in [w] * c]) for i, t in texts.items() for p, ts in force.items()}
    got = {(r.id, r.path) for r in history.known_already(n, f).collect()}
    true = {k for k, s in exact.items() if s >= 0.5}
    assert got <= true and len(got) >= 0.97 * len(true) > 20
    folder = str(tmp_path / "index")
    sets = history.entry_sets(f)
    history.Shards.build(sets.where("path < 'f/n0045'"), 0).write(folder)
    history.Shards.build(sets.where("path >= 'f/n0045'"), 1).write(folder)
    shards = history.Shards.read(spark, folder)
    batch = history.batch_sets(n)
    again = {(r.id, r.path) for r in history.probe(batch, shards).collect()}
    packed = {(r.id, r.path) for r in history.probe(batch, shards.compacted(2)).collect()}
    assert again == packed == got


def test_no_entry_of_the_history_is_lost(spark):
    rng = random.Random(6)
    notes, features, true = [], [], set()
    for k in range(300):  # 34 or 35 of 50 words in common: overlaps of 0.515 and 0.538
        words = rng.sample(WORDS, 80)
        n = 34 + k % 2
        notes.append((f"n{k}", " ".join(words[:50])))
        features.append((f"f{k}", k, [(w, 1) for w in words[:n] + words[50 : 100 - n]]))
    for i, c in notes:
        for p, _, t in features:
            both = len(set(c.split()) & {w for w, _ in t})
            if both >= 0.5 * (100 - both):
                true.add((i, p))
    n = spark.createDataFrame(notes, "id string, content string")
    f = spark.createDataFrame(features, "path string, mtime long, tokens array<struct<token:string,cnt:int>>")
    assert len(true) >= 300 and {(r.id, r.path) for r in history.known_already(n, f).collect()} == true


def test_content_tokens():
    assert history.content_tokens("abc abcd 中文字符 ab中 a中b_cd") == ["abcd", "中文字", "文字符", "ab中", "a中b", "中b_"]


# ---- wrong encodings ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("chain", ["utf8>cp1252", "utf8>cp1252>utf8>cp1252", "utf8>mac_roman", "utf8>cp437", "gbk>cp1252", "gbk>cp1251", "utf8>cp1251"])
def test_garble_round_trip(chain):
    word = "练习" if chain.startswith("gbk") else "façade"
    assert mojibake.ungarble(mojibake.garble(word, chain), chain) == word


def test_garbled_pages(spark, clash):
    clean = ["The façade of the café isn’t old.", "Le garçon a mangé une crêpe au café.", "练习和反馈改善课程，记忆需要时间。"]
    rows = [(k, t) for k, t in enumerate(clean * 3)]
    rows += [(100, mojibake.garble(clean[0], "utf8>cp1252")), (101, mojibake.garble(clean[2], "gbk>cp1252")), (102, "The word “cafÃ©” is a slip."), (103, "lost � here"), (104, "文中以“锟斤拷”三个字为例。"), (105, None), (106, ""), (None, "cafÃ©"), (100, mojibake.garble(clean[0], "utf8>cp1252"))]
    df = clash(spark.createDataFrame(rows, "page_id long, content string"))
    got = {r.page_id for r in mojibake.find_garbled(df).collect()}
    assert got == {100, 101, 103}
    assert mojibake.find_garbled(df.limit(0)).count() == 0
    put_right = {r.page_id: r.content for r in mojibake.restored(df).where("changed").collect()}
    assert put_right == {100: clean[0], 101: clean[2]}
    assert mojibake.repaired(mojibake.garble(clean[0], "utf8>cp1252")) == clean[0] and mojibake.repaired(clean[1]) == clean[1]


# ---- spam and bodies ----------------------------------------------------------------------------------------------------------
PROSE = [
    "The old library reported that every garden changed the town before the winter, because people kept their notes and shared them with others.",
    "When the river rose in the spring, nobody could say whether the bridge would hold, but the keeper of the mill stayed with his daughter.",
    "It is rarely simple to explain how a market works, although most of us have seen one and many have bought something there.",
]


TEMPLATES = [
    "The {} library reported that every {} changed the {} before the {}, because people kept their {} and shared them with others.",
    "When the {} rose in the {}, nobody could say whether the {} would hold, but the keeper of the {} stayed with his {}.",
    "It is rarely simple to explain how a {} works, although most of us have seen one {} and many have bought a {} there.",
    "After the {} had closed, she walked along the {} and thought about what her {} had once told her of the {}.",
    "Some {} never found their way back to the {}, while others were happy to wait for a {} under the old {}.",
    "He could not have known that this {} was only the first of several {}, each more {} than the one it followed.",
    "Between the {} and the {} there was a small {}, where we used to sit with a {} until it got dark.",
    "If you ask for a {}, they will bring you two {} instead, and no {} has yet told them why that is wrong.",
]


def sentence(rng: random.Random) -> str:
    template = rng.choice(TEMPLATES)
    return template.format(*rng.choices(WORDS, k=template.count("{}")))


def pages(n: int) -> list[tuple]:
    rng = random.Random(9)
    out = []
    for k in range(n):
        paragraphs = [f"{sentence(rng)} {sentence(rng)}" for _ in range(4)]
        menu = "Home / About / Contact / Search / Archive"
        out.append((k, f"host{k % 2}", f"A headline about {WORDS[k]}", "\n".join([menu, f"A headline about {WORDS[k]}", f"By Some One staff · 2020-01-{k % 28 + 1:02d}", paragraphs[0], "", *paragraphs[1:], "Read next", "Why the other page matters — It was a cold…", "© 2020 Some House. All rights reserved."])))
    return out


def test_spam(spark, clash):
    rows = [(k, t) for k, _, _, t in pages(60)]
    keywords = "\n".join("cheap shoes buy shoes online best shoes discount shoes near me " * 4 for _ in range(6))
    recycled = "\n".join("Looking for shoes in Rome? Our shoes in Rome is the cheap shoes. We sell shoes to all of Paris, cheap shoes every day. " * 4 for _ in range(6))
    rows += [(900, keywords), (901, recycled), (902, None), (903, ""), (None, keywords), (900, keywords)]
    df = clash(spark.createDataFrame(rows, "page_id long, content string"))
    assert {r.page_id for r in spam.spam_pages(df).collect()} == {900, 901}
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_main_body(spark, clash):
    rows = pages(60) + [(900, "host0", None, "cheap buy best " * 60), (901, "host0", "t", None), (902, None, None, " "), (3, *pages(4)[3][1:])]
    df = clash(spark.createDataFrame([(p, h, t, c) for p, h, t, c in rows], "page_id long, host string, title string, content string"))
    got: dict[int, set] = {}
    for r in main_body.find_body(df).collect():
        got.setdefault(r.page_id, set()).add(r.line_no)
    assert set(got) == set(range(60))
    assert all(lines == {2, 4, 6, 7, 8} for lines in got.values())
    assert main_body.find_body(df.limit(0)).count() == 0


def test_prose_model_prefers_prose():
    text = "\n".join(PROSE * 40)
    lines = prose.read_lines(text)
    cells, counts = np.unique(prose.trigrams(lines), return_counts=True)
    model = prose.fit(cells, counts)
    scores = model.scores(prose.read_lines(PROSE[0] + "\nbuy cheap best online shoes market river garden free discount"))
    assert scores[0] < 4 < scores[1]


# ---- mixing -------------------------------------------------------------------------------------------------------------------
def test_mixing(spark, clash):
    rng = random.Random(4)
    docs = [(k, "word " * rng.randrange(1, 60), ["big", " Big ", "small", None][min(3, rng.randrange(9) // 3)]) for k in range(900)] + [(5000, None, "big"), (5001, "", "big"), (0, None, "big")]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    plans = spark.createDataFrame([(1, 1.0), (2, 0.2), (3, None)], "mix_id int, budget_ratio double")
    targets = spark.createDataFrame([(1, "BIG", 0.3, 5), (1, "small", 0.6, 2), (1, "gone", 0.1, None), (2, "small", 1.0, None), (2, "big", None, 3), (3, "big", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    chosen, wanted = mixing.selection(df, plans, targets)
    sizes = {r.doc_id: r for r in mixing.sized(df).collect()}
    total = sum(r.n_tokens for r in sizes.values())
    rows = chosen.collect()
    got = Counter()
    for r in rows:
        assert sizes[r.doc_id].source == r.source
        got[r.mix_id, r.source] += r.n_tokens * r.copies
    held = sum(r.n_tokens for r in sizes.values() if r.source == "small")
    assert got[1, "big"] == pytest.approx(0.3 * total, abs=130) and got[2, "small"] == pytest.approx(0.2 * total, abs=130)
    assert got[1, "small"] == pytest.approx(min(0.6 * total, 2 * held), abs=130) and max(r.copies for r in rows if (r.mix_id, r.source) == (1, "small")) <= 2
    ranks = [r["rank"] for r in mixing.ranked(mixing.sized(df)).where("source = 'big'").collect()]
    assert sorted(ranks) == list(range(len(ranks)))
    report = {(r.mix_id, r.source): r for r in mixing.shares(df, plans, targets).collect()}
    assert report[1, "gone"].reached_tokens == 0 and sum(r.reached_share for k, r in report.items() if k[0] == 1) == pytest.approx(1.0)
    assert mixing.shares(df.limit(0), plans, targets).where("reached_tokens > 0").count() == 0


# ---- personal information -----------------------------------------------------------------------------------------------------
def test_structural_forms():
    find = lambda t: [(t[a:b], k) for a, b, k, _ in pii.Finder().structural(t)]
    assert find("mail a.b+c@d-e.example or x (at) y DOT org now") == [("a.b+c@d-e.example", "email"), ("x (at) y DOT org", "email")]
    assert find("Call +44 1632 960 319 or (021)55500123.") == [("+44 1632 960 319", "phone"), ("(021)55500123", "phone")]
    assert find("SSN 919-54-5499, QQ 15 32 86 D") == [("919-54-5499", "id_number"), ("QQ 15 32 86 D", "id_number")]
    assert find("at 17 Marlow Street, Luton today") == [("17 Marlow Street, Luton", "address")]
    assert find("in der Haferstraße 106a, 00579 Harmühl.") == [("Haferstraße 106a, 00579 Harmühl", "address")]
    for text in ("ISBN 978-0-905-24787-1", "192.0.2.224:8048", "pkg-it@4.7.7", "v5.0.39 (2024-01-08 23:44:14)", "#9541971/42-928", "6 @ 40.50", "doi:10.5550/garth.2023.64197", "@handle", "订单号998786198509255783已发货"):
        assert find(text) == [], text


def test_names_are_learned(spark, clash):
    given, family = ["Ada", "Bruno", "Clara", "Dario", "Elena", "Fabio"], ["Harlow", "Ibsen", "Jarvis", "Keller", "Lowell", "Marsh"]
    rng = random.Random(2)
    docs = [(k, f"Thanks to {rng.choice(given)} {rng.choice(family)} for the proofreading. The Kellund College reported it. My number is +44 1632 960 {rng.randrange(100, 999)} today.") for k in range(80)]
    docs += [(200, "Thanks to Zelda Quigley for the proofreading."), (201, None), (202, ""), (203, "The Kellund College reported it."), (None, "x"), docs[0]]
    parts = spark.createDataFrame([(g, "given", "en") for g in given[:4]] + [(f.upper(), "family", "en") for f in family[:4]] + [(None, "given", "en"), ("x", None, "en")], "name_part string, name_kind string, lang string")
    df = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r.doc_id, r.kind, r.start_pos) for r in pii.find_personal(df, parts).collect()}
    assert all((k, "person", 11) in got for k in range(80)) and (200, "person", 11) in got
    assert not any(d == 203 for d, *_ in got) and sum(k == "phone" for _, k, _ in got) == 80
    masked = {r.doc_id: r.text for r in pii.mask_personal(df, parts).collect()}
    assert masked[200] == "Thanks to [PERSON] for the proofreading." and masked[201] is None and masked[202] == ""
    assert pii.find_personal(df.limit(0), parts).count() == 0 and pii.find_personal(df, parts.limit(0)).where("kind = 'phone'").count() == 80


def test_names_stay_known_in_a_larger_corpus(spark):
    given, family = ["Ada", "Bruno", "Clara", "Dario"], ["Harlow", "Ibsen", "Jarvis", "Keller"]
    parts = spark.createDataFrame([(g, "given", "en") for g in given] + [(f, "family", "en") for f in family], "name_part string, name_kind string, lang string")
    few = [(k, f"Thanks to {given[k % 4]} {family[k // 2 % 4]} for the proofreading.") for k in range(6)] + [(9, "Thanks to Zelda Quigley for the proofreading.")]
    more = [(100 + k, " ".join(f"Yesterday {given[n % 4]} {family[n // 4 % 4]} arrived." for n in range(1000))) for k in range(40)]
    find = lambda docs: {(r.doc_id, r.kind, r.start_pos) for r in pii.find_personal(spark.createDataFrame(docs, "doc_id long, text string"), parts).collect() if r.doc_id < 100}
    small = find(few)
    assert (9, "person", 11) in small and find(few + more) == small


def test_extra_columns(spark, clash):
    df = clash(spark.createDataFrame([(1, "t")], "doc_id long, text string"))
    assert df.select(F.count("*")).first()[0] == 1
