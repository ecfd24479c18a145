"""The layout tree, rendering, the shared reading of pages, and the graphs of a history."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import bags, contamination, graph, layout, main_body, mojibake, pages, pii
from quillmill.llm.layout import ASIDE, BLANK, CAPTION, COMMENTS, FURNITURE, HEADING, HEADLINE, ITEM, PARAGRAPH, QUOTE, TEASER


@pytest.mark.parametrize(
    ("kinds", "shown"),
    [
        ([FURNITURE, HEADLINE, PARAGRAPH, BLANK, HEADING, PARAGRAPH, ASIDE, TEASER, FURNITURE], [1, 2, 4, 5]),
        ([HEADING, HEADING, PARAGRAPH], [1, 2]),  # the last heading above the text is the headline
        ([HEADLINE, PARAGRAPH, ASIDE, HEADING, HEADING, PARAGRAPH, COMMENTS, PARAGRAPH, PARAGRAPH], [0, 1, 5]),  # text ends an aside, nothing ends comments
        ([ASIDE, HEADLINE, PARAGRAPH, ITEM, ITEM, CAPTION], [1, 2, 3, 4, 5]),  # a menu above the text opens nothing
        ([HEADLINE, PARAGRAPH, HEADING, HEADING, HEADING], [0, 1]),  # headlines in a row are links
        ([HEADLINE, PARAGRAPH, ASIDE, QUOTE, PARAGRAPH], [0, 1, 4]),  # a short quotation stays in its aside
        ([HEADING, HEADING], []),
        ([], []),
    ],
)
def test_tree(kinds, shown):
    tokens = [30 if k == PARAGRAPH else 5 for k in kinds]
    page = layout.built(kinds, tokens)
    assert [p.tag for p in page.parts] == ["masthead", "article", "footer"]
    assert sorted(page.lines()) == list(range(len(kinds)))  # no line is lost
    assert layout.visible(page, kinds) == shown


def test_rendering():
    lines = ["menu", "Head", "", "Text.", "- one", "- two", "ad", "a\tbb", "ccc\td", "End."]
    assert layout.rendered(lines, [2, 4, 5, 6, 8, 9, 10]) == "Head\n\nText.\n- one\n- two\n\na    bb\nccc  d\nEnd."
    assert layout.rendered(lines, []) == ""


def test_page_text():
    page = """<!doctype html><html><head><title>T</title><style>x</style></head><body><nav>Menu</nav><h1>Head</h1><p>One <b>two</b>
three<p>Four<br>five<div style="display: none">gone</div><ul><li>a<li>b</ul><ol><li>x<li>y</ol>
<table><tr><th>Name<th>No<tr><td>Long name<td>1</table><pre>  kept
   so</pre><span hidden>no</span><script>var p = "</p>"</script></body></html>"""
    assert layout.page_text(page) == "Menu\n\nHead\n\nOne two three\n\nFour\nfive\n\n- a\n- b\n\n1. x\n2. y\n\nName       No\nLong name  1\n\n  kept\n   so"
    assert layout.page_text(None) == layout.page_text("  ") == ""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert layout.page_text(deep) == "deep"


def test_rendered_pages(spark):
    df = spark.createDataFrame([(1, "<p>a<p>b"), (2, None)], "page_id int, content string")
    assert {r.page_id: r.content for r in main_body.rendered_pages(df, "content").collect()} == {1: "a\n\nb", 2: None}


def test_body_text(spark):
    from test_llm import pages as articles

    df = spark.createDataFrame(articles(40), "page_id long, host string, title string, content string")
    out = {r.page_id: r.content for r in main_body.body_text(df, host_share=0.08).withColumnRenamed("body", "content").collect()}
    assert set(out) == set(range(40)) and all(t.startswith("A headline about") and "Home / About" not in t and "©" not in t for t in out.values())


def test_hosts_lines_by_shuffle(spark, monkeypatch):
    """Many hosts' lines are joined, not sent; the result is the same."""
    from test_llm import pages as articles

    df = spark.createDataFrame(articles(40), "page_id long, host string, title string, content string")
    few = {tuple(r) for r in main_body.find_body(df).collect()}
    monkeypatch.setattr(main_body, "BROADCAST_KEYS", -1)
    assert {tuple(r) for r in main_body.find_body(df).collect()} == few


def test_own_losses():
    again = "The blue shoes of the town are cheap shoes for all. " * 8
    new = "Nobody knows which bridges the river spared when winter storms broke over our quiet valley last year."
    lines, found, _ = pages.read_page(again + "\n" + new, None)
    assert found["own"][0] < 3 < 5 < found["own"][1]
    han, found, _ = pages.read_page("排行补贴就来墨晴湾补贴。" * 12 + "\n时间久了，树冠和记忆标出彼此，嘈杂的树冠因此经常整理。", None)
    assert found["own"][0] < 3 < found["own"][1]


def test_long_lines_can_be_furniture(spark):
    """A line of any length that many articles share is furniture."""
    from test_llm import pages as articles

    notice = "We keep what readers tell us for as long as the law of the land asks us to, and no longer than that. " * 8
    rows = [(k, h, t, c + "\n" + notice.strip()) for k, h, t, c in articles(40)]
    df = spark.createDataFrame(rows, "page_id long, host string, title string, content string")
    last = {k: c.count("\n") + 1 for k, _, _, c in rows}
    assert not [r for r in main_body.find_body(df).collect() if r.line_no == last[r.page_id]]


# ---- graphs -------------------------------------------------------------------------------------------------------------------
def test_graph_finds_near_neighbours():
    rng = np.random.default_rng(5)
    topics = [rng.choice(5000, 400, False) for _ in range(10)]
    sets = [np.sort(rng.choice(topics[k % 10], 60, False)).astype(np.uint32) for k in range(1500)]
    near = [np.sort(np.concatenate([rng.choice(s, 50, False), rng.integers(6000, 9000, 10)])).astype(np.uint32) for s in sets[:200]]

    def bitmaps(of):
        starts = np.concatenate([[0], np.cumsum([len(s) for s in of])])
        return bags.bitmaps(np.concatenate(of), starts, 8)

    made = graph.Graph.build(bitmaps(sets), np.arange(1500))
    assert sorted(made.keys) == list(range(1500)) and (made.links < 1500).all()
    queries = bitmaps(near)
    beam, share = graph.tuned(made, queries, 0.5)
    assert beam in graph.BEAMS and share >= 0.98
    ids, close = made.search(queries, np.bitwise_count(queries).sum(axis=1), beam)
    assert np.mean([k in made.keys[i[c > 0.5]] for k, (i, c) in enumerate(zip(ids, close, strict=True))]) >= 0.95


# ---- others -------------------------------------------------------------------------------------------------------------------
def test_leaks_with_text_ids_and_blocks(spark):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([("d1", "x " + " ".join(words[:20]) + " y"), ("d2", " ".join(words[40:60])), (None, "w1"), ("d3", None)], "doc string, text string")
    items = spark.createDataFrame([("i1", " ".join(words[5:18])), ("i2", " ".join(words[45:58])), ("i3", "w41 w42"), ("i4", None)], "item string, text string")
    one = {(r.doc_id, r.item_id) for r in contamination.leaked_items(docs, items, "doc", "text", "item").collect()}
    many = {(r.doc_id, r.item_id) for r in contamination.leaked_items(docs, items, "doc", "text", "item", block_chars=20).collect()}
    assert one == many == {("d1", "i1"), ("d2", "i2"), ("d2", "i3")}


def test_restored_by_originals(spark):
    """Words of other pages put a damaged page right, whole lines by their chain and single words by the table."""
    clean = ["Die Brücke über den Fluss hält.", "Größe zählt für Käufer nicht.", "Öl fließt in die schöne Stadt."]
    rows = [(k, "\n".join(clean)) for k in range(4)]
    hurt = clean[0].encode().decode("cp1252")
    mixed = "Wir sehen die " + "Brücke".encode().decode("cp1252") + " und die schöne Stadt."
    rows += [(10, hurt + "\n" + clean[1]), (11, mixed)]
    out = {r.page_id: r.content for r in mojibake.restored(spark.createDataFrame(rows, "page_id long, content string")).collect()}
    assert out == {10: clean[0] + "\n" + clean[1], 11: "Wir sehen die Brücke und die schöne Stadt."}


def test_long_words_are_known(spark):
    """No length keeps a word out of the table."""
    word = "Überraschungs" * 5 + "größe"
    rows = [(k, f"Hier steht {word} heute.") for k in range(3)] + [(9, f"Hier steht {word.encode().decode('cp1252')} heute.")]
    assert [r.page_id for r in mojibake.find_garbled(spark.createDataFrame(rows, "page_id long, content string")).select("page_id").distinct().collect()] == [9]


def test_words_of_one_page_are_in_the_table(spark):
    """A word that a single page holds proves its longer garbled forms; clean pages stay clean."""
    rows = [(1, "Ein Käsefrühstück am Morgen."), (2, "Ein " + "Käsefrühstück".encode().decode("cp1252") + " am Abend."), (3, "Die Öfen stehen still.")]
    found = mojibake.find_garbled(spark.createDataFrame(rows, "page_id long, content string"))
    assert [r.page_id for r in found.select("page_id").distinct().collect()] == [2]


def test_readers_follow_what_was_learned(spark):
    """Workers that live on never read with a lexicon from before."""
    docs = spark.createDataFrame([(1, "We met Zanthe Quorlix at the gate.")], "doc_id long, text string")
    names = [spark.createDataFrame(rows, "name_part string, name_kind string, lang string") for rows in ([("zanthe", "given", "en"), ("quorlix", "family", "en")], [("nobody", "given", "en")])]
    found = [pii.find_personal(docs, part).where("kind = 'person'").count() for part in (*names, *names)]
    assert found == [1, 0, 1, 0]


def test_spelled_out_addresses_and_plain_texts():
    reader = pii.Finder()
    texts = ["mail ann.b [at] lake [dot] test now", "met at noon at the lake", "no digits or marks", "write to ann.b@lake.test", "id QQ123456C here"]
    kinds = [[s[2] for s in reader.structural(t)] for t in texts]
    assert kinds == [["email"], [], [], ["email"], ["id_number"]]


def test_one_key_column(spark):
    """Extra columns with clashing names do no harm to the shared reading."""
    df = spark.createDataFrame([(1, "Some text that stands here alone.", 5, "h")], "page_id long, content string, id int, host string").withColumn("lines", F.lit(1))
    assert pages.read_pages(df, "page_id", "content").rows.count() == 1
