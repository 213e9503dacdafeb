"""Blocks, units and sentences: offsets index the text, units tile blocks, heads and columns are found."""

import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.udfs import _matchable, excerpt_span, fold, sentences
from tessera.operators import structure as S
from tessera.sources import html as H
from tessera.sources.documents import front_matter, parse_text

HTML = """<html><head><title>A page</title><meta name="citation_doi" content="10.1/x"></head><body><nav><p>Menu</p></nav>
<h1>Abstract</h1><p>First paragraph &amp; more.<p>Second one<br>with a line<script>var x;</script></p><div id="d"><ul><li>An item</li></ul></div>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><figcaption>Figure 1. A caption</figcaption>loose text<footer>Foot</footer></body></html>"""


def test_html():
    blocks, meta = H.parse(HTML)
    assert [(b["style_hint"], b["text"]) for b in blocks] == [
        ("heading1", "Abstract"), ("paragraph", "First paragraph & more."), ("paragraph", "Second one\nwith a line"), ("list_item", "An item"),
        ("table_row", "A | B"), ("table_row", "1 | 2"), ("caption", "Figure 1. A caption"),
    ]
    assert meta == {"title": "A page", "citation_doi": "10.1/x"} and blocks[3]["anchor"] == "d"


def test_markdown_and_text():
    blocks, meta = parse_text("---\ntitle: Notes\nauthors: [A, B]\n---\n# Top\n\nText one\ngoes on\n\n```\ncode\n\nmore\n```\nUnder\n-----\nEnd", True)
    assert meta == {"title": "Notes", "authors": "A; B"}
    assert [(b["style_hint"], b["text"]) for b in blocks] == [("heading1", "Top"), ("paragraph", "Text one\ngoes on"), ("code_block", "```\ncode\n\nmore\n```"), ("heading2", "Under"), ("paragraph", "End")]
    blocks, _ = parse_text("MINUTES OF THE DAY\nWe met.\n\n1. Agenda\nItems, and so on.", False)
    assert [b["style_hint"] for b in blocks] == ["heading2", "paragraph", "heading2", "paragraph"]
    assert S._clean("k-mer\u200b x\u00a0 y\ue123", False) == "k-mer x y"
    assert front_matter("---\n: bad: [\n---\nx")[0] == {}


def block(text, **k):
    return {"text": text, "n_lines": text.count("\n") + 1, "style_hint": "paragraph", "page_index": None} | k


def test_roles_and_sections():
    rows = [
        block("A long enough title of the paper"), block("Abstract", style_hint="heading1"), block("We show things. " * 10), block("2.1 Data sets"), block("Table 1. Counts of things"),
        block("a | b", style_hint="table_row"), block("x = y + z^2 ± 4"), block("Methods\n" + "We did a number of things to the data here. " * 2), block("References"), block("1. Someone, 2001."), block("Appendix"), block("More text."),
    ]
    text, out = S.assemble(rows)
    assert [b["role"] for b in out] == ["front_matter", "heading", "body", "heading", "caption", "table", "equation_candidate", "heading", "body", "heading", "references", "heading", "body"]
    assert out[3]["section_path"] == ["Abstract", "2.1 Data sets"] and out[8]["section_path"] == ["Methods"]
    for b in out:
        if b["char_start"] is not None:
            assert text[b["char_start"] : b["char_end"]]
    units = S.unitize(text, out)
    assert all(text[u["char_start"] : u["char_end"]] == u["text"] for u in units)
    assert [u["kind"] for u in units] == ["front_matter", "paragraph", "caption", "table", "equation_candidate", "paragraph", "paragraph"]
    assert not any("Someone" in u["text"] for u in units)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["body", "body", "heading", "table"]), st.integers(1, 900)), max_size=30))
def test_units_tile_their_blocks(parts):
    rows = [block("w" * n if role != "heading" else "Methods", style_hint={"table": "table", "heading": "heading2"}.get(role, "paragraph")) for role, n in [("heading", 1), *parts]]
    rows[0]["text"] = "Abstract"
    text, out = S.assemble(rows)
    units = S.unitize(text, out)
    covered = [b for u in units for b in u["block_ids"]]
    assert covered == [b["block_id"] for b in out if b["role"] != "heading" and b["char_start"] is not None]
    for u in units:
        assert text[u["char_start"] : u["char_end"]] == u["text"] and (len(u["block_ids"]) == 1 or u["n_chars"] <= S.MAX_CHARS)
        assert [u["unit_id"] for u in units] == [f"u{i + 1:04d}" for i in range(len(units))]
        for a, z in u["sentence_offsets"]:
            assert u["char_start"] <= a < z <= u["char_end"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\"()1\nFig", max_size=120))
def test_sentences_cover_the_text(text):
    spans = sentences(text)
    assert all(a < z for a, z in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))
    assert re.sub(r"\s", "", "".join(text[a:z] for a, z in spans)) == re.sub(r"\s", "", text)


def test_sentences():
    text = 'We used Fig. 2 of Smith et al. in this work. It was 3.5 times "better." Short. Was it really so? Yes!'
    assert [text[a:z] for a, z in sentences(text)] == ["We used Fig. 2 of Smith et al. in this work.", 'It was 3.5 times "better."', "Short. Was it really so?", "Yes!"]


def test_excerpts():
    text = "The “quick”  brown\nfox — jumps over the ﬁrst lazy dog and then it sleeps for a while."
    assert excerpt_span(text, 'the "quick" brown fox - jumps') == {"start": 0, "end": 30, "mode": "exact"}
    got = excerpt_span(text, "fox - jumps over the first lazy dog and then it SOMETHING ELSE")
    assert got["mode"] == "head" and text[got["start"] :].startswith("fox")
    assert excerpt_span(text, "not there") is None and excerpt_span(None, "x") is None
    assert fold("Ångström naïve ﬁ") == "Angstrom naive fi"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB .,\n\t\r\u00a0\u00ad\u2019\u2014\u03a3\u03c3\u0130\u00c9\ufb01\ue000\u3000"), max_size=30))
def test_folding_of_runs_is_that_of_characters(text):
    folded, places = _matchable(text)
    alone = [(c, i) for i, x in enumerate(text) for c in ("" if x == "\r" else " " if x.isspace() else _matchable(x)[0])]
    want = [p for k, p in enumerate(alone) if p[0] != " " or (k and alone[k - 1][0] != " ")]
    want = want[:-1] if want and want[-1][0] == " " else want
    assert (folded, list(places)) == ("".join(c for c, _ in want), [i for _, i in want])


def test_running_heads_and_columns(spark):
    rows = [(f"p{p}", p, 0, f"Journal of Things {p}", 1, 10.0, 20.0, 100.0, 500.0, 1000.0, 5) for p in range(4)] + [("x", 1, 1, "Body text", 1, 400.0, 420.0, 100.0, 500.0, 1000.0, 5), ("x", 2, 2, "17", 1, 980.0, 990.0, 100.0, 500.0, 1000.0, 5)]
    frame = spark.createDataFrame([("doc", *r[1:]) for r in rows], "paper_id string, page_index int, order int, text string, n_lines int, y0 double, y1 double, x0 double, x1 double, page_height double, n_pages int")
    roles = {(r.page_index, r.text): r.role for r in S.running_heads(frame).collect()}
    assert roles[0, "Journal of Things 0"] == "header" and roles[2, "17"] == "page_number" and roles[1, "Body text"] is None
    boxes = [("l1", 0, 10, 40, 50), ("r1", 60, 10, 100, 50), ("wide", 0, 60, 100, 70), ("r2", 60, 80, 100, 90), ("l2", 0, 81, 40, 95), ("l3", 0, 96, 40, 99), ("r3", 60, 96, 100, 99)]
    frame = spark.createDataFrame([("d", 0, i, n, float(a), float(b), float(c), float(d)) for i, (n, a, b, c, d) in enumerate(boxes)], "paper_id string, page_index int, order int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in S.reading_order(frame).orderBy("rank").collect()] == ["l1", "r1", "wide", "l2", "l3", "r2", "r3"]


def test_fonts_labels_and_quality(spark):
    frame = spark.createDataFrame([("p", "a" * 400, 10.0, None), ("p", "b", 20.0, None), ("p", "c" * 80, 12.0, None), ("p", "h" * 4000, 99.0, "header")], "paper_id string, text string, font_size double, role string")
    assert S.body_font_size(frame).first().body_size == 10.0
    labels = spark.createDataFrame([("p", 0, 0, "11", "page_number"), ("p", 1, 1, "12", "page_number"), ("q", 0, 0, "3", "page_number"), ("q", 1, 1, "9", "page_number")], "paper_id string, page_index int, order int, text string, role string")
    assert [(r.paper_id, r.label_offset) for r in S.page_labels(labels).collect()] == [("p", 11)]
    texts = spark.createDataFrame([(1, "x" * 300), (2, "x"), (3, "(cid:1) " * 40), (4, "ab " * 60 + "-.,;" * 20), (5, None)], "doc_id long, text string")
    assert {r.doc_id: r.text_quality for r in S.quality(texts).collect()} == {1: "good", 2: "empty", 3: "poor", 4: "poor", 5: "empty"}


def test_shares_of_letters_are_exact(spark):
    sizes = [(n, k) for p in (55, 65) for n in range(200, 1000, 20) for k in (n * p // 100 - 1, n * p // 100)]
    frame = spark.createDataFrame([(i, "a" * k + "." * (n - k)) for i, (n, k) in enumerate(sizes)], "doc_id long, text string")
    want = {i: ("poor" if k * 100 < n * 55 else "fair" if k * 100 < n * 65 else "good") for i, (n, k) in enumerate(sizes)}
    assert {r.doc_id: r.text_quality for r in S.quality(frame).collect()} == want
    marked = spark.createDataFrame([(k, "a" * (700 - k) + "\ufffd" * k) for k in (7, 8)], "doc_id long, text string")
    assert {r.doc_id: r.text_quality for r in S.quality(marked).collect()} == {7: "good", 8: "poor"}


def test_text_expressions(spark):
    one = spark.createDataFrame([(" 2.1  Materials and Methods: ", "see Table S2. Counts", "doi:10.1000/AbC.12).", "Doe, Jane", "arXiv: 2101.12345v2", "co\u00adop inter-\nnal\x05 k-mer\u00a0 text\ue001 ")], "h string, c string, d string, a string, x string, t string")
    r = one.select(
        T.canonical_heading(F.col("h")).alias("h"), T.is_caption(F.col("c")).alias("c"), T.caption_label(F.lit("Fig. 3: x")).alias("l"), T.normalize_doi(F.col("d")).alias("d"), T.last_name(F.col("a")).alias("a"),
        T.arxiv_id(F.col("x")).alias("x"), T.normalize_block(F.col("t")).alias("t"), T.slug(F.lit("The Art of a Long Title Indeed")).alias("s"), T.mask(F.lit("Vol. 12   Page 3")).alias("m"),
        T.mentions(F.lit("the output of TP"), "TP").alias("m1"), T.mentions(F.lit("the output"), "TP").alias("m2"), T.human_size(F.lit(2500000)).alias("z"), T.plausible_title(F.lit("A title of some words")).alias("p"),
        T.unit_id(F.lit(7)).alias("u"), T.jaccard(T.token_set(F.lit("one two three")), T.token_set(F.lit("two three four"))).alias("j"), T.looks_like_equation(F.lit("x = y + 2")).alias("e"),
    ).first()
    assert r.asDict() == {
        "h": "materials and methods", "c": False, "l": "Fig. 3", "d": "10.1000/abc.12", "a": "doe", "x": "2101.12345v2", "t": "coop internal k-mer text", "s": "art-long-title-indeed", "m": "vol. # page #",
        "m1": True, "m2": False, "z": "2.5 MB", "p": True, "u": "u0007", "j": 0.5, "e": True,
    }
    meta = spark.createDataFrame([("10.1/zz", 0.9, "Ann Lee", 2020, "A Study of Reads")], "doi string, c double, author string, year int, title string")
    none = F.lit(None).cast("string")
    key = T.identity(F.lit("10.1234/zz"), F.col("c"), none, none, none, F.col("author"), F.col("year"), F.col("title"), F.lit("ff" * 32))
    r = meta.select(key["basis"].alias("b"), T.paper_id(key["key"], F.col("author"), F.col("year"), F.col("title")).alias("id")).first()
    assert r.b == "doi" and re.fullmatch(r"lee-2020-study-reads-[0-9a-f]{6}", r.id)


def test_units_on_the_cluster(spark):
    rows = [(p, i, t, h, 1) for p in ("a", "b") for i, (t, h) in enumerate([("Abstract", "heading1"), ("Some words. " * 30, "paragraph"), ("More words. " * 3, "paragraph")])]
    out = S.units(spark.createDataFrame(rows, "paper_id string, order int, text string, style_hint string, n_lines int")).toPandas()
    assert sorted(out.groupby("paper_id").size()) == [2, 2] and isinstance(out, pd.DataFrame)
