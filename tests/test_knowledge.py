"""Vocabulary, families, relations, state, policy, checks, packs, files and streams on small frames."""

import io
import time
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.operators import families, graph, mining, policy, state, validation
from tessera.sources import documents, tables
from tessera.streaming import updates


def test_acronyms_and_variants(spark):
    docs = spark.createDataFrame([
        (1, "We count with a Bloom Filter Index (BFI) and then the read depth (RD). A k-mer table."), (2, "Another bloom filter index (BFIs) here, K-mer and kmer, re-use of kmer."), (3, "Big Fat Iguana (BFI). Reuse, re-use."), (4, "(XYZ) alone and no match (ABC)."),
    ], "doc_id long, text string")
    got = {r.acronym: (r.expansion, r.papers, r.confident) for r in mining.acronyms(docs, "doc_id", "text").collect()}
    assert got == {"BFI": ("bloom filter index", 2, True), "RD": ("read depth", 1, False)}
    assert {r.canonical: (r.aliases, r.n) for r in mining.spelling_variants(docs, "text").collect()} == {"re-use": (["reuse"], 3), "k-mer": (["kmer"], 4)} or {r.canonical for r in mining.spelling_variants(docs, "text").collect()} == {"re-use", "kmer"}


def test_terms_and_headings(spark):
    text = "Genome assembly graph building works. The genome assembly graph helps. Genome assembly graph."
    docs = spark.createDataFrame([(1, text), (2, text), (3, "Other words only")], "doc_id long, text string")
    terms = {r.term: (r.papers, r.n) for r in mining.frequent_terms(docs, "doc_id", "text").collect()}
    assert terms["genome assembly graph"] == (2, 6) and "the genome" not in terms
    lead = [r.term for r in mining.leading_terms(mining.frequent_terms(docs, "doc_id", "text")).collect()]
    assert "assembly graph" in lead and not any(a != b and a in b for i, a in enumerate(lead) for b in lead[:i])
    lines = spark.createDataFrame([(1, "Key Points"), (2, "Key points:"), (1, "Author Summary"), (3, "Conflict of Interest: none declared"), (2, "Conflict of Interest: none declared"), (1, "Results"), (2, "Results"), (1, "lower case line"), (2, "lower case line")], "doc_id long, text string")
    assert [(r.heading, r.papers) for r in mining.recurring_headings(lines, "doc_id").collect()] == [("Key Points", 2)]
    assert sorted(r.heading for r in mining.adopted(spark.createDataFrame([("A",)], "heading string"), spark.createDataFrame([("A",), ("B",)], "heading string")).collect()) == ["A", "B"]


@pytest.mark.parametrize("threshold", [0.5, 0.82, 1.0])
def test_similar_pairs_equal_the_quadratic_definition(spark, threshold):
    rng = np.random.default_rng(3)
    sets = {i: sorted(set(rng.integers(0, 14, rng.integers(1, 9)).tolist())) for i in range(70)}
    rows = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in sets.items()], "k long, s array<string>")
    want = {}
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a < b and len(x & y) / len(x | y) >= threshold:
                want[a, b] = len(x & y) / len(x | y)
    got = {(r.a, r.b): r.similarity for r in families.similar_pairs(rows, "k", "s", threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("block", [2, 512])
def test_similar_pairs_of_odd_and_many_keys(spark, monkeypatch, block):
    monkeypatch.setattr(families, "BLOCK", block)
    rng = np.random.default_rng(4)
    kinds = [["a", "b", "c", "d", "e", "f"], ["f", "e", "d", "c", "b", "a", "a"], ["a", "b", "c", "d", "e", "g"], ["a", "b", "c", "d", "e", "f", "h"], ["x"], [], None, ["", "a,b"], ["a", ",b"]]
    rows = [(int(rng.integers(0, 60)) if i % 9 else None, kinds[int(rng.integers(0, len(kinds)))]) for i in range(90)]
    want = []
    for k, s in rows:
        for j, t in rows:
            if k is not None and j is not None and k < j and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.7:
                want.append((k, j, len(set(s) & set(t)) / len(set(s) | set(t))))
    for cast in ("long", "string"):
        given = spark.createDataFrame([(None if k is None else f"{k:03}" if cast == "string" else k, s) for k, s in rows], f"k {cast}, s array<string>")
        got = [(int(r.a), int(r.b), r.similarity) for r in families.similar_pairs(given, "k", "s", 0.7).collect()]
        assert sorted(got) == sorted(want)


def test_similar_pairs_shuffle_little_of_long_sets(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [f"word{x:06}" for x in rng.integers(0, 10**5, 80)]) for i in range(3000)], "k long, s array<string>").localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    assert families.similar_pairs(rows, "k", "s", 0.82).count() == 0
    assert written() - before < 6 * 3000 * 80 * 10  # six times the tokens' bytes; was some forty times, each token with its set


def test_families(spark):
    rows = [
        ("p1", "Fast assembly of long noisy reads", "alpha_2019", "research_article", "published", "10.1/a"), ("p2", "Fast assembly of long noisy reads", "alpha_pre", "research_article", "preprint", None),
        ("p3", "Fast assembly of long noisy reads", "alpha_again", "research_article", "published", "10.1/a"), ("s1", "Supplement", "alpha_2019_supplementary", "supplementary_material", "unknown", None), ("s2", "Odd", "zzz_supp", "supplementary_material", "unknown", None),
    ]
    papers = spark.createDataFrame(rows, "paper_id string, title string, source_stem string, document_type string, publication_status string, doi string")
    got = {(r.source_paper_id, r.target_paper_id): (r.relation, r.confidence) for r in families.detect(papers).collect()}
    assert got["s1", "p1"][0] == "supplement-of" and got["s2", None] == ("supplement-of", 0.2)
    assert got["p2", "p1"] == ("preprint-of", 0.85) and got["p2", "p3"] == ("preprint-of", 0.85) and got["p1", "p3"] == ("possible-duplicate-of", 0.9)
    assert len(got) == 5


def test_relations(spark):
    edges = spark.createDataFrame([("r1", "a", "b", "contradicts"), ("r2", "b", "c", "cites"), ("r3", "a", "a", "qualifies"), ("r4", "c", "a", "qualifies"), ("r5", "a", "d", "contradicts")], "relation_id string, s string, t string, relation string")
    claims = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "claim_id string, name string")
    chosen = spark.createDataFrame([("a",), ("d",)], "claim_id string")
    assert sorted((r.relation_id, r.claim_id, r.name) for r in graph.opposing(edges, claims, chosen, "s", "t").collect()) == [("r1", "b", "B"), ("r4", "c", "C")]
    assert sorted(r.relation_id for r in graph.touching(edges, chosen, "s", "t", "claim_id").collect()) == ["r1", "r3", "r4", "r5"]
    parts = [spark.createDataFrame([("a", 1), ("b", 1)], "claim_id string, n int"), spark.createDataFrame([("b", 2), ("c", 2)], "claim_id string, n int")]
    assert sorted((r.claim_id, r.n) for r in graph.first_of_each(parts, "claim_id", chosen).collect()) == [("b", 1), ("c", 2)]
    neg = spark.createDataFrame([("c1", "p", "negative", "x", 0.5), ("c2", "p", "affirmative", "limitation", None), ("c3", "p", "affirmative", "x", 0.9), ("c4", "q", "mixed", "x", 0.9)], "claim_id string, paper_id string, polarity string, claim_type string, confidence double")
    assert [r.claim_id for r in graph.negative_claims(neg, spark.createDataFrame([("p",)], "paper_id string"), "paper_id").collect()] == ["c1", "c2"]
    assert [r.claim_id for r in graph.claims_for(neg, spark.createDataFrame([("p",)], "paper_id string"), "paper_id", 2).collect()] == ["c3", "c1"]


def test_state(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, content_sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b2", "2"), ("c", "9"), ("e", "5")], "path string, content_sha256 string")
    assert {r.path: (r.change, r.old_path) for r in state.changes(new, old).collect()} == {"a": ("unchanged", "a"), "b2": ("renamed", "b"), "c": ("modified", "c"), "e": ("added", None), "d": ("removed", "d")}
    assert {r.change for r in state.changes(old, old).collect()} == {"unchanged"}
    rows = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 1)], "relation_id string, v string, n int")
    fresh = spark.createDataFrame([("r2", "z", 2), ("r2", "w", 3), ("r3", "n", 4)], "relation_id string, v string, n int")
    assert sorted((r.relation_id, r.v) for r in state.upsert(rows, fresh, "relation_id", "n").collect()) == [("r1", "x"), ("r2", "w"), ("r3", "n")]
    ids = spark.createDataFrame([("p", "aaaa1"), ("p", "bbbb2"), ("q", "cccc3")], "paper_id string, sha string")
    assert sorted(r.paper_id for r in state.distinct_ids(ids, "paper_id", "sha").collect()) == ["p-aaaa", "p-bbbb", "q"]
    stages = spark.createDataFrame([("p", "units", "f1"), ("q", "units", "f2")], "paper_id string, stage string, fingerprint string")
    one = state.corpus_fingerprint(stages, "units", "paper_id").first()[0]
    assert one == state.corpus_fingerprint(stages.orderBy(F.desc("paper_id")), "units", "paper_id").first()[0]
    assert one != state.corpus_fingerprint(stages.where("paper_id = 'p'"), "units", "paper_id").first()[0]


@pytest.mark.parametrize("path,size,want", [
    ("a/x.csv", 999_999, ("csv", "upload")), ("a/x.csv", 1_000_000, ("csv", "upload")), ("a/x.csv", 1_000_001, ("csv", "exclude")), ("R1.FASTQ.gz", 5, ("experimental", "exclude")), ("x.tar.gz", 5, ("archive", "exclude")),
    ("p.PNG", 1_000_001, ("image", "convert")), ("p.png", 1_000_000, ("image", "upload")), ("p.tiff", 1, ("image-source", "convert")), ("d.docx", 1, ("word", "migrate")), ("s.xlsx", 1, ("excel", "exclude")), ("LICENSE", 1, ("text", "upload")),
    ("README.unknown", 1, ("text", "upload")), ("m.npy", 1, ("data-binary", "exclude")), ("t.pptx", 1, ("powerpoint", "exclude")), ("v.mp4", 1, ("media", "exclude")), ("lib.so", 1, ("executable", "exclude")), ("odd.qqq", 1, ("unknown", "ask")), ("a.pdf", 1, ("pdf", "convert")),
])
def test_policy(spark, path, size, want):
    r = spark.createDataFrame([(path, size)], "path string, size long").select(policy.classify(F.col("path"), F.col("size")).alias("p")).first().p
    assert (r.category, r.decision) == want


def test_policy_flags_and_plan(spark):
    r = spark.createDataFrame([("x.qqq", 1)], "path string, size long").select(
        policy.classify(F.col("path"), F.col("size"), has_nul=F.lit(True)).alias("a"), policy.classify(F.col("path"), F.col("size"), symlink_outside=F.lit(True)).alias("b"),
        policy.output_name(F.lit("a.b/c.d.pdf"), F.lit("pdf")).alias("o"), policy.refused_root(F.lit("/home/u/Desktop/"), "/home/u").alias("x"), policy.refused_root(F.lit("/home/u/work"), "/home/u").alias("y"),
    ).first()
    assert (r.a.category, r.b.category, r.o, r.x, r.y) == ("binary", "symlink", "a.b/c.d.git.pdf", True, False)
    plan = spark.createDataFrame([("a", "o", True, False, None), ("../b", "o", False, False, ["force"]), (".git/c", None, True, True, [])], "path string, output string, consented boolean, archived boolean, keys array<string>")
    got = {r.path: r.errors for r in policy.plan_errors(plan, "/p").collect()}
    assert got == {"a": ["outputs collide"], "../b": ["not approved", "path leaves the project", "outputs collide", "forbidden option"], ".git/c": ["path leaves the project", "archived without its output"]}


def test_checks(spark):
    rows = spark.createDataFrame([("c1", "p", "A statement of some length.", "limitation", ["x"], "reported", None), ("c2", "p", " ", "odd", [], "inferred", None), ("c3", "q", "Fine statement.", "limitation", ["y"], "inferred", "sum"), ("c4", "z", "Fine.", "limitation", ["y"], None, None)], "claim_id string, paper_id string, statement string, claim_type string, support array<string>, evidence_status string, derivation string")
    papers = spark.createDataFrame([("p", "active"), ("q", "active"), ("z", "tombstoned")], "paper_id string, status string")
    got = {r.claim_id: (r.errors, r.accepted) for r in validation.claim_errors(rows, papers).collect()}
    assert got["c1"] == ([], False) and got["c3"] == ([], True) and got["c4"] == (["paper_id:unknown"], False) and len(got["c2"][0]) == 4
    with pytest.raises(ValueError):
        validation.column_checks({"a": {"oneOf": []}})
    units = spark.createDataFrame([("p", "u1", 0, 40, "The quick brown fox jumps over the dog."), ("p", "u2", 42, 60, "It sleeps again.")], "paper_id string, unit_id string, char_start int, char_end int, text string")
    texts = spark.createDataFrame([("p", "The quick brown fox jumps over the dog.\n\n It sleeps again.")], "paper_id string, text string")
    loc = spark.createDataFrame([("l1", "p", "u1", "quick brown fox", None), ("l2", "p", "u1", "It sleeps again", 0.9), ("l3", "p", "u1", "nowhere", 0.9)], "locator_id string, paper_id string, unit_id string, excerpt string, confidence double")
    out = {r.locator_id: (r.unit_id, r.char_start, r.confidence, r.warnings) for r in validation.resolve_locators(loc, units, texts).collect()}
    assert out["l1"] == ("u1", 4, 0.8, []) and out["l2"] == ("u2", 42, 0.9, ["unit corrected"]) and out["l3"] == ("u1", None, 0.3, ["excerpt not found"])
    full = spark.createDataFrame([("l1", "p", "u1", 4, 19, "quick brown fox"), ("l2", "p", "u9", 0, 1, "x"), ("l3", "p", "u1", 30, 45, "quick brown fox")], "locator_id string, paper_id string, unit_id string, char_start int, char_end int, excerpt string")
    assert sorted((r.id, r.kind) for r in validation.locator_issues(full, units).collect()) == [("l2", "broken_locator"), ("l3", "offset_drift"), ("l3", "offset_outside_unit")]
    pages = spark.createDataFrame([("a", "[x](b.md) [y](http://z) [w](gone.md#s)")], "page string, text string")
    assert [tuple(r) for r in validation.link_errors(pages, spark.createDataFrame([("b.md",)], "path string"), "page", "text").collect()] == [("a", "gone.md")]
    rel = spark.createDataFrame([("r", "p", "z", None, None, "contradicts", None)], "relation_id string, source_paper_id string, target_paper_id string, source_claim_id string, target_claim_id string, relation string, difference_explanations array<string>")
    assert validation.relation_errors(rel, papers, rows).first().errors == ["target_paper_id:unknown", "difference_explanations:required"]


def test_locators_of_a_long_text_in_time(spark):
    """Each quote meets its unit, or its text once with others; not the whole text and all of its units for each quote."""
    n = 1500
    lines = spark.range(n).select(F.col("id").alias("unit_id"), F.expr("repeat(concat('word', id, ' '), 20)").alias("text")).collect()
    begins = np.cumsum([0, *(len(r.text) + 1 for r in lines)]).tolist()
    units = spark.createDataFrame([("p", r.unit_id, a, a + len(r.text), r.text) for r, a in zip(lines, begins)], "paper_id string, unit_id long, char_start long, char_end long, text string")
    texts = spark.createDataFrame([("p", "\n".join(r.text for r in lines))], "paper_id string, text string")
    named = lambda i: i if i % 3 else (i + 7) % n
    loc = spark.createDataFrame([(i, "p", named(i), f"word{i} Word{i} " * (19 // 2), None) for i in range(n)], "locator_id long, paper_id string, unit_id long, excerpt string, confidence double")
    began = time.monotonic()
    out = {r.locator_id: (r.unit_id, r.char_start, r.warnings) for r in validation.resolve_locators(loc, units, texts).collect()}
    assert time.monotonic() - began < 60
    assert out == {i: (i, begins[i], [] if i % 3 else ["unit corrected"]) for i in range(n)}


def test_a_locator_has_one_unit(spark):
    text = "One two three four five. Six seven eight."
    units = spark.createDataFrame([("p", "whole", 0, 41, text), ("p", "first", 0, 24, text[:24]), ("p", "none", 25, 25, ""), ("p", "last", 25, 41, text[25:])], "paper_id string, unit_id string, char_start int, char_end int, text string")
    texts = spark.createDataFrame([("p", text)], "paper_id string, text string")
    loc = spark.createDataFrame([(1, "p", "first", "two three", None), (2, "p", "first", "seven eight", None), (3, "p", None, "two three", None), (4, "p", "first", None, None), (5, "q", "first", "two", None), (6, None, None, "two", None)], "locator_id long, paper_id string, unit_id string, excerpt string, confidence double")
    out = sorted((r.locator_id, r.unit_id, r.char_start) for r in validation.resolve_locators(loc, units, texts).collect())
    assert out == [(1, "first", 4), (2, "whole", 29), (3, "first", 4), (4, "first", None), (5, "first", None), (6, None, None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(500, 4000), st.lists(st.integers(1, 3000), max_size=12), st.lists(st.integers(1, 3000), max_size=6))
def test_packs_keep_their_budget(budget, claims, counter):
    evidence = C.Evidence(claims=[{"id": i, "text": "c" * n} for i, n in enumerate(claims)], counter=[{"id": 100 + i, "text": "x" * n} for i, n in enumerate(counter)], passages=[{"id": 200 + i, "text": "p" * 400} for i in range(9)])
    text, strategy = C.pack("A question?", evidence, budget)
    floor = sum(sorted(C.tokens("c" * n) for n in claims)[-2:]) + max([C.tokens("x" * n) for n in counter], default=0) + 40
    assert C.tokens(text) == strategy["tokens"] <= max(budget, floor)
    ids = strategy["included"]["Claims"]
    assert ids == list(range(len(ids)))


def test_budget_and_evaluation():
    b = C.Budget(100, {"a": 0.5, "b": 0.5}, 1)
    assert b.take("a", "x" * 40) and b.take("a", "x" * 30) and not b.take("a", "x" * 10) and b.borrowed == {"a": 31}
    text, strategy = C.pack("Q?", C.Evidence(claims=[{"id": "c1", "text": "[p1] It works."}], counter=[{"id": "c2", "text": "[p2] It fails."}]))
    out = C.evaluate(text, strategy, {"id": 1, "expect_papers": ["p1"], "expect_claims": ["c1"], "must_include_terms": ["WORKS"], "expect_counterevidence": True})
    assert out["passed"] and out["citation_coverage"] == 1.0
    assert not C.evaluate(text, strategy, {"id": 2, "expect_claims": ["c9"]})["passed"]


def docx():
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t><w:tab/><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
        z.writestr("docProps/core.xml", '<x xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A title</dc:title></x>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, data in {"a.md": b"# Head\n\ntext", "sub/b.html": b"<h1>T</h1><p>x</p>", "c.docx": docx(), "d.zip": docx(), "e.rtf": b"{}", "f.txt": b"", "g.docx": b"broken", ".hidden/h.md": b"no", "skip.md": b"# no"}.items():
        (tmp_path / name).write_bytes(data)
    files = documents.scan(spark, str(tmp_path), ignore=["skip.*"]).cache()
    assert {r.path: (r.category, r.reason) for r in files.collect()} == {
        "a.md": ("document", None), "sub/b.html": ("document", None), "c.docx": ("document", None), "g.docx": ("document", None), "d.zip": ("archive", None), "e.rtf": ("unsupported", "unsupported format: rtf"), "f.txt": ("unsupported", "empty file"),
    }
    read = {r.path: r for r in documents.read_documents(files).collect()}
    assert [b.text for b in read["c.docx"].blocks] == ["Top", "Body text", "1 | 2"] and read["c.docx"].meta == {"title": "A title"}
    assert read["a.md"].blocks[0].style_hint == "heading1" and read["g.docx"].error.startswith("BadZipFile") and len(read) == 4
    assert [c.name for c in documents.archive_listing(files).first().contents] == ["word/document.xml", "docProps/core.xml"]
    assert spark.range(1).select(documents.response(F.lit('```json\n{"a": 1}\n```'))).first()[0] == '{"a": 1}'


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace(spark.range(3), path)
    tables.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    tables.begin(spark, str(tmp_path), "index")
    assert tables.unfinished(spark, str(tmp_path)) == ["index"]
    tables.end(spark, str(tmp_path), "index")
    assert tables.unfinished(spark, str(tmp_path)) == []
    tables.append_log(spark, str(tmp_path / "log"), "build", "x")
    tables.append_log(spark, str(tmp_path / "log"), "build", "y")
    assert sorted(r.detail for r in tables.read_jsonl(spark, str(tmp_path / "log"), "at string, action string, detail string").collect()) == ["x", "y"]
    assert tables.write_index({"postings": spark.createDataFrame([("a", 1)], "term string, n int")}, str(tmp_path / "index")) == {"postings": 1}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    for k, rows in enumerate([[("a", "1"), ("b", "2")], [("a", "9"), ("c", "2")]]):
        spark.createDataFrame(rows, "path string, content_sha256 string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("path string, content_sha256 string").parquet(str(source))
        updates.run(stream, str(tmp_path / "manifest"), str(tmp_path / "checkpoint"), str(tmp_path / "changes")).awaitTermination()
    got = {(r.path, r.content_sha256) for r in updates.manifest(spark, str(tmp_path / "manifest")).collect()}
    assert got == {("a", "9"), ("c", "2")}
    assert sorted((r.path, r.change) for r in spark.read.parquet(str(tmp_path / "changes")).collect()) == [("a", "added"), ("a", "modified"), ("b", "added"), ("c", "renamed")]
