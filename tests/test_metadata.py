from pyspark.sql import functions as F

from tessera.operators import metadata as M

BLOCK = "array<struct<order:int,text:string,style_hint:string,role:string,page_index:int,font_size:double>>"


def rows(spark, papers):
    made = [(pid, path, [(i, t, h, r, p, s) for i, (t, h, r, p, s) in enumerate(blocks)], meta, "\n\n".join(b[0] for b in blocks)) for pid, path, blocks, meta in papers]
    return spark.createDataFrame(made, f"paper_id string, source_path string, blocks {BLOCK}, meta map<string,string>, text string")


def test_cascades(spark):
    papers = [
        ("a", "d/alpha_2019.pdf", [
            ("Journal of Things", "paragraph", "front_matter", 0, 9.0), ("Fast assembly of long noisy reads", "paragraph", "front_matter", 0, 18.0), ("Ann Lee, Bo de Vries and Cy Young1,2", "paragraph", "front_matter", 0, 11.0),
            ("Department of Things, University of X", "paragraph", "front_matter", 0, 9.0), ("doi: 10.1234/Things.2019.7. © 2019 The authors", "paragraph", "front_matter", 0, 8.0), ("Keywords: reads; assembly, graphs", "paragraph", "body", 0, 9.0),
            ("Methods", "heading1", "heading", 0, 12.0), ("We did it. " * 40, "paragraph", "body", 1, 10.0),
        ], {}),
        ("b", "d/notes_supp_(2).html", [("A survey of benchmarks for reads", "heading1", "heading", None, None), ("arXiv:2101.12345 text", "paragraph", "body", None, None)], {"citation_author": "Doe, Jane", "citation_doi": "https://doi.org/10.9/NO", "citation_date": "2020/05/01"}),
        ("c", "d/My_file (3).txt", [("short", "paragraph", "body", None, None)], {"title": "Untitled"}),
    ]
    got = {r.paper_id: r for r in M.extract(rows(spark, papers)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.title, a.authors, a.year, a.venue, a.doi) == ("Fast assembly of long noisy reads", ["Ann Lee", "Bo de Vries", "Cy Young"], 2019, "Journal of Things", "10.1234/things.2019.7")
    assert a.provenance["title"].source == "first_page_largest_font_block" and a.provenance["year"].source == "copyright_line" and a.provenance["doi"].confidence == 0.9
    assert (a.document_type, a.publication_status, a.keywords) == ("research_article", "published", ["reads", "assembly", "graphs"]) and a.abstract.startswith("We did it.")
    assert (b.title, b.authors, b.doi, b.document_type, b.publication_status, b.arxiv_id) == ("A survey of benchmarks for reads", ["Doe", "Jane"], None, "supplementary_material", "preprint", "2101.12345")
    assert b.year == 2021 and b.provenance["year"].source == "arxiv_id" and b.provenance["doi"].source == "not_found"
    assert (c.title, c.authors, c.year, c.venue, c.document_type) == ("My file", [], None, None, "unknown") and c.provenance["title"].source == "filename"


def test_abstract(spark):
    units = spark.createDataFrame([("p", "u0001", "front_matter", ["X"], 500, "front"), ("p", "u0003", "paragraph", ["1 Abstract"], 20, "the abstract"), ("p", "u0002", "paragraph", ["Intro"], 400, "long"), ("q", "u0001", "paragraph", [], 301, "long one"), ("r", "u0001", "table", [], 999, "t")], "paper_id string, unit_id string, kind string, section_path array<string>, n_chars int, text string")
    assert {r.paper_id: r.abstract for r in M.abstract(units).collect()} == {"p": "the abstract", "q": "long one"}


def test_types_and_names(spark):
    one = spark.range(1)
    kind = lambda t, v=None, p="x.pdf", s=(): one.select(M.document_type(F.lit(t), F.lit(None).cast("string"), F.lit(v), F.lit(p), F.array(*map(F.lit, s)).cast("array<string>"))["value"]).first()[0]
    assert [kind("A primer on graphs"), kind("Benchmarking of tools"), kind("A toolkit for reads"), kind("The X corpus"), kind("Plain", s=["Results"]), kind("Plain"), kind("Plain", p="a/b_S1.pdf")] == [
        "review", "benchmark_study", "software_tool_paper", "dataset_paper", "research_article", "unknown", "supplementary_material",
    ]
    assert one.select(M.split_authors(F.lit("A. Bee1*, C Dee and E. Eff; G Hh & I J"))).first()[0] == ["A. Bee", "C Dee", "E. Eff", "G Hh"]
