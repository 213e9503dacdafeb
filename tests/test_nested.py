from pyspark.sql import functions as F

from tessera.operators import nested as N
from tessera.sources import git as G

LOC = "array<struct<unit_id:string,excerpt:string>>"


def test_profiles(spark):
    rows = spark.createDataFrame(
        [("p", (([("found", "author_stated", None, [("u1", "x")]), ("bare", "shown_by_result", None, [])]), ([("guess", "agent_inferred", None, [])],)))],
        f"paper_id string, analysis struct<findings:array<struct<text:string,basis:string,rationale:string,locators:{LOC}>>,deep:struct<limits:array<struct<text:string,basis:string,rationale:string,locators:{LOC}>>>>",
    )
    assert N.lists_with(rows.schema, "locators") == ["analysis.findings", "analysis.deep.limits"]
    assert sorted((r.kind, r.detail) for r in N.statement_issues(rows, "paper_id").collect()) == [("missing_locator", "analysis.findings#1"), ("schema_error", "analysis.deep.limits#0")]
    assert [(r.path, r.unit_id) for r in N.locators(rows, "paper_id").collect()] == [("analysis.findings", "u1")]


def test_synthesis_and_status(spark):
    point = "array<struct<text:string,claim_ids:array<string>,paper_ids:array<string>>>"
    rows = spark.createDataFrame([("t1", [("a", ["c1", "gone"], ["p"]), ("b", [], ["lost"])], [("n", [], None)])], f"topic_id string, agreements {point}, notes {point}")
    claims, active = spark.createDataFrame([("c1",)], "claim_id string"), spark.createDataFrame([("p", "active")], "paper_id string, status string")
    issues = N.synthesis_issues(rows, "topic_id", claims, active)
    assert sorted(r.kind for r in issues.collect()) == ["dangling_reference", "dangling_reference", "unsupported_synthesis"]
    stages = spark.createDataFrame([("p", "claims", "f1"), ("p", "profile", "f2"), ("p", "parse", "f")], "paper_id string, stage string, fingerprint string")
    recorded = spark.createDataFrame([("p", "claims", "old"), ("p", "profile", "f2")], "paper_id string, stage string, fingerprint string")
    assert [tuple(r) for r in N.pending(stages, recorded, "paper_id").collect()] == [("claims", "p")]
    from tessera.operators.state import staleness

    got = {(r.what, r.value): r.n for r in N.status(active, staleness(stages, recorded, "paper_id"), issues).collect()}
    assert got["papers", "active"] == 1 and got["stage claims", "stale"] == 1 and got["stage parse", "missing"] == 1 and got["issues", "dangling_reference"] == 2
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert [r.path for r in N.missing_from(paths("a", "b"), paths("a")).collect()] == ["b"]


def test_git(spark):
    lines = spark.createDataFrame([(" M src/a.py",), ("R  old name.txt -> new name.txt",), ("?? \"odd name.csv\"",), ("A  x -> y.md",), ("",)], "value string")
    assert sorted(tuple(r) for r in G.status_entries(lines).na.fill("-").collect()) == [("new name.txt", "old name.txt", "R"), ("odd name.csv", "-", "??"), ("src/a.py", "-", "M"), ("x -> y.md", "-", "A")]
    listed, counts = G.ignored_convertibles(spark.createDataFrame([("b.tif",), ("a.PDF",), ("c.py",)], "path string"), 1)
    assert [r.path for r in listed.collect()] == ["a.PDF"] and {r.ext: r.n for r in counts.collect()} == {"tif": 1, "pdf": 1}
    data = spark.createDataFrame([(bytearray(b"text"),), (bytearray(b"a\x00b"),), (bytearray(b"x" * 9000 + b"\x00"),)], "content binary")
    assert [r[0] for r in data.select(G.looks_binary(F.col("content"))).collect()] == [False, True, False]
