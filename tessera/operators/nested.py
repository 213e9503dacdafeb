"""Checks inside nested analyses: statements with their locators, and synthesis points with what they rest on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from . import state, validation

# Bases that need a locator, and lists of a synthesis whose points must name claims.
GROUNDED_BASIS = ["author_stated", "shown_by_result"]
GROUNDED_LISTS = [
    "agreements", "qualified_agreements", "genuine_disagreements", "apparent_disagreements_explained", "common_limitations", "understudied_conditions", "open_questions",
    "strong_agreement", "qualified_agreement", "genuine_contradictions", "apparent_contradictions_explained", "evidence_strength_assessment", "failure_modes", "research_gaps",
]


def lists_with(schema: t.DataType, field: str, at: str = "") -> list[str]:
    """Paths of the arrays of structs in a schema whose elements have a field of that name, at any depth of structs."""
    if not isinstance(schema, t.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        if isinstance(f.dataType, t.ArrayType) and isinstance(f.dataType.elementType, t.StructType):
            out += [path] * (field in f.dataType.elementType.names)
        else:
            out += lists_with(f.dataType, field, path)
    return out


def statements(rows: DataFrame, key: str, paths: list[str] | None = None) -> DataFrame:
    """(key, path, at, text, basis, rationale, locators) of every statement that has locators, of all nested lists."""
    paths = lists_with(rows.schema, "locators") if paths is None else paths
    parts = []
    for p in paths:
        x = rows.select(key, F.lit(p).alias("path"), F.posexplode(p).alias("at", "s"))
        names = x.schema["s"].dataType.names
        pick = [(F.col(f"s.{c}") if c in names else F.lit(None).cast("string")).alias(c) for c in ("text", "basis", "rationale")]
        parts.append(x.select(key, "path", "at", *pick, F.col("s.locators").alias("locators")))
    return reduce(DataFrame.unionByName, parts)


def locators(rows: DataFrame, key: str, paths: list[str] | None = None) -> DataFrame:
    """One row for each locator of every statement: (key, path, at, nth, its fields)."""
    return statements(rows, key, paths).select(key, "path", "at", F.posexplode("locators").alias("nth", "l")).select(key, "path", "at", "nth", "l.*")


def statement_issues(rows: DataFrame, key: str, paths: list[str] | None = None) -> DataFrame:
    """missing_locator where a grounded statement has none, schema_error where an inference has no rationale."""
    checks = [
        ("missing_locator", ~F.coalesce(F.col("basis").isin(GROUNDED_BASIS), F.lit(False)) | (F.size(F.coalesce("locators", F.array())) > 0)),
        ("schema_error", (F.coalesce("basis", F.lit("")) != "agent_inferred") | F.col("rationale").isNotNull()),
    ]
    found = statements(rows, key, paths)
    return found.select(F.explode(validation.errors(checks)).alias("kind"), F.col(key).cast("string").alias("id"), F.concat_ws("#", "path", "at").alias("detail"))


def synthesis_issues(rows: DataFrame, key: str, claims: DataFrame, active: DataFrame) -> DataFrame:
    """Points of a synthesis without claims, and references to claims and papers that don't exist (any more)."""
    parts = []
    for p in [p for p in lists_with(rows.schema, "claim_ids") if p.split(".")[-1] in GROUNDED_LISTS]:
        parts.append(rows.select(key, F.lit(p).alias("path"), F.explode(p).alias("s")).select(key, "path", F.coalesce("s.claim_ids", F.array().cast("array<string>")).alias("claim_ids"), F.coalesce("s.paper_ids", F.array().cast("array<string>")).alias("paper_ids")))
    points = reduce(DataFrame.unionByName, parts)
    where = [F.col(key).cast("string").alias("id"), F.col("path").alias("detail")]
    bare = points.where(F.size("claim_ids") == 0).select(F.lit("unsupported_synthesis").alias("kind"), *where)
    lost = lambda refs, known, name: refs.join(known.select(F.col(name).alias("ref")).distinct(), "ref", "left_anti").select(F.lit("dangling_reference").alias("kind"), *where)
    claim_refs = points.select(key, "path", F.explode("claim_ids").alias("ref"))
    paper_refs = points.select(key, "path", F.explode("paper_ids").alias("ref"))
    return bare.union(lost(claim_refs, claims, "claim_id")).union(lost(paper_refs, active, "paper_id"))


def status(papers: DataFrame, stages: DataFrame, issues: DataFrame) -> DataFrame:
    """(what, value, n): papers by status, stages by state, issues by kind."""
    parts = [
        papers.groupBy(F.lit("papers").alias("what"), F.col("status").alias("value")).agg(F.count("*").alias("n")),
        stages.groupBy(F.concat(F.lit("stage "), F.col("stage")).alias("what"), F.col("state").alias("value")).agg(F.count("*").alias("n")),
        issues.groupBy(F.lit("issues").alias("what"), F.col("kind").alias("value")).agg(F.count("*").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def missing_from(staged: DataFrame, approved: DataFrame, key: str = "path") -> DataFrame:
    """What is staged and was never approved."""
    return staged.select(key).distinct().join(approved.select(key), key, "left_anti")


def pending(expected: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(stage, key) of the model stages of papers that are missing or stale."""
    return state.staleness(expected, recorded, key).where(F.col("stage").isin("profile", "claims") & (F.col("state") != "current")).select("stage", key)
