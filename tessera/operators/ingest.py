"""Model responses: parsed, checked, and installed as a whole or not at all, with a stamp of where they come from."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.documents import response
from . import state, validation

LEAST_CLAIMS, MOST_CLAIMS = 3, 60
CLAIM = (
    "statement string, claim_type string, evidence_status string, polarity string, confidence double, derivation string, is_primary_evidence boolean, concepts array<string>, "
    "methods array<string>, datasets array<string>, conditions array<string>, support array<struct<unit_id:string,excerpt:string>>"
)


def parse(responses: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """Responses with ``rows`` (an array of the schema) and ``parse_error``."""
    rows = F.from_json(response(F.col(column)), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>")
    return responses.withColumn("rows", rows).withColumn("parse_error", F.when(F.col("rows").isNull(), "not the JSON that was asked for"))


def claims(responses: DataFrame, papers: DataFrame) -> DataFrame:
    """responses (paper_id, body) to claims with ids, duplicate marks, ``errors`` and ``accepted``.

    A paper's claims are accepted together: if all have no errors. Of claims with one normal form the first is the one.
    """
    rows = parse(responses, CLAIM).select("paper_id", F.posexplode("rows").alias("at", "c")).select("paper_id", (F.col("at") + 1).alias("ordinal"), "c.*")
    rows = rows.withColumn("claim_id", T.claim_id(F.col("paper_id"), F.col("statement"), F.col("ordinal"))).withColumn("norm", T.normalize_title(F.col("statement")))
    rows = state.duplicate_statements(rows, ["paper_id"], "norm", ["ordinal"], "claim_id").drop("norm")
    return validation.claim_errors(rows, papers)


def count_warnings(checked: DataFrame) -> DataFrame:
    n = checked.groupBy("paper_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") < LEAST_CLAIMS, "few_claims").when(F.col("n") > MOST_CLAIMS, "many_claims")
    return n.select("paper_id", kind.alias("warning")).where("warning is not null")


def rejected_groups(rows: DataFrame, group: str, errors: str = "errors") -> DataFrame:
    """Groups with their errors: one bad row rejects its group."""
    return rows.select(group, F.explode(errors).alias("error")).groupBy(group).agg(F.array_sort(F.collect_set("error")).alias("errors"))


def topics(rows: DataFrame, papers: DataFrame, response: str | None = None) -> DataFrame:
    """topics (name, papers array<string>, ...) with ids and ``errors``; accepted only if no topic of the same ``response``
    (a column; else they are all of one, of few rows) has any."""
    known = papers.where("status = 'active'").select(F.col("paper_id").alias("ref"), F.lit(True).alias("_known"))
    rows = rows.withColumn("topic_id", T.topic_id(F.col("name")))
    own = ["topic_id", *([response] if response else [])]
    refs = rows.select(*own, F.explode("papers").alias("ref")).join(known, "ref", "left").where("_known is null")
    bad = refs.groupBy(*own).agg(F.array_sort(F.collect_set(F.concat(F.lit("papers:unknown "), "ref"))).alias("errors"))
    out = rows.join(bad, own, "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
    return out.withColumn("accepted", F.max(F.size("errors")).over(Window.partitionBy(*own[1:])) == 0)


def stamped(rows: DataFrame, model: str, prompt: str, version: str, reviewed: bool = False) -> DataFrame:
    stamp = F.struct(F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), F.lit(version).alias("prompt_version"), F.lit(time.strftime("%Y-%m-%dT%H:%M:%S")).alias("at"), F.lit(reviewed).alias("reviewed"))
    return rows.withColumn("provenance", stamp)


def stale_topics(topics_: DataFrame, active: DataFrame) -> DataFrame:
    """Topics with ``stale_papers``: those they name that aren't active any more."""
    refs = topics_.select("topic_id", F.explode("papers").alias("paper_id")).join(active.select("paper_id").distinct(), "paper_id", "left_anti")
    lost = refs.groupBy("topic_id").agg(F.array_sort(F.collect_set("paper_id")).alias("stale_papers"))
    return topics_.join(lost, "topic_id", "left")
