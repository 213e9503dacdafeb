"""Look-ups along typed relations between papers and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Relations that make a pack of evidence two-sided, and what counts as negative evidence.
DISAGREEMENT = ["contradicts", "partially-contradicts", "qualifies", "fails-to-reproduce", "studies-different-context"]
NEGATIVE_POLARITY = ["negative", "null_result", "mixed"]
NEGATIVE_TYPE = ["negative_result", "limitation"]


def _endpoints(relations: DataFrame, source: str, target: str) -> DataFrame:
    """One row for each distinct end of each relation, so an OR of two joins becomes one equi-join."""
    return relations.withColumn("end", F.explode(F.array_distinct(F.array(source, target))))


def opposing(relations: DataFrame, claims: DataFrame, chosen: DataFrame, source="source_claim_id", target="target_claim_id", key="claim_id") -> DataFrame:
    """Claims that a disagreement ties to a chosen one and that aren't chosen: the relation's columns with the claim's.

    A claim comes once for each such relation.
    """
    ids = chosen.select(F.col(key).alias("end")).distinct()
    edges = relations.where(F.col("relation").isin(DISAGREEMENT))
    touched = _endpoints(edges, source, target).join(ids, "end", "left_semi").drop("end").distinct()
    other = _endpoints(touched, source, target).join(ids, "end", "left_anti")
    return other.join(claims.withColumnRenamed(key, "end"), "end").withColumnRenamed("end", key)


def touching(relations: DataFrame, chosen: DataFrame, source: str, target: str, key: str, relation_id: str = "relation_id") -> DataFrame:
    """Relations with a chosen id at either end, each once."""
    ids = chosen.select(F.col(key).alias("end")).distinct()
    hit = _endpoints(relations, source, target).join(ids, "end", "left_semi")
    return hit.drop("end").dropDuplicates([relation_id])


def is_negative(polarity="polarity", claim_type="claim_type"):
    return F.coalesce(F.col(polarity).isin(NEGATIVE_POLARITY), F.lit(False)) | F.coalesce(F.col(claim_type).isin(NEGATIVE_TYPE), F.lit(False))


def negative_claims(claims: DataFrame, papers: DataFrame, key: str, limit: int = 10, claim: str = "claim_id") -> DataFrame:
    """Negative and limiting claims of some papers, most confident first (an answer of ``limit`` rows)."""
    own = claims.join(papers.select(key).distinct(), key, "left_semi").where(is_negative())
    return own.orderBy(F.desc_nulls_last("confidence"), claim).limit(limit)


def claims_for(claims: DataFrame, papers: DataFrame, key: str, limit: int = 200, claim: str = "claim_id") -> DataFrame:
    own = claims.join(papers.select(key).distinct(), key, "left_semi")
    return own.orderBy(F.desc_nulls_last("confidence"), claim).limit(limit)


def followups(papers: DataFrame, shown: DataFrame, key: str, newest: str, most: int = 5) -> DataFrame:
    """The newest active papers that a pack doesn't show."""
    return papers.join(shown.select(key).distinct(), key, "left_anti").orderBy(F.desc_nulls_last(newest), key).limit(most)


def first_of_each(parts: list[DataFrame], key: str, excluded: DataFrame | None = None) -> DataFrame:
    """Rows of several lists, each key once, from the first list that has it, without the excluded ones."""
    every = None
    for nth, part in enumerate(parts):
        part = part.withColumn("_nth", F.lit(nth))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    names = [c for c in every.columns if c != "_nth"]
    best = every.groupBy(key).agg(F.min_by(F.struct(*names), F.struct("_nth", F.xxhash64(*[F.to_json(F.struct(*names))]))).alias("r")).select("r.*")
    return best.join(excluded.select(key), key, "left_anti") if excluded is not None else best


def dangling(references: DataFrame, known: DataFrame, reference: str, key: str) -> DataFrame:
    """References to ids that don't exist."""
    return references.where(F.col(reference).isNotNull()).join(known.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")
