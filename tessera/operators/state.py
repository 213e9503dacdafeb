"""Incremental updates: what changed between two scans, fingerprints of stages, tombstones, overrides, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint

PAPER_STAGES = ("parse", "units", "metadata", "profile", "claims")
CORPUS_STAGES = ("tuning", "families", "relations", "topics", "overview", "index")
MODEL_STAGES = ("profile", "claims", "relations", "topics", "overview")


def first_of_duplicates(scan: DataFrame, path: str = "path", content: str = "content_sha256") -> DataFrame:
    """One row for each content: its first path, and the other paths with equal content."""
    # Grouping, not a window: a content that is everywhere is reduced before it is shuffled.
    paths = scan.groupBy(content).agg(F.min(path).alias(path), F.sort_array(F.collect_set(path)).alias("every"))
    return paths.select(content, path, F.array_remove("every", F.col(path)).alias("duplicates"))


def changes(scan: DataFrame, manifest: DataFrame, path: str = "path", content: str = "content_sha256") -> DataFrame:
    """(path, content, old_path, change): unchanged, renamed, modified, added or removed; content decides before path."""
    old = manifest.groupBy(content).agg(F.min(path).alias("old_path"))
    by_path = manifest.groupBy(path).agg(F.min(content).alias("old_content"))
    same_place = manifest.select(path, content, F.lit(True).alias("in_place")).distinct()
    now = scan.select(path, content).join(same_place, [path, content], "left").join(old, content, "left").join(by_path, path, "left")
    kind = F.when(F.col("in_place"), "unchanged").when(F.col("old_path").isNotNull(), "renamed").when(F.col("old_content").isNotNull(), "modified").otherwise("added")
    old_path = F.when(F.col("in_place"), F.col(path)).when(kind == "renamed", F.col("old_path")).when(kind == "modified", F.col(path))
    now = now.select(path, content, old_path.alias("old_path"), kind.alias("change"))
    seen = now.where("old_path is not null").select(F.col("old_path").alias(path)).distinct()
    gone = manifest.select(path, content).join(seen, path, "left_anti")
    return now.union(gone.select(path, content, F.col(path).alias("old_path"), F.lit("removed")))


def stage_fingerprints(rows: DataFrame, key: str, content: str, versions: dict[str, Column]) -> DataFrame:
    """(key, stage, fingerprint): each stage hashes its own settings with the fingerprints it builds on, so a change of one
    makes all behind it stale."""
    parse = fingerprint(F.lit("parse"), F.col(content), versions["parse"])
    units = fingerprint(F.lit("units"), parse, versions["units"])
    metadata = fingerprint(F.lit("metadata"), parse, versions["metadata"])
    profile = fingerprint(F.lit("profile"), units, metadata, versions["profile"])
    claims = fingerprint(F.lit("claims"), profile, versions["claims"])
    made = F.array(*[F.struct(F.lit(n).alias("stage"), f.alias("fingerprint")) for n, f in zip(PAPER_STAGES, (parse, units, metadata, profile, claims), strict=True)])
    return rows.select(key, F.explode(made).alias("s")).select(key, "s.stage", "s.fingerprint")


def corpus_fingerprint(stages: DataFrame, stage: str, key: str) -> DataFrame:
    """One row: the hash of a stage's fingerprints in the order of their keys, by ranges so that the list stays short.

    The order-free form sums 128 bits of each (key, fingerprint) hash; equal sets have equal sums.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), "fingerprint").cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)"))
    return stages.where(F.col("stage") == stage).agg(F.count("*").alias("n"), part(1).alias("h1"), part(13).alias("h2")).select(fingerprint(F.lit(stage), F.col("n"), F.col("h1"), F.col("h2")).alias("fingerprint"))


def staleness(expected: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(key, stage, state): missing, stale or current."""
    rows = expected.join(recorded.select(key, "stage", F.col("fingerprint").alias("old")), [key, "stage"], "left")
    state = F.when(F.col("old").isNull(), "missing").when(F.col("old") == F.col("fingerprint"), "current").otherwise("stale")
    return rows.select(key, "stage", state.alias("state"))


def tombstones(manifest: DataFrame, present: DataFrame, key: str, reason: str) -> DataFrame:
    """Manifest rows with a status: active ones that aren't present any more are tombstoned, with a reason."""
    here = present.select(key, F.lit(True).alias("_here")).distinct()
    rows = manifest.join(here, key, "left")
    gone = (F.col("status") == "active") & F.col("_here").isNull()
    return rows.withColumn("tombstone_reason", F.when(gone, reason)).withColumn("status", F.when(gone, "tombstoned").otherwise(F.col("status"))).drop("_here")


def retire(relations: DataFrame, active: DataFrame, source: str, target: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, retired) relations: an end that is named must be active."""
    ids = active.select(key, F.lit(True).alias("_on")).distinct()
    rows = relations.join(ids.toDF(source, "_s"), source, "left").join(ids.toDF(target, "_t"), target, "left")
    lost = (F.col(source).isNotNull() & F.col("_s").isNull()) | (F.col(target).isNotNull() & F.col("_t").isNull())
    names = relations.columns
    return rows.where(~lost).select(*names), rows.where(lost).select(*names)


def apply_overrides(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with patched columns; rows whose patch has ``delete`` go."""
    named = patches.select(key, F.coalesce("delete", F.lit(False)).alias("_delete"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(named, key, "left").where(~F.coalesce("_delete", F.lit(False)))
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*rows.columns)


def unapplied(patches: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return patches.select(key).distinct().join(rows.select(key), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old rows with the new ones, the last new one of a key in place of what was there."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return rows.join(last.select(key), key, "left_anti").unionByName(last.drop(order) if order not in rows.columns else last, allowMissingColumns=True)


def duplicate_statements(claims: DataFrame, group: list[str], norm: str, order: list[str], key: str) -> DataFrame:
    """Claims with ``duplicate_of``: the first of the group with the same normal form, null for that one itself."""
    w = Window.partitionBy(*group, norm).orderBy(*order)
    first = F.first(key).over(w)
    return claims.withColumn("duplicate_of", F.when(first != F.col(key), first))


def distinct_ids(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Ids that several contents would share get four digits of the content behind them."""
    shared = rows.groupBy(key).agg(F.count_distinct(content).alias("_n"))
    new = F.when(F.col("_n") > 1, F.concat(F.col(key), F.lit("-"), F.substring(content, 1, 4))).otherwise(F.col(key))
    return rows.join(shared, key).withColumn(key, new).drop("_n")
