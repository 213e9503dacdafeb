"""Incremental updates as a stream: each micro-batch of scanned files is compared with the manifest and merged into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import changes
from ..sources.tables import replace

MANIFEST = "path string, content_sha256 string, status string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def merge(batch: DataFrame, path: str) -> DataFrame:
    """Merge one batch of (path, content_sha256) into the manifest, and return its changes. Running a batch twice is safe."""
    spark = batch.sparkSession
    old = manifest(spark, path)
    scanned = batch.groupBy("path").agg(F.max("content_sha256").alias("content_sha256"))
    # The changes are written first: they read the manifest that is replaced next.
    replace(changes(scanned, old.where("status = 'active'")).where("change <> 'removed'"), f"{path}-changes")
    found = spark.read.parquet(f"{path}-changes")
    moved = found.where("old_path is not null").select(F.col("old_path").alias("path")).union(found.select("path")).distinct()
    kept = old.join(moved, "path", "left_anti").unionByName(found.select("path", "content_sha256", F.lit("active").alias("status")))
    replace(kept, path)
    return found


def run(files: DataFrame, manifest_path: str, checkpoint: str, changes_path: str | None = None):
    """Start the stream over ``files`` (a streaming DataFrame of path, content_sha256); stops when all there is is merged."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        found = merge(batch, manifest_path)
        if changes_path:
            found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changes_path}/batch={number}")
        batch.unpersist()

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
