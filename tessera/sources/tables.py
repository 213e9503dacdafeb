"""Tables in and out: JSON lines with a fixed schema, atomic replacement, append-only logs, the index's tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines folder; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def replace(df: DataFrame, path: str, format_: str = "parquet") -> None:
    """Write beside the old table, then swap by two renames; ``df`` may read the old. Between the renames there is no table:
    what stops there leaves the old one beside, and ``recover`` puts it back."""
    spark = df.sparkSession
    target, fs, jvm = _paths(spark, path)
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}.{k}-{uuid.uuid4().hex}") for k in ("new", "old"))
    df.write.format(format_).save(new.toString())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(new, target):
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs, _ = _paths(spark, path)
    return fs.exists(p)


def recover(spark: SparkSession, path: str) -> None:
    """Put the old table back where a replacement stopped between its renames; what it left beside goes."""
    p, fs, _ = _paths(spark, path)
    if not fs.exists(p.getParent()):
        return
    left = [s.getPath() for s in fs.listStatus(p.getParent()) if s.getPath().getName().startswith((f"{p.getName()}.old-", f"{p.getName()}.new-"))]
    for old in left:
        if ".old-" in old.getName() and not fs.exists(p):
            fs.rename(old, p)
        else:
            fs.delete(old, True)


def append_log(spark: SparkSession, path: str, action: str, detail: str) -> None:
    row = spark.range(1).select(F.lit(time.strftime("%Y-%m-%dT%H:%M:%S")).alias("at"), F.lit(action).alias("action"), F.lit(detail).alias("detail"))
    row.write.mode("append").json(path)


def write_index(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Replace each table; returns the rows of each. Postings lie sorted by term, so a term's look-up skips row groups."""
    counts = {}
    for name, df in tables.items():
        df = df.repartitionByRange("term").sortWithinPartitions("term") if "term" in df.columns else df
        replace(df, f"{root}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{root}/{name}").count()
    return counts


def begin(spark: SparkSession, root: str, stage: str) -> None:
    spark.range(1).select(F.lit(stage).alias("stage")).write.mode("overwrite").json(f"{root}/journal/{stage}")


def end(spark: SparkSession, root: str, stage: str) -> None:
    p, fs, _ = _paths(spark, f"{root}/journal/{stage}")
    fs.delete(p, True)


def unfinished(spark: SparkSession, root: str) -> list[str]:
    p, fs, _ = _paths(spark, f"{root}/journal")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove_paper(df: DataFrame, path: str, key: str, value: str) -> None:
    replace(df.where(F.col(key) != value), path)
