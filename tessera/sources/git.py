"""Working-tree status lines as rows, and what of a tree is worth asking about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.policy import IMAGE_SOURCE, IMAGE_VIEW, WORD, extension

MOST_IGNORED = 500
SNIFFED = 8192


def status_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, old_path, git_status) of porcelain status lines (XY path, or XY old -> new)."""
    line = F.col(column)
    path = F.substring(line, 4, F.length(line))
    moved = F.trim(F.substring(line, 1, 2)).rlike("[RC]") & F.contains(path, F.lit(" -> "))
    clean = lambda c: F.regexp_replace(c, '^"|"$', "")
    new = F.when(moved, F.substring_index(path, " -> ", -1)).otherwise(path)
    old = F.when(moved, F.substring_index(path, " -> ", 1))
    return lines.where(F.length(line) > 3).select(clean(new).alias("path"), clean(old).alias("old_path"), F.trim(F.substring(line, 1, 2)).alias("git_status"))


def ignored_convertibles(ignored: DataFrame, most: int = MOST_IGNORED) -> tuple[DataFrame, DataFrame]:
    """The first ignored files that could be converted (a listing of ``most``), and how many there are of each extension."""
    rows = ignored.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin([*IMAGE_SOURCE, *IMAGE_VIEW, *WORD, "pdf"]))
    return rows.orderBy("path").limit(most), rows.groupBy("ext").agg(F.count("*").alias("n"))


def looks_binary(content: Column) -> Column:
    """Whether there is a zero byte in the first 8 KiB."""
    return F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\x00"))
