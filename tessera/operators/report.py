"""What people read: citations, formatted evidence, Markdown pages, work orders and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PAYLOAD = 400_000
PASSAGE = 160


def citation(paper: Column, page_label: Column, page_index: Column, section: Column, line: Column | None = None) -> Column:
    """[paper, p. 3, Methods > Data]: the page by its printed label, else by its number, then the section, then the line."""
    page = F.when(page_label.isNotNull(), F.concat(F.lit("p. "), page_label)).when(page_index.isNotNull(), F.concat(F.lit("page "), (page_index + 1).cast("string")))
    where = F.when(F.size(section) > 0, F.array_join(section, " > "))
    parts = [paper, page, where, *([F.concat(F.lit("line "), line.cast("string"))] if line is not None else [])]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def passage(text: Column, start: Column, end: Column, around: int = PASSAGE) -> Column:
    """A quote with ``around`` characters to either side, cut ends marked."""
    a = F.greatest(F.lit(0), start - around)
    z = F.least(F.length(text), end + around)
    return F.concat(F.when(a > 0, F.lit("…")).otherwise(F.lit("")), F.substring(text, a + 1, z - a), F.when(z < F.length(text), F.lit("…")).otherwise(F.lit("")))


def claim_block(rows: DataFrame) -> DataFrame:
    """claims (claim_id, statement, claim_type, polarity, confidence, conditions, cite) with ``text``, a Markdown item."""
    detail = F.concat_ws("; ", F.col("claim_type"), F.col("polarity"), F.when(F.col("confidence").isNotNull(), F.format_string("confidence %.2f", "confidence")), F.when(F.size("conditions") > 0, F.concat(F.lit("when "), F.array_join("conditions", ", "))))
    return rows.withColumn("text", F.concat(F.lit("- **"), F.col("claim_id"), F.lit("** "), F.col("statement"), F.lit(" ("), detail, F.lit(") "), F.coalesce("cite", F.lit(""))))


def unit_block(rows: DataFrame) -> DataFrame:
    """units (cite, text) with ``text`` as a quote block under its citation."""
    return rows.withColumn("text", F.concat(F.col("cite"), F.lit("\n> "), F.regexp_replace("text", "\n", "\n> ")))


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """One row: a Markdown table of a bounded answer."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", "\\\\|"), F.lit("")) for c in columns]), F.lit(" |"))
    placed = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), cells.alias("line"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n")
    return placed.agg(F.concat(F.lit(head + "\n"), body).alias("text"))


def paper_pages(papers: DataFrame, claims: DataFrame) -> DataFrame:
    """(paper_id, text): a page for each paper with its claims, most confident first; pages are built on the cluster."""
    lines = claims.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("o"), "claim_id", "statement"))).alias("c"))
    rows = papers.join(lines, "paper_id", "left")
    listed = F.array_join(F.transform(F.coalesce("c", F.array().cast("array<struct<o:double,claim_id:string,statement:string>>")), lambda c: F.concat(F.lit("- **"), c["claim_id"], F.lit("** "), c["statement"])), "\n")
    head = F.concat(F.lit("# "), F.coalesce("title", "paper_id"), F.lit("\n\n"), F.concat_ws(", ", F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", "), F.col("year").cast("string"), "venue"))
    return rows.select("paper_id", F.concat(head, F.when(F.size("c") > 0, F.concat(F.lit("\n\n## Claims\n\n"), listed)).otherwise(F.lit("\n\nNo claims yet."))).alias("text"))


def claim_display(claim: DataFrame, texts: DataFrame, relations: DataFrame, source="source_claim_id", target="target_claim_id") -> DataFrame:
    """claim (claim_id, paper_id, statement, support array<struct<char_start, char_end>>) with passages and related edges."""
    parts = claim.select("claim_id", "paper_id", "statement", F.explode_outer("support").alias("s")).join(texts.select("paper_id", "text"), "paper_id", "left")
    quoted = parts.groupBy("claim_id", "statement").agg(F.collect_list(passage(F.col("text"), F.col("s.char_start"), F.col("s.char_end"))).alias("passages"))
    ends = relations.select(F.explode(F.array_distinct(F.array(source, target))).alias("claim_id"), F.struct("relation", source, target).alias("edge"))
    edges = ends.join(claim.select("claim_id"), "claim_id", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    return quoted.join(edges, "claim_id", "left")


def work_orders(papers: DataFrame, units: DataFrame, stage: str, prompt: str, prompt_version: str, most: int = MOST_PAYLOAD) -> DataFrame:
    """(order_id, stage, paper_id, prompt_version, payload, truncated): the texts of a paper's units for an external model.

    Units count up to the first that would go over ``most`` characters; that one and all behind it stay out.
    """
    total = F.sum(F.length("text") + 2).over(Window.partitionBy("paper_id").orderBy("unit_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = units.join(papers.select("paper_id"), "paper_id", "left_semi").withColumn("_in", total <= most)
    joined = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("unit_id", "text")))).alias("u"), (F.count_if(~F.col("_in")) > 0).alias("truncated"))
    payload = F.to_json(F.struct(F.lit(prompt).alias("prompt"), F.col("paper_id"), F.col("u").alias("units")))
    return joined.select(F.concat_ws("--", F.lit(stage), "paper_id").alias("order_id"), F.lit(stage).alias("stage"), "paper_id", F.lit(prompt_version).alias("prompt_version"), payload.alias("payload"), "truncated")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def per_paper(papers: DataFrame, units: DataFrame, claims: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, n_units, n_claims), with zeros."""
    u, c = units.groupBy(key).agg(F.count("*").alias("n_units")), claims.groupBy(key).agg(F.count("*").alias("n_claims"))
    return papers.select(key).join(u, key, "left").join(c, key, "left").na.fill(0, ["n_units", "n_claims"])


def role_histogram(blocks: DataFrame, key: str = "paper_id") -> DataFrame:
    return blocks.groupBy(key, F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))


def conversion_manifest(rows: DataFrame, path: str) -> None:
    """One sorted JSON line for each converted source, in files that hold ranges of paths."""
    rows.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").json(path)
