"""Checks of rows against schemas and of quotes against texts: every check makes rows (kind, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Closed vocabularies.
CLAIM_TYPES = (
    "empirical_result performance_comparison mechanism method_property dataset_property theoretical_result negative_result limitation recommendation "
    "background_or_cited hypothesis interpretation future_work"
).split()
POLARITIES = ["affirmative", "negative", "null_result", "mixed"]
RELATIONS = (
    "supports contradicts partially-contradicts qualifies extends reproduces fails-to-reproduce applies improves-on compares-with uses-method-from "
    "uses-data-from shares-dataset addresses-same-question studies-different-context cites supplement-of preprint-of possible-duplicate-of"
).split()
FAIL_ON = ["broken_locator", "missing_locator", "excerpt_mismatch", "schema_error", "dangling_reference"]
MOST_DRIFT = 5
#: Quotes of a paper that are looked up in its text together, parts to which they are dealt before, and characters of a block of units.
TOGETHER, PARTS, BLOCK = 512, 16, 1024


def errors(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that fail (or are null), in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def column_checks(schema: dict[str, dict]) -> list[tuple[str, Column]]:
    """Expressions for a flat JSON-schema-like description: required, enum, minimum, maximum, minLength, pattern, minItems, uniqueItems."""
    known = {"required", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern", "minItems", "uniqueItems"}
    out = []
    for name, rules in schema.items():
        if more := set(rules) - known:
            raise ValueError(f"{name}: keywords that aren't known: {sorted(more)}")
        c = F.col(name)
        tests = {
            "enum": lambda v, c=c: c.isin(v), "minimum": lambda v, c=c: c >= v, "maximum": lambda v, c=c: c <= v, "minLength": lambda v, c=c: F.length(c) >= v,
            "maxLength": lambda v, c=c: F.length(c) <= v, "pattern": lambda v, c=c: c.rlike(v), "minItems": lambda v, c=c: F.size(c) >= v,
            "uniqueItems": lambda v, c=c: (F.size(F.array_distinct(c)) == F.size(c)) if v else F.lit(True),
        }
        for rule, value in rules.items():
            if rule == "required":
                out += [(f"{name}:required", c.isNotNull())] if value else []
            else:
                out.append((f"{name}:{rule}", c.isNull() | tests[rule](value)))
    return out


def schema_errors(rows: DataFrame, schema: dict[str, dict], key: str) -> DataFrame:
    """(key, error) of each failed check."""
    return rows.select(key, F.explode(errors(column_checks(schema))).alias("error"))


def issue_counts(issues: DataFrame, fail_on: list[str] = FAIL_ON) -> DataFrame:
    severity = F.when(F.col("kind").isin(fail_on), "error").otherwise("warning")
    return issues.groupBy("kind").agg(F.count("*").alias("n")).withColumn("severity", severity)


def excerpt_present(locators: DataFrame, texts: DataFrame, key: str, excerpt: str, text: str) -> DataFrame:
    """Locators with ``found``: whether the quote is in the text it names, apart from spaces, quotes and case."""
    rows = locators.join(texts.select(key, F.col(text).alias("_text")), key, "left")
    found = F.contains(T.for_match(F.col("_text")), T.for_match(F.col(excerpt)))
    return rows.withColumn("found", F.coalesce(found, F.lit(False))).drop("_text")


def containing(excerpts: DataFrame, texts: DataFrame, item: str, excerpt: str, key: str, text: str, gram: int = 4) -> DataFrame:
    """(item, key, start): every text that contains a quote literally, and the first place where (code points, from 0).

    Not every quote meets every text. A quote's first and last words may be parts of words; the ``gram`` words behind the
    first are whole words of any text with the quote, so texts are looked up by their runs of ``gram`` words, and what is
    found is compared literally. Only quotes with fewer words meet all texts.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    asked = excerpts.where(F.col(excerpt).isNotNull()).select(item, F.col(excerpt).alias("_e"), words(F.col(excerpt)).alias("_w"))
    long, short = asked.where(F.size("_w") >= gram + 2), asked.where(F.size("_w") < gram + 2)
    long = long.select(item, "_e", F.array_join(F.slice("_w", 2, gram), " ").alias("_gram"))
    own = texts.select(key, F.col(text).alias("_t"))
    listed = own.withColumn("_w", words(F.col("_t"))).where(F.size("_w") >= gram)
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (gram - 1)), lambda i: F.array_join(F.slice("_w", i, gram), " "))
    found = listed.select(key, F.explode(F.array_distinct(runs)).alias("_gram")).join(long, "_gram").select(key, item, "_e")
    hits = found.join(own, key).where(F.contains("_t", F.col("_e")))
    few = own.join(short, F.contains(F.col("_t"), F.col("_e")))
    pick = [F.col(item), F.col(key), (F.instr("_t", F.col("_e")) - 1).cast("long").alias("start")]
    return hits.select(*pick).union(few.select(*pick)).distinct()


def at_offset(points: DataFrame, units: DataFrame, key: str, offset: str) -> DataFrame:
    """Points with the unit whose [char_start, char_end) holds their offset."""
    u = units.select(F.col(key).alias("_k"), "ordinal", "char_start", "char_end")
    hit = (F.col(key) == F.col("_k")) & (F.col(offset) >= F.col("char_start")) & (F.col(offset) < F.col("char_end"))
    return points.join(u, hit, "left").drop("_k", "char_start", "char_end")


def locator_issues(locators: DataFrame, units: DataFrame) -> DataFrame:
    """locators (locator_id, paper_id, unit_id, char_start, char_end, excerpt) to issues, by what their unit says."""
    u = units.select("paper_id", "unit_id", F.col("char_start").alias("_a"), F.col("char_end").alias("_z"), F.col("text").alias("_t"))
    rows = locators.join(u, ["paper_id", "unit_id"], "left")
    place = F.instr(T.for_match(F.col("_t")), T.for_match(F.col("excerpt")))
    checks = [
        ("broken_locator", F.col("_t").isNotNull()), ("excerpt_mismatch", F.col("_t").isNull() | (place > 0)),
        ("offset_outside_unit", F.col("_t").isNull() | F.col("char_start").isNull() | ((F.col("char_start") >= F.col("_a")) & (F.col("char_end") <= F.col("_z")))),
        ("offset_drift", F.col("_t").isNull() | F.col("char_start").isNull() | (place <= 0) | (F.abs(F.col("char_start") - F.col("_a") - (F.instr("_t", F.col("excerpt")) - 1)) <= MOST_DRIFT) | (F.instr("_t", F.col("excerpt")) == 0)),
    ]
    return rows.select(F.explode(errors(checks)).alias("kind"), F.col("locator_id").cast("string").alias("id"), F.col("paper_id").cast("string").alias("detail"))


def resolve_locators(locators: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    """Locators completed from where their quote is: the named unit, else the whole text; confidence and warnings.

    A text meets only the quotes that aren't in their unit, and is folded once for each ``TOGETHER`` of these. Such a quote's
    unit is the first that holds its start; units are listed by blocks of a text, so no quote meets all units of its text.
    """
    from ..functions.udfs import find_excerpt, find_excerpts

    u = units.select("paper_id", "unit_id", F.col("text").alias("_unit"), F.col("char_start").alias("_a"))
    rows = locators.join(u, ["paper_id", "unit_id"], "left").withColumn("_own", find_excerpt("_unit", "excerpt"))
    kept = [c for c in locators.columns if c not in ("paper_id", "char_start", "char_end")]
    own = [(F.col("_own")[x] + F.col("_a")).alias(x) for x in ("start", "end")]
    rows = rows.select("paper_id", F.struct(*kept).alias("_row"), F.struct(*own).alias("_own")).withColumn("_asks", F.col("_own.start").isNull() & F.col("_row.excerpt").isNotNull())
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_row.unit_id", "_row.excerpt"), F.lit(PARTS)))
    nth = F.row_number().over(Window.partitionBy("paper_id", "_asks", "_part").orderBy("_row.unit_id", "_row.excerpt"))
    groups = rows.withColumn("_nth", F.floor((nth - 1) / TOGETHER)).groupBy("paper_id", "_asks", "_part", "_nth").agg(F.collect_list(F.struct("_row", "_own")).alias("_rows"))
    groups = groups.join(texts.select("paper_id", F.lit(True).alias("_asks"), F.col("text").alias("_text")), ["paper_id", "_asks"], "left")
    asked = F.when(F.col("_asks"), F.transform("_rows", lambda r: r["_row"]["excerpt"]))
    found = groups.select("paper_id", "_rows", find_excerpts("_text", asked).alias("_any"))
    each = F.transform("_rows", lambda r, i: F.struct(r["_row"].alias("_row"), r["_own"].alias("_own"), F.get("_any", i).alias("_any")))
    rows = found.select("paper_id", F.explode(each).alias("_r")).select("paper_id", "_r._row.*", "_r._own", "_r._any")
    rows = rows.withColumns({"char_start": F.coalesce("_own.start", "_any.start").cast("int"), "char_end": F.coalesce("_own.end", "_any.end").cast("int")})
    corrected = F.col("_own.start").isNull() & F.col("char_start").isNotNull()
    blocks = F.sequence(F.floor(F.col("char_start") / BLOCK), F.floor((F.col("char_end") - 1) / BLOCK))
    held = units.where("char_start < char_end").select("paper_id", F.struct("char_start", "char_end", "unit_id").alias("_u"), F.explode(blocks).alias("_block"))
    held = held.groupBy("paper_id", "_block").agg(F.array_sort(F.collect_list("_u")).alias("_units"))
    rows = rows.withColumn("_block", F.when(corrected, F.floor(F.col("char_start") / BLOCK))).join(held, ["paper_id", "_block"], "left")
    new = F.get(F.filter("_units", lambda x: (x["char_start"] <= F.col("char_start")) & (F.col("char_start") < x["char_end"])), F.lit(0))["unit_id"]
    warning = F.array_compact(F.array(F.when(F.col("char_start").isNull(), "excerpt not found"), F.when(corrected, "unit corrected")))
    confidence = F.when(F.col("char_start").isNull(), F.least(F.coalesce("confidence", F.lit(0.3)), F.lit(0.3))).otherwise(F.coalesce("confidence", F.lit(0.8)))
    kept = [c for c in locators.columns if c not in ("unit_id", "confidence", "char_start", "char_end")]
    return rows.select(*kept, F.coalesce(new, "unit_id").alias("unit_id"), "char_start", "char_end", confidence.alias("confidence"), warning.alias("warnings"))


def link_errors(pages: DataFrame, files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target) of relative Markdown links to files that don't exist."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\[[^\]]*\]\(([^)#\s]+)[^)]*\)"), F.lit(1))
    rows = pages.select(key, F.explode(found).alias("target")).where(~F.col("target").rlike(r"^[a-z]+:"))
    return rows.join(files.select(F.col("path").alias("target")), "target", "left_anti").select(key, "target")


def claim_errors(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """Ingested claims with ``errors``; a response (paper) with any error is rejected as a whole (``accepted``)."""
    known = papers.where("status = 'active'").select("paper_id", F.lit(True).alias("_known"))
    rows = claims.join(known, "paper_id", "left")
    checks = [
        ("paper_id:unknown", F.col("_known").isNotNull()), ("statement:required", F.length(F.trim("statement")) > 0), ("claim_type:enum", F.col("claim_type").isin(CLAIM_TYPES)),
        ("support:minItems", F.size("support") >= 1), ("derivation:required", ~F.coalesce(F.col("evidence_status").isin("calculated", "inferred"), F.lit(False)) | F.col("derivation").isNotNull()),
    ]
    rows = rows.withColumn("errors", errors(checks)).drop("_known")
    bad = F.max(F.size("errors")).over(Window.partitionBy("paper_id"))
    return rows.withColumn("accepted", bad == 0)


def relation_errors(relations: DataFrame, papers: DataFrame, claims: DataFrame) -> DataFrame:
    """Relations with ``errors``: ends must exist, contradictions need explanations."""
    active = papers.where("status = 'active'").select("paper_id").distinct()
    known = claims.select("claim_id").distinct()
    rows = relations
    for end, ids, key in (("source_paper_id", active, "paper_id"), ("target_paper_id", active, "paper_id"), ("source_claim_id", known, "claim_id"), ("target_claim_id", known, "claim_id")):
        rows = rows.join(ids.select(F.col(key).alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    checks = [(f"{e}:unknown", F.col(e).isNull() | F.col(f"_{e}").isNotNull()) for e in ("source_paper_id", "target_paper_id", "source_claim_id", "target_claim_id")]
    checks.append(("difference_explanations:required", ~F.col("relation").isin("contradicts", "partially-contradicts") | (F.size(F.coalesce("difference_explanations", F.array().cast("array<string>"))) > 0)))
    return rows.select(*relations.columns, errors(checks).alias("errors"))


def union_issues(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
