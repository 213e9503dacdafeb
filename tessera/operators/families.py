"""Document families: supplements and their papers, preprints and their versions, possible duplicates."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SIMILAR, SUPPLEMENT_FLOOR = 0.82, 0.18
#: Hash ranges in which values are numbered; keys of a class that meet others at a time.
RANGES, BLOCK = 4096, 512


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows and ``number``, which is below 2^32: the place of a distinct value in its hash range, so no task sees all values,
    and whatever part of the plan is run again gives the same numbers. Good for 2^20 values in each of 4096 ranges."""
    return rows.withColumn("range", F.pmod(F.xxhash64(by), F.lit(RANGES))).withColumn("number", F.col("range") * (1 << 20) + F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1).drop("range")


def similar_pairs(rows: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with a token Jaccard of at least ``threshold``, exactly.

    Equal token sets are compared once, as a class. Prefix filter: tokens in order of rarity; a pair that is similar enough
    shares a token among the first n - ceil(threshold * n) + 1 of either side, so only those are joined, by token, and the
    first token in common reports the pair. What is left behind it must be able to reach the threshold. Tokens are numbers
    here. The pairs of members are the product of blocks of at most some ``BLOCK`` keys, expanded behind the last exchange:
    what is shuffled of a class grows with its members, and with the pairs only by a row for ``BLOCK`` squared of them.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(F.array(tokens)).alias("s"))  # a filter isn't pushed below, so tokens are made once
    sets = sets.where(F.col("s").isNotNull() & (F.size("s") > 0)).select("k", F.sort_array(F.array_distinct("s")).alias("s"))
    classes = sets.groupBy("s").agg(F.count("*").alias("members"))
    # Outer, though no set is empty: for explode() Spark adds filters, and then the classes are made and exchanged anew for each use.
    frequency = classes.select(F.explode_outer("s").alias("t"), "members").groupBy("t").agg(F.sum("members").alias("df"))
    rank = _numbered(frequency, "t").select("t", (F.col("df") * (1 << 32) + F.col("number")).alias("rank"))
    classes = _numbered(classes, "s").withColumnRenamed("number", "c")
    blocks_of = F.ceil(F.col("members") / BLOCK).cast("int")

    n = F.size("ids")
    ordered = classes.select("c", blocks_of.alias("blocks"), F.explode_outer("s").alias("t")).join(rank, "t").groupBy("c", "blocks").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    ordered = ordered.select("c", "blocks", F.transform("ranks", lambda r: (F.pmod(r, F.lit(1 << 32)) - (1 << 31)).cast("int")).alias("ids"))
    first = ordered.select("c", "blocks", "ids", F.posexplode(F.slice("ids", 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("at", "id"))
    a, b = first.alias("a"), first.alias("b")
    m, n = F.size("a.ids"), F.size("b.ids")
    near = (F.col("a.id") == F.col("b.id")) & (F.col("a.c") < F.col("b.c")) & (n >= m * threshold - 1e-9) & (m >= n * threshold - 1e-9)
    near &= F.least(m - F.col("a.at"), n - F.col("b.at")) >= (m + n) * (threshold / (1 + threshold)) - 1e-6
    shared = a.join(b, near).select(F.col("a.c").alias("x"), F.col("a.blocks").alias("bx"), F.col("b.c").alias("y"), F.col("b.blocks").alias("by"), "a.id", (m + n).alias("both"), F.explode(F.array(F.array_intersect("a.ids", "b.ids"))).alias("i"))
    shared = shared.where(F.col("i")[0] == F.col("id")).withColumn("similarity", F.size("i") / (F.col("both") - F.size("i"))).where(F.col("similarity") >= threshold)
    pairs = shared.select("x", "bx", "y", "by", "similarity")
    inside = classes.where("members > 1").select(F.col("c").alias("x"), blocks_of.alias("bx"), F.col("c").alias("y"), blocks_of.alias("by"), F.lit(1.0).alias("similarity"))

    every = pairs.union(inside).select("x", "y", "similarity", "by", F.explode(F.sequence(F.lit(0), F.col("bx") - 1)).alias("i"))
    every = every.select("x", "i", "y", F.explode(F.sequence(F.when(F.col("x") == F.col("y"), F.col("i")).otherwise(F.lit(0)), F.col("by") - 1)).alias("j"), "similarity")
    blocks = sets.join(classes, "s").select("c", F.pmod(F.xxhash64("k"), blocks_of).cast("int").alias("block"), "k").groupBy("c", "block").agg(F.collect_list("k").alias("keys"))
    left, right = blocks.toDF("x", "i", "left"), blocks.toDF("y", "j", "right")
    # By number: Spark would put what is few bytes, but many pairs, into few tasks.
    met = every.join(left, ["x", "i"]).repartition(tasks, "y", "j").join(right.repartition(tasks, "y", "j"), ["y", "j"])
    met = met.select("similarity", ((F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))).alias("same"), F.explode("left").alias("k1"), "right")
    met = met.select("similarity", "same", "k1", F.explode("right").alias("k2")).where((F.col("k1") < F.col("k2")) | (~F.col("same") & (F.col("k1") > F.col("k2"))))
    return met.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "similarity")


def best_match(rows: DataFrame, candidates: DataFrame, key: str, candidate: str, floor: float = SUPPLEMENT_FLOOR) -> DataFrame:
    """(key, candidate, score): the candidate whose tokens are most like each row's; null under the floor; ties to smaller.

    Joined by shared tokens: without one the score is 0.
    """
    own = rows.select(key, F.array_distinct("tokens").alias("s"))
    other = candidates.select(candidate, F.array_distinct("tokens").alias("c"))
    shared = own.select(key, F.size("s").alias("n"), F.explode("s").alias("t")).join(other.select(candidate, F.size("c").alias("m"), F.explode("c").alias("t")), "t")
    scored = shared.groupBy(key, candidate, "n", "m").agg(F.count("*").alias("k"))
    scored = scored.withColumn("score", F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).where(F.col("score") >= floor)
    best = scored.groupBy(key).agg(F.min_by(F.struct(candidate, "score"), F.struct(-F.col("score"), F.col(candidate))).alias("b"))
    return own.select(key).join(best, key, "left").select(key, F.col(f"b.{candidate}").alias(candidate), F.col("b.score").alias("score"))


def detect(papers: DataFrame) -> DataFrame:
    """papers (paper_id, title, source_stem, document_type, publication_status, doi) to family relations.

    Supplements go with the main paper of most overlap or stay unresolved; similar titles make a preprint and its published
    form, or possible duplicates, which are never merged.
    """
    from ..functions.udfs import ascii_fold

    rows = papers.withColumn("title_set", T.token_set(ascii_fold("title"))).withColumn("stem_set", T.token_set(ascii_fold("source_stem")))
    supplement = F.col("document_type") == "supplementary_material"
    bare = F.regexp_replace("source_stem", r"(?i)supp\w*|supporting|information|material|appendix|_s\d", " ")
    main = rows.where(~supplement)
    by_stem = best_match(rows.where(supplement).select("paper_id", T.token_set(ascii_fold(bare)).alias("tokens")), main.select(F.col("paper_id").alias("main"), F.array_union("title_set", "stem_set").alias("tokens")), "paper_id", "main", 0.0)
    by_title = best_match(rows.where(supplement).select("paper_id", F.col("title_set").alias("tokens")), main.select(F.col("paper_id").alias("main"), F.col("title_set").alias("tokens")), "paper_id", "main", 0.0)
    best = by_stem.union(by_title).groupBy("paper_id").agg(F.min_by(F.struct("main", "score"), F.struct(-F.coalesce("score", F.lit(0.0)), F.col("main"))).alias("b"))
    found = F.coalesce(F.col("b.score") >= SUPPLEMENT_FLOOR, F.lit(False))
    supplements = best.select(
        F.col("paper_id").alias("source_paper_id"), F.when(found, F.col("b.main")).alias("target_paper_id"), F.lit("supplement-of").alias("relation"),
        F.when(found, F.round(F.least(F.lit(0.9), F.col("b.score") + 0.4), 2)).otherwise(0.2).alias("confidence"), F.when(found, "filename_and_title_token_overlap").otherwise("unresolved").alias("basis"),
    )
    linked = supplements.where("target_paper_id is not null").select(F.least("source_paper_id", "target_paper_id").alias("a"), F.greatest("source_paper_id", "target_paper_id").alias("b"))
    pairs = similar_pairs(rows.select("paper_id", "title_set"), "paper_id", "title_set", SIMILAR).join(linked, ["a", "b"], "left_anti")
    info = papers.select("paper_id", "publication_status", "doi")
    pairs = pairs.join(info.toDF("a", "status_a", "doi_a"), "a").join(info.toDF("b", "status_b", "doi_b"), "b")
    pre_a = (F.col("status_a") == "preprint") & (F.col("status_b") == "published")
    pre_b = (F.col("status_b") == "preprint") & (F.col("status_a") == "published")
    version, same = F.coalesce(pre_a | pre_b, F.lit(False)), F.coalesce(F.col("doi_a") == F.col("doi_b"), F.lit(False))
    pairs = pairs.select(
        F.when(F.coalesce(pre_b, F.lit(False)), F.col("b")).otherwise(F.col("a")).alias("source_paper_id"), F.when(F.coalesce(pre_b, F.lit(False)), F.col("a")).otherwise(F.col("b")).alias("target_paper_id"),
        F.when(version, "preprint-of").otherwise("possible-duplicate-of").alias("relation"),
        F.round(F.when(version, F.least(F.lit(0.85), "similarity")).otherwise(F.least(F.lit(0.9), F.col("similarity") + F.when(same, 0.1).otherwise(0.0))), 2).alias("confidence"),
        F.when(version, "title_similarity+status").otherwise("title_similarity").alias("basis"),
    )
    out = supplements.union(pairs)
    return out.withColumn("relation_id", T.relation_id(F.col("source_paper_id"), F.col("relation"), F.coalesce("target_paper_id", F.lit("UNRESOLVED")), F.lit("document_family")))


def prefix_size(n: int, threshold: float) -> int:
    return n - ceil(threshold * n - 1e-9) + 1
