"""Vocabulary of a corpus: acronyms, spelling variants, frequent word sequences, recurring headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WORD = r"[A-Za-z][A-Za-z0-9\-/']*"
LEAST_PAPERS, LEAST_COUNT, MOST_TERMS, MOST_HEADINGS = 2, 3, 30, 15
# Words that neither begin nor end a term.
STOP = [
    "the", "a", "an", "of", "for", "and", "or", "in", "on", "to", "with", "is", "are", "was", "were", "be", "been", "by", "from", "as",
    "at", "that", "this", "these", "those", "which", "we", "our", "it", "its", "their", "they", "can", "may", "not", "all", "each", "such",
    "than", "then", "also", "more", "most", "other", "using", "used", "use", "based", "into", "between", "both", "when", "while", "where",
    "how", "one", "two", "three", "however", "thus", "here", "there", "have", "has", "had", "but", "if", "only", "same", "different",
    "shown", "show", "table", "figure", "et", "al", "fig", "eq", "section", "paper", "study", "results", "result", "data",
]


def acronyms(docs: DataFrame, key: str, text: str, least_papers: int = LEAST_PAPERS) -> DataFrame:
    """(acronym, expansion, papers, n, confident): capitals in brackets whose letters begin the words before them.

    Of several expansions the one with the most documents, then occurrences, then the first by name counts.
    """
    # A text is cut before each bracketed acronym: each piece ends where the expansion should be.
    found = F.expr(r"regexp_extract_all(`{0}`, '\\(([A-Z][A-Za-z0-9\\-]{{1,9}}?)s?\\)', 1)".format(text))
    pieces = F.split(F.col(text), r"\([A-Z][A-Za-z0-9\-]{1,9}?s?\)")
    rows = docs.select(key, F.explode(F.arrays_zip(found.alias("acronym"), F.slice(pieces, 1, F.size(found)).alias("before"))).alias("x")).select(key, "x.acronym", "x.before")
    letters = F.regexp_extract_all(F.col("acronym"), F.lit("[A-Za-z]"), F.lit(0))
    n = F.size(letters)
    window = F.substring(F.col("before"), F.greatest(F.lit(1), F.length("before") - n * 12 - 19), F.length("before"))
    words = F.regexp_extract_all(window, F.lit(WORD), F.lit(0))
    rows = rows.select(key, "acronym", letters.alias("letters"), words.alias("words")).where((F.size("letters") >= 2) & (F.size("words") >= F.size("letters")))
    last = F.expr("slice(words, size(words) - size(letters) + 1, size(letters))")
    rows = rows.withColumn("last", last)
    initials = F.lower(F.array_join(F.transform("last", lambda w: F.substring(w, 1, 1)), ""))
    rows = rows.where(initials == F.lower(F.array_join("letters", ""))).withColumn("expansion", F.lower(F.array_join("last", " ")))
    rows = rows.where((F.length("expansion") >= 6) & (F.col("expansion") != F.lower("acronym")))
    counted = rows.groupBy("acronym", "expansion").agg(F.count_distinct(key).alias("papers"), F.count("*").alias("n"))
    best = counted.groupBy("acronym").agg(F.min_by(F.struct("expansion", "papers", "n"), F.struct(-F.col("papers"), -F.col("n"), F.col("expansion"))).alias("b"))
    return best.select("acronym", "b.expansion", "b.papers", "b.n", (F.col("b.papers") >= least_papers).alias("confident"))


def spelling_variants(docs: DataFrame, text: str, least: int = LEAST_COUNT) -> DataFrame:
    """(canonical, aliases, n): words that differ in hyphens, slashes and apostrophes only; the most frequent is canonical."""
    token = F.regexp_replace(F.lower(F.col("w")), r"^[-/']+|[-/']+$", "")
    rows = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("w")).select(token.alias("token"))
    rows = rows.where((F.length("token") >= 4) & ~F.col("token").isin(STOP)).groupBy("token").agg(F.count("*").alias("n"))
    rows = rows.withColumn("key", F.regexp_replace("token", r"[-/']", "")).where((F.length("key") >= 4) & F.col("key").rlike("[a-z]"))
    forms = rows.groupBy("key").agg(F.max_by("token", F.struct("n", F.translate("token", "-/'", ""), "token")).alias("canonical"), F.sort_array(F.collect_list("token")).alias("forms"), F.sum("n").alias("n"))
    forms = forms.where((F.size("forms") > 1) & (F.col("n") >= least))
    return forms.select("canonical", F.array_remove("forms", F.col("canonical")).alias("aliases"), "n")


def frequent_terms(docs: DataFrame, key: str, text: str, least_papers: int = LEAST_PAPERS, least: int = LEAST_COUNT) -> DataFrame:
    """(term, papers, n, score) of sequences of two or three words; score = papers * sqrt(n)."""
    w = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    # Each word with its next two: one row a word, and the rest is compiled code.
    rows = docs.select(key, w.alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"), F.slice("w", 3, F.size("w")).alias("c"))
    rows = rows.select(key, F.explode(zipped).alias("x")).select(key, *[F.lower(f"x.{c}").alias(c) for c in "abc"])
    long = lambda c: F.length(c) >= 3
    rows = rows.where(~F.col("a").isin(STOP) & long("a") & long("b"))
    two = F.when(~F.col("b").isin(STOP), F.concat_ws(" ", "a", "b"))
    three = F.when(long("c") & ~F.col("c").isin(STOP), F.concat_ws(" ", "a", "b", "c"))
    rows = rows.select(key, F.explode(F.array_compact(F.array(two, three))).alias("term"))
    per = rows.groupBy(key, "term").agg(F.count("*").alias("k"))
    out = per.groupBy("term").agg(F.count("*").alias("papers"), F.sum("k").alias("n"))
    out = out.where((F.col("papers") >= least_papers) & (F.col("n") >= least))
    return out.withColumn("score", F.col("papers") * F.sqrt("n"))


def leading_terms(scored: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """The best terms in order of score, without those that are a part of a better one: at most ``most``.

    A term that is kept or dropped depends on better ones only, so the driver reads the ranking's head, and more of it only
    if that isn't enough.
    """
    ranked = scored.withColumn("score", F.round("score", 2)).orderBy(F.desc("score"), "term")
    page = 50 * most
    while True:
        head, kept = ranked.limit(page).collect(), []
        for r in head:
            if len(kept) < most and not any(r.term in k[0] for k in kept):
                kept.append((r.term, r.papers, r.n, r.score))
        if len(kept) == most or len(head) < page:
            return scored.sparkSession.createDataFrame(kept, "term string, papers long, n long, score double")
        page *= 8


def recurring_headings(lines: DataFrame, key: str, known: list[str] | None = None, least_papers: int = LEAST_PAPERS, most: int = MOST_HEADINGS) -> DataFrame:
    """(heading, papers, n): short title-like lines that recur across documents and aren't known as headings.

    Of the ways a heading is written, the first by code points stands for all.
    """
    probe = F.trim(F.regexp_replace(T.squeezed(F.col("text")), r"[:.]+$", ""))
    rows = lines.where(F.length("text") <= 60).select(key, probe.alias("probe"))
    low, all_caps = F.lower("probe"), (F.upper("probe") == F.col("probe")) & F.col("probe").rlike("[A-Z]")
    # Before a colon stands the name; more than one word behind it makes it a statement.
    name, behind = F.substring_index("probe", ":", 1), F.trim(F.regexp_extract("probe", r"^[^:]*:(.*)$", 1))
    content = F.filter(F.split(name, r"[\s/]+"), lambda w: (w != "") & ~F.lower(w).isin(STOP))
    capital = F.size(F.filter(content, lambda w: w.rlike("^[A-Z]")))
    titled = (F.size(content) > 0) & (capital >= F.greatest(F.lit(1), F.bround(F.size(content) * 0.6).cast("int")))
    ok = (
        (F.length("probe") >= 4) & (F.size(F.split("probe", " ")) <= 8) & ~low.isin([*T.CANONICAL_SECTIONS, *[k.lower() for k in known or []]])
        & (F.col("probe").rlike(r"^[A-Z][^.!?]{2,58}$") | all_caps) & (all_caps | titled)
        & ~behind.rlike(r"\S\s+\S") & ~low.rlike(r"\d{4}|http|@|doi") & ~T.is_caption(F.col("probe"))
    )
    out = rows.where(ok).groupBy(low.alias("name")).agg(F.min("probe").alias("heading"), F.count_distinct(key).alias("papers"), F.count("*").alias("n"))
    return out.where(F.col("papers") >= least_papers).orderBy(F.desc("papers"), F.desc("n"), "name").limit(most).drop("name")


def entity_index(mentions: DataFrame, name: str, key: str) -> DataFrame:
    """(name, n_papers, papers): for each named entity the sorted ids that mention it; most mentioned first."""
    out = mentions.where(F.col(name).isNotNull()).groupBy(name).agg(F.sort_array(F.collect_set(key)).alias("papers"))
    return out.select(name, F.size("papers").cast("long").alias("n_papers"), "papers").orderBy(F.desc("n_papers"), name)


def concept_index(claims: DataFrame, concepts: str, paper: str, claim: str) -> DataFrame:
    """(concept, papers, claims, n_claims): for each concept in lower case the sorted ids that name it, most claims first."""
    rows = claims.select(F.explode(concepts).alias("c"), paper, claim).select(F.lower(F.trim("c")).alias("concept"), paper, claim).where("concept <> ''")
    out = rows.groupBy("concept").agg(F.sort_array(F.collect_set(paper)).alias("papers"), F.sort_array(F.collect_set(claim)).alias("claims"))
    return out.withColumn("n_claims", F.size("claims").cast("long")).orderBy(F.desc("n_claims"), "concept")


def adopted(before: DataFrame, after: DataFrame, name: str = "heading") -> DataFrame:
    """Headings that were adopted stay so: the union of both lists."""
    return before.select(name).union(after.select(name)).distinct()
