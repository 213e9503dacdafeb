"""Ranked retrieval: an inverted index as DataFrames, weighted BM25, filters, over-fetch, per-group caps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
OVER_FETCH = 4
WEIGHTS = {
    "units": {"text": 1.0, "heading": 2.0, "section": 1.5},
    "claims": {"statement": 1.0, "facets": 1.5, "tags": 1.2},
    "papers": {"title": 3.0, "authors": 1.0, "abstract": 1.5, "keywords": 2.0},
    "topics": {"name": 3.0, "summary": 1.0, "tags": 1.5},
}
# Words that a question's terms leave out.
QUERY_STOP = frozenset(
    [
    "the", "a", "an", "of", "for", "and", "or", "in", "on", "to", "with", "is", "are", "was", "were", "be", "do", "does", "did", "how",
    "what", "which", "why", "when", "who", "that", "this", "it", "as", "at", "by", "from", "than", "then", "there", "these", "those", "any",
    "all", "can", "could", "should", "would", "we", "i", "you", "they", "if", "not", "no", "but", "about", "into", "vs", "versus", "under",
    "over", "between", "using", "use",
]
)
MOST_SYNONYMS = 12


def terms(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


@dataclass
class Index:
    """postings (keys, field, term, positions), lengths (keys, n_terms), stats (one row: n_docs, mean_terms)."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    keys: list[str]
    weights: dict[str, float]


def build_index(rows: DataFrame, keys: list[str], weights: dict[str, float], pattern: str = TOKEN, stemmed: bool = False) -> Index:
    """Index text columns by term. With ``stemmed``, terms are folded and stemmed; each distinct term once."""
    listed = rows.select(*keys, *[terms(F.col(c), pattern).alias(c) for c in weights])
    sizes = [F.size(c) for c in weights]
    lengths = listed.select(*keys, sum(sizes[1:], sizes[0]).cast("long").alias("n_terms"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("mean_terms"))
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("terms")) for c in weights]))
    flat = listed.select(*keys, fields.alias("f")).select(*keys, "f.field", F.posexplode("f.terms").alias("position", "term"))
    if stemmed:
        from ..functions.udfs import root_once

        known = flat.select("term").distinct().select("term", root_once("term").alias("root"))
        flat = flat.join(known, "term").drop("term").withColumnRenamed("root", "term")
    postings = flat.groupBy(*keys, "field", "term").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    return Index(postings, lengths, stats, keys, weights)


def compile_question(text: str) -> list[str]:
    """Phrases of a question: quoted ones as they are, else words without outer punctuation, short and stop words."""
    out = []
    for quoted, word in re.findall(r'"([^"]+)"|([A-Za-z0-9][A-Za-z0-9_.\-/+]*)', text):
        bare = word.strip(".-/+_")
        if quoted:
            out.append(quoted)
        elif len(bare) >= 2 and bare.lower() not in QUERY_STOP:
            out.append(bare)
    return out


def _says(text: str, phrase: str) -> bool:
    phrase = phrase.strip().lower()
    return bool(phrase) and re.search(rf"(?:^|[^A-Za-z0-9]){re.escape(phrase)}(?:[^A-Za-z0-9]|$)", text.lower()) is not None


def expand_question(text: str, synonyms: dict[str, list[str]], acronyms: dict[str, str], terms_: list[tuple[str, str, list[str]]] = ()) -> list[str]:
    """Further phrases for a question: other names of what it mentions, first twelve, each once."""
    more: list[str] = []
    for term, names in synonyms.items():
        names = [names] if isinstance(names, str) else list(names)
        if _says(text, term):
            more += names
        elif hit := next((n for n in names if _says(text, n)), None):
            more += [term, *[n for n in names if n.lower() != hit.lower()]]
    for short, long in acronyms.items():
        more += [long] if _says(text, short) else [short] if _says(text, long) else []
    for term, canonical, names in terms_:
        every = [term, *names]
        if any(_says(text, n) for n in every):
            more += [n for n in every if n and not _says(text, n)] + ([canonical] if canonical else [])
    once = {}
    for name in more:
        if len(name) > 1:
            once.setdefault(name.lower(), name)
    return list(once.values())[:MOST_SYNONYMS]


def phrase_hits(index: Index, phrases: list[str], pattern: str = TOKEN, stemmed: bool = False) -> DataFrame:
    """(phrase, keys, tf): weighted occurrences of each phrase; its terms stand next to one another in one field.

    The phrases are the query's own few words, a local relation of their number; only postings of these terms are read.
    """
    from ..functions.udfs import fold, porter

    java = pattern.replace(r"\p{L}\p{N}", r"^\W_")
    rows = []
    for k, phrase in enumerate(phrases):
        found = re.findall(java, phrase.lower())
        found = [porter(fold(t)) for t in found] if stemmed else found
        rows += [(k, i, t, len(found)) for i, t in enumerate(found)]
    spark = index.postings.sparkSession
    asked = spark.createDataFrame(rows, "phrase int, nth int, term string, size int")
    weight = F.coalesce(*[F.when(F.col("field") == c, F.lit(w)) for c, w in index.weights.items()])
    own = index.postings.where(F.col("term").isin(sorted({r[2] for r in rows})))
    if all(r[3] == 1 for r in rows):
        hit = own.join(F.broadcast(asked), "term").select("phrase", *index.keys, (weight * F.size("positions")).alias("w"))
        return hit.groupBy("phrase", *index.keys).agg(F.sum("w").alias("tf"))
    placed = own.join(F.broadcast(asked), "term").select("phrase", "size", "nth", *index.keys, "field", F.explode("positions").alias("position"))
    begun = placed.groupBy("phrase", "size", *index.keys, "field", (F.col("position") - F.col("nth")).alias("start")).agg(F.count_distinct("nth").alias("n"))
    return begun.where("n = size").groupBy("phrase", *index.keys).agg(F.sum(weight).alias("tf"))


def weighed(index: Index, frequency: DataFrame) -> DataFrame:
    """(phrase, idf, mean_terms), a row for each of a question's phrases; the corpus's two numbers come by scalar subqueries."""
    n_docs, mean = index.stats.select("n_docs").scalar(), index.stats.select("mean_terms").scalar()
    raw = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return frequency.select("phrase", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"), mean.alias("mean_terms"))


def bm25(index: Index, phrases: list[str], pattern: str = TOKEN, stemmed: bool = False) -> DataFrame:
    """(keys, score): smaller is better. Repeated phrases count again; documents of any status count in the statistics."""
    hits = phrase_hits(index, phrases, pattern, stemmed)
    frequency = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(weighed(index, frequency)), "phrase").join(index.lengths, index.keys)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / F.col("mean_terms")))
    return scored.groupBy(*index.keys).agg((-F.sum(part)).alias("score"))


@dataclass
class Filters:
    """Structural filters of ranked rows; an empty one lets everything pass. Text filters match any substring."""

    papers: list = field(default_factory=list)
    exclude_papers: list = field(default_factory=list)
    years: list = field(default_factory=list)
    doc_types: list = field(default_factory=list)
    authors: list = field(default_factory=list)
    methods: list = field(default_factory=list)
    datasets: list = field(default_factory=list)
    concepts: list = field(default_factory=list)
    claim_types: list = field(default_factory=list)
    min_confidence: float | None = None
    primary_only: bool = False

    def __bool__(self) -> bool:
        return any(v not in ([], None, False) for v in vars(self).values())

    @staticmethod
    def _any(column: str, values: list[str]) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(v.lower()))
        return out

    def paper(self, key: str = "paper_id") -> Column:
        keep = F.lit(True)
        if self.papers:
            keep &= F.col(key).isin(self.papers)
        if self.exclude_papers:
            keep &= ~F.col(key).isin(self.exclude_papers)
        if self.years:
            keep &= F.coalesce(F.col("year").isin(self.years), F.lit(False))
        if self.doc_types:
            keep &= F.lower(F.coalesce(F.col("document_type"), F.lit(""))).isin([t.lower() for t in self.doc_types])
        if self.authors:
            keep &= self._any("authors", self.authors)
        return keep

    def claim(self, key: str = "paper_id") -> Column:
        keep = F.lit(True)
        if self.papers:
            keep &= F.col(key).isin(self.papers)
        if self.exclude_papers:
            keep &= ~F.col(key).isin(self.exclude_papers)
        if self.min_confidence is not None:
            keep &= F.coalesce(F.col("confidence"), F.lit(0.0)) >= self.min_confidence
        if self.claim_types:
            keep &= F.lower(F.coalesce(F.col("claim_type"), F.lit(""))).isin([t.lower() for t in self.claim_types])
        if self.primary_only:
            keep &= F.coalesce(F.col("is_primary_evidence"), F.lit(False))
        for values, column in ((self.methods, "methods"), (self.datasets, "datasets"), (self.concepts, "concepts")):
            if values:
                keep &= self._any(column, values)
        return keep

    def describe(self) -> str:
        return ", ".join(f"{k}={sorted(v) if isinstance(v, list) else v}" for k, v in vars(self).items() if v not in ([], None, False)) or "none"


def ranked(scores: DataFrame, payload: DataFrame, keys: list[str], limit: int, keep: Column | None = None, exact: bool = False, active: Column | None = None) -> DataFrame:
    """The best ``limit`` rows. Filters apply behind the best ``4 * limit``, or with ``exact`` before any limit.

    Ties go to smaller keys. The limits are the feature: a ranked answer.
    """
    rows = scores.join(payload, keys)
    rows = rows.where(active) if active is not None else rows
    order = [F.col("score"), *[F.col(k) for k in keys]]
    if keep is None:
        return rows.orderBy(*order).limit(limit)
    if exact:
        return rows.where(keep).orderBy(*order).limit(limit)
    return rows.orderBy(*order).limit(OVER_FETCH * limit).where(keep).orderBy(*order).limit(limit)


def capped(rows: DataFrame, group: str, most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` rows of a group, the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def contribution(sources: list[tuple[float, DataFrame]], key: str, order: list[Column]) -> DataFrame:
    """(key, contribution, first_place): weighted hits over ranked sources, and the place in the first source with a hit."""
    parts = None
    for nth, (weight, rows) in enumerate(sources):
        place = F.row_number().over(Window.orderBy(*order)) - 1  # over ranked answers, of a query's limit of rows
        part = rows.select(key, F.lit(weight).alias("w"), F.struct(F.lit(nth), place.alias("place")).alias("at"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy(key).agg(F.sum("w").alias("contribution"), F.min("at")["place"].cast("long").alias("first_place"))


def resolve(papers: DataFrame, needle: str, key: str, title: str, doi: str | None = None) -> DataFrame:
    """Ids for an id, an id's beginning, a DOI, or a part of a title; an exact id alone, if there is one."""
    low = needle.strip().lower()
    loose = F.startswith(F.lower(F.col(key).cast("string")), F.lit(low)) | F.contains(F.lower(F.col(title)), F.lit(low))
    loose = loose | (F.lower(F.col(doi)) == low) if doi else loose
    exact = F.col(key).cast("string") == needle
    rows = papers.where(exact | loose).select(key, exact.alias("exact"))
    any_exact = rows.agg(F.max("exact").alias("any_exact")).scalar()
    return rows.where(F.col("exact") | ~any_exact).select(key)
