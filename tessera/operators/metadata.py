"""Title, authors, year, venue, identifiers, type and status of papers, each with where it comes from and how sure that is.

Input: one row per paper (paper_id, source_path, blocks array<struct<order, text, style_hint, role, page_index, font_size>>,
meta map<string, string>, text). All of it is expressions over the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FRONT_CHARS, TAIL_CHARS, ABSTRACT_CHARS = 12000, 6000, 2500
# What marks an affiliation, a venue, a preprint, a supplement, and what no author list says.
AFFILIATION = ["university", "department", "institute", "school", "laboratory", "labs", "college", "hospital", "center", "centre", "inc.", "gmbh", "faculty", "academy", "cnrs", "inria", "correspondence", "©", "copyright", "e-mail"]
VENUES = [
    "bioinformatics", "bmc ", "nature", "science", "cell ", "plos", "genome", "nucleic acids research", "briefings", "arxiv", "biorxiv", "medrxiv", "ieee", "acm", "elife",
    "gigascience", "peerj", "frontiers", "microbial genomics", "journal", "proceedings", "transactions", "conference", "workshop", "preprint",
]
PREPRINTS = ["arxiv", "biorxiv", "medrxiv", "preprint", "research square", "ssrn"]
SUPPLEMENT_NAMES = ["supp", "supplement", "supporting", "_si.", "-si.", "appendix", "_s1", "_s2"]
NOT_AUTHORS = ["table of contents", "supplementary", "supporting information", "abstract", "contents", "notes", "appendix", "figure", "table", "keywords", "open access", "research article", "software", "original article", "review"]
# Forms of an address and a year, and what names a kind of paper.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
YEAR = r"(19[7-9]\d|20[0-4]\d)"
KINDS = {
    "review": r"(?i)\b(?:review|survey|perspective|primer|tutorial|overview|opinion)\b",
    "benchmark_study": r"(?i)\b(?:benchmark|benchmarking|comparison|comparative (?:evaluation|assessment)|evaluation of)\b",
    "software_tool_paper": r"(?i)\b(?:software|tool|toolkit|package|pipeline|application note|implementation|library)\b",
    "dataset_paper": r"(?i)\b(?:dataset|data descriptor|data resource|corpus)\b",
}


def _found(value: Column, source: str, confidence: float) -> Column:
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.struct(value.alias("value"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def _none(kind: str = "string", value: Column | None = None, source: str = "not_found", confidence: float = 0.0) -> Column:
    return F.struct((F.lit(None).cast(kind) if value is None else value).alias("value"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))


def _says(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return out


def front_text(blocks: Column) -> Column:
    """Texts of the first two pages, without page furniture, up to the block that passes 12,000 characters."""
    own = F.filter(blocks, lambda b: (b["page_index"].isNull() | (b["page_index"] < 2)) & ~F.coalesce(b["role"].isin("header", "footer", "page_number"), F.lit(False)))
    return F.aggregate(own, F.lit(""), lambda a, b: F.when(F.length(a) > FRONT_CHARS, a).when(a == "", b["text"]).otherwise(F.concat(a, F.lit("\n"), b["text"])))


def doi(meta: Column, front: Column, text: Column) -> Column:
    def first(c: Column) -> Column:
        return T.normalize_doi(F.regexp_extract(c, T.DOI, 1))

    return F.coalesce(
        _found(T.normalize_doi(meta["citation_doi"]), "embedded_document_metadata", 0.95), _found(first(front), "printed_on_first_pages", 0.9),
        _found(first(F.substring(text, -TAIL_CHARS, TAIL_CHARS)), "printed_in_document_tail", 0.6), _none(),
    )


def title(blocks: Column, meta: Column, path: Column) -> Column:
    clean = lambda t: T.squeezed(t)
    heads = F.filter(F.slice(blocks, 1, 6), lambda b: (b["style_hint"] == "heading1") & T.plausible_title(b["text"]))
    embedded = F.coalesce(meta["citation_title"], meta["title"])
    front = F.filter(
        blocks,
        lambda b: (b["role"] == "front_matter") & (F.coalesce(b["page_index"], F.lit(0)) == 0) & T.plausible_title(clean(b["text"])) & ~b["text"].rlike(EMAIL) & ~_says(b["text"], AFFILIATION),
    )
    largest = F.array_max(F.transform(front, lambda b: F.struct(F.coalesce(b["font_size"], F.lit(0.0)).alias("size"), (-b["order"]).alias("at"), b["text"].alias("text"))))
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), "_+", " ")
    return F.coalesce(
        _found(clean(F.get(heads, 0)["text"]), "document_heading_level_1", 0.9), _found(F.when(T.plausible_title(embedded), clean(embedded)), "embedded_document_metadata", 0.85),
        F.when(largest["size"] > 0, _found(clean(largest["text"]), "first_page_largest_font_block", 0.75)), _found(clean(largest["text"]), "first_page_largest_font_block", 0.55),
        _none(value=clean(F.regexp_replace(name, r"\s*\(\d+\)\s*$", "")), source="filename", confidence=0.4),
    )


def split_authors(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?i)\d+|[*†‡§¶]|\bemail\b.*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+and\s+", ", "), r"\s*[;&]\s*", ", ")
    parts = F.transform(F.split(bare, ","), lambda p: F.regexp_replace(p, r"^[ ,.\xA0]+|[ ,.\xA0]+$", ""))
    return F.filter(parts, lambda p: F.length(p).between(2, 60) & p.rlike("[A-Za-z]{2,}"))


def _author_shaped(names: Column) -> Column:
    joined = F.array_join(names, " ")
    letters = F.length(F.regexp_replace(joined, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(joined, r"[^\p{Lu}]", ""))
    like = F.filter(names, lambda n: (F.size(F.split(n, r"\s+")) <= 5) & F.forall(F.split(n, r"\s+"), lambda w: w.rlike("^[A-ZÀ-Ý]") | (F.length(w) <= 3)))
    return (F.size(names) > 0) & ~_says(joined, NOT_AUTHORS) & (capitals <= letters * 0.7) & (F.size(like) >= F.greatest(F.lit(1), F.floor(F.size(names) / 2)))


def authors(blocks: Column, meta: Column, title_: Column) -> Column:
    given = F.coalesce(meta["citation_author"], meta["dc.creator"], meta["author"], meta["authors"])
    embedded = F.when(F.length(given) < 400, split_authors(given))
    first = F.transform(F.slice(blocks, 1, 14), lambda b: T.squeezed(b["text"]))
    same = lambda t: F.substring(T.normalize_title(t), 1, 40)
    at = F.array_position(F.transform(first, lambda t: (same(t) != "") & (same(t) == same(title_))), F.lit(True))
    behind = F.when(at > 0, F.slice(first, (at + 1).cast("int"), F.lit(14)))
    lines = F.filter(behind, lambda t: F.length(t).between(4, 400) & ~t.rlike(EMAIL) & ~_says(t, AFFILIATION) & _author_shaped(split_authors(t)))
    kind = "array<string>"
    wrap = lambda v, s, c: F.when(F.size(v) > 0, F.struct(v.alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence")))
    return F.coalesce(wrap(embedded, "embedded_document_metadata", 0.85), wrap(split_authors(F.get(lines, 0)), "first_page_author_line", 0.6), _none(kind, F.array().cast(kind)))


def year(meta: Column, front: Column) -> Column:
    this = F.year(F.current_date())
    ok = lambda y: F.when(y.between(1970, this + 1), y)
    take = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    every = F.filter(F.transform(F.regexp_extract_all(front, F.lit(r"(?<![A-Za-z0-9])" + YEAR + r"(?![A-Za-z0-9])"), F.lit(1)), lambda y: y.cast("int")), lambda y: y <= this + 1)
    modal = F.array_max(F.transform(F.array_distinct(every), lambda y: F.struct(F.size(F.filter(every, lambda z: z == y)).alias("n"), y.alias("y"))))["y"]
    return F.coalesce(
        _found(ok(take(front, r"(?i)(?:©|\(c\)|copyright)\s*" + YEAR)), "copyright_line", 0.85), _found(ok(take(front, r"(?i)(?:published|accepted|received|revised|issued)[^\n]{0,40}?" + YEAR)), "publication_line", 0.8),
        _found(ok(take(front, r"(?i)arxiv[:\s][^\n]{0,20}\b(1[0-9]|2[0-4])\d{2}\.\d{4,5}") + 2000), "arxiv_id", 0.8),
        _found(take(F.coalesce(meta["citation_publication_date"], meta["citation_date"], meta["date"]), YEAR), "embedded_document_date", 0.6), _found(modal, "most_frequent_year_on_first_pages", 0.45), _none("int"),
    )


def venue(blocks: Column, meta: Column) -> Column:
    fits = lambda t: F.length(t).between(3, 90) & _says(t, VENUES)
    banner = F.filter(F.transform(F.slice(blocks, 1, 18), lambda b: T.squeezed(b["text"])), lambda t: fits(t) & ~F.contains(t, F.lit("@")))
    running = F.filter(F.transform(F.filter(blocks, lambda b: b["role"].isin("header", "footer")), lambda b: T.squeezed(b["text"])), fits)
    bare = lambda t: F.regexp_replace(t, r"^[ .,|]+|[ .,|]+$", "")
    return F.coalesce(_found(F.trim(meta["citation_journal_title"]), "embedded_document_metadata", 0.9), _found(bare(F.get(banner, 0)), "first_page_journal_banner", 0.6), _found(bare(F.get(running, 0)), "running_header", 0.5), _none())


def keywords(blocks: Column) -> Column:
    lines = F.filter(F.transform(F.slice(blocks, 1, 40), lambda b: F.regexp_extract(F.trim(b["text"]), r"(?is)^\s*key\s?words?\s*[:\-—]\s*(.+)$", 1)), lambda t: t != "")
    parts = F.transform(F.split(T.squeezed(F.get(lines, 0)), "[;,]"), lambda p: F.regexp_replace(p, r"^[ .;]+|[ .;]+$", ""))
    return F.coalesce(F.slice(F.filter(parts, lambda p: F.length(p).between(2, 60)), 1, 15), F.array().cast("array<string>"))


def abstract(units: DataFrame) -> DataFrame:
    """(paper_id, abstract): the first unit of a section of that name, else the first long paragraph."""
    path = F.lower(F.array_join("section_path", " > "))
    rank = F.when(F.contains(path, F.lit("abstract")) | F.contains(path, F.lit("summary")), 0).when((F.col("kind") == "paragraph") & (F.col("n_chars") > 300), 1)
    rows = units.withColumn("_rank", rank).where("_rank is not null")
    return rows.groupBy("paper_id").agg(F.substring(F.min_by("text", F.struct("_rank", "unit_id")), 1, ABSTRACT_CHARS).alias("abstract"))


def document_type(title_: Column, abstract_: Column, venue_: Column, path: Column, sections: Column) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    probe = F.concat_ws(" ", text(title_), F.substring(text(abstract_), 1, 1200), text(venue_))
    names, place = F.lower(F.array_join(sections, " ")), F.lower(text(venue_))
    pick = lambda v, s, c: F.struct(F.lit(v).alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))
    hit = lambda kind: text(title_).rlike(KINDS[kind])
    return (
        F.when(_says(F.regexp_extract(path, r"[^/]*$", 0), SUPPLEMENT_NAMES), pick("supplementary_material", "filename_marker", 0.8))
        .when(hit("review") | F.contains(place, F.lit("review")), pick("review", "title_or_venue_keyword", 0.75))
        .when(hit("benchmark_study"), pick("benchmark_study", "title_keyword", 0.7))
        .when(hit("software_tool_paper") | F.contains(place, F.lit("software")) | F.contains(F.lower(probe), F.lit("application note")), pick("software_tool_paper", "title_or_venue_keyword", 0.65))
        .when(hit("dataset_paper"), pick("dataset_paper", "title_keyword", 0.6))
        .when(probe.rlike(KINDS["review"]) & ~F.contains(names, F.lit("method")), pick("review", "abstract_keyword_without_methods_section", 0.55))
        .when(F.contains(names, F.lit("method")) | F.contains(names, F.lit("results")), pick("research_article", "section_structure", 0.7))
        .otherwise(pick("unknown", "insufficient_signal", 0.3))
    )


def publication_status(venue_: Column, text: Column, doi_: Column, preprints: list[str] = PREPRINTS) -> Column:
    probe = F.lower(F.concat_ws(" ", F.coalesce(venue_, F.lit("")), F.substring(text, 1, 900)))
    marked = F.lit(False)
    for name in preprints:
        marked = marked | T.mentions(probe, name)
    pick = lambda v, s, c: F.struct(F.lit(v).alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))
    return (
        F.when(marked, pick("preprint", "preprint_venue_marker", 0.8)).when(doi_.isNotNull() & venue_.isNotNull(), pick("published", "doi_plus_venue", 0.7))
        .when(doi_.isNotNull(), pick("published", "doi_present", 0.5)).otherwise(pick("unknown", "insufficient_signal", 0.3))
    )


def extract(papers: DataFrame) -> DataFrame:
    """paper_id, metadata fields, and ``provenance``: of each field its source and confidence."""
    b, m = F.col("blocks"), F.col("meta")
    rows = papers.withColumn("_front", front_text(b))
    rows = rows.withColumns({"_title": title(b, m, F.col("source_path")), "_doi": doi(m, F.col("_front"), F.col("text")), "_year": year(m, F.col("_front")), "_venue": venue(b, m)})
    rows = rows.withColumn("_authors", authors(b, m, F.col("_title.value")))
    sections = F.transform(F.filter(b, lambda x: F.startswith(x["style_hint"], F.lit("heading"))), lambda x: x["text"])
    first = F.get(F.filter(b, lambda x: (x["style_hint"] == "paragraph") & (F.length(x["text"]) > 300)), 0)["text"]
    rows = rows.withColumn("_abstract", F.substring(first, 1, ABSTRACT_CHARS))
    rows = rows.withColumn("_type", document_type(F.col("_title.value"), F.col("_abstract"), F.col("_venue.value"), F.col("source_path"), sections)).withColumn("_status", publication_status(F.col("_venue.value"), F.col("text"), F.col("_doi.value")))
    fields = ["title", "authors", "year", "venue", "doi", "type", "status"]
    provenance = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.struct(F.col(f"_{f}.source").alias("source"), F.col(f"_{f}.confidence").alias("confidence")) for f in fields]))
    return rows.select(
        "paper_id", F.col("_title.value").alias("title"), F.col("_authors.value").alias("authors"), F.col("_year.value").alias("year"), F.col("_venue.value").alias("venue"), F.col("_doi.value").alias("doi"),
        F.col("_doi.confidence").alias("doi_confidence"), T.arxiv_id(F.col("_front")).alias("arxiv_id"), T.pmid(F.col("_front")).alias("pmid"), T.pmcid(F.col("_front")).alias("pmcid"),
        F.col("_type.value").alias("document_type"), F.col("_status.value").alias("publication_status"), keywords(b).alias("keywords"), F.col("_abstract").alias("abstract"), provenance.alias("provenance"),
    )
