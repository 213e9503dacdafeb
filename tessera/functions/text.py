"""Text expressions: normalisation, identifiers, token sets and similarity, as Columns that Catalyst compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of titles' slugs and token sets.
TITLE_STOP = ["a", "an", "the", "of", "for", "and", "or", "in", "on", "to", "with", "using", "via", "from", "by", "at", "into", "based"]
# Section names that are headings wherever they stand alone.
CANONICAL_SECTIONS = [
    "abstract", "summary", "significance", "introduction", "background", "related work", "prior work",
    "materials and methods", "methods", "method", "methodology", "experimental setup", "experiments", "data and methods",
    "results", "results and discussion", "evaluation", "discussion", "limitations", "conclusion", "conclusions",
    "conclusion and future work", "acknowledgements", "acknowledgments", "funding", "author contributions",
    "competing interests", "conflict of interest", "data availability", "code availability", "ethics", "references",
    "bibliography", "literature cited", "supplementary material", "supplementary materials", "supporting information",
    "appendix", "appendices",
]
REFERENCE_SECTIONS = ["references", "bibliography", "literature cited", "reference list"]
AFTER_REFERENCES = ["appendix", "appendices", "supplementary", "supporting information"]
# Identifier and caption formats.
DOI = r"(?i)(10\.\d{4,9}/[^\s\"'<>,;)\]]+)"
ARXIV = r"(?i)arxiv[:/\s]*(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+/\d{7}(?:v\d+)?)"
PMID = r"(?i)PMID[:\s]*(\d{6,9})"
PMCID = r"(?i)(PMC\d{6,9})"
CAPTION = r"(?i)^\s*(?:supplementary\s+)?(?:table|tab\.|figure|fig\.?|scheme|algorithm|listing|box|equation|eq\.)\s*(?:s?\d+[a-z]?|[ivxlc]+)(?:[\s.:|)]|$)"
# Control, invisible and private-use characters: what text extraction leaves behind.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u200B-\u200F\u2028\u2029\uFEFF\uE000-\uF8FF]"
NUMBERED = r"^(\d+(?:\.\d+){0,3})[.)]?\s+(\S.{0,110})$"
MATH = "=+×÷≤≥≈∑∏∫∂√±→←↔∈∉⊂⊆∪∩∀∃¬∧∨αβγδεθλμνπρσςτφχψωΩΔΣΓΘΛΞΠΦΨ^_|"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_block(text: Column, keep_lines: bool = False) -> Column:
    """Text of a block as it is indexed: soft hyphens go, control and private-use characters become spaces, words split at
    a line's end are joined, white space is folded (tables and code keep their lines)."""
    clean = F.regexp_replace(F.translate(text, "\u00ad", ""), CONTROL, " ")
    if keep_lines:
        lines = F.transform(F.split(clean, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"[ \t]+", " ")))
        return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")
    joined = F.regexp_replace(clean, r"([A-Za-z])[-‐‑]\n([a-z])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s*\n\s*", " "), r"[ \t\xA0]+", " "))


def mask(text: Column, size: int = 90) -> Column:
    """What running heads have in common: lower case, single spaces, numbers as #, the first ``size`` characters."""
    return F.substring(F.regexp_replace(squeezed(F.lower(text)), r"\d+", "#"), 1, size)


def heading_probe(text: Column) -> Column:
    """A heading without its number, final colon or dot, and case."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[:.]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\s*\d+(?:\.\d+)*[.)]?\s*", ""), r"\s+", " ")


def canonical_heading(text: Column, extra: list[str] | None = None) -> Column:
    probe = heading_probe(text)
    return F.when(probe.isin([*CANONICAL_SECTIONS, *[e.lower() for e in extra or []]]), probe)


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def caption_label(text: Column) -> Column:
    found = F.regexp_extract(text, CAPTION, 0)
    return F.when(found != "", F.regexp_replace(squeezed(found), r"^[ .:|)]+|[ .:|)]+$", ""))


def looks_like_equation(text: Column) -> Column:
    n = F.length(text)
    math = n - F.length(F.translate(text, MATH, ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return n.between(3, 220) & (math >= 2) & (math > n * 0.08) & (letters < n * 0.6)


def words(folded: Column) -> Column:
    """Runs of a-z and 0-9 of an already folded text."""
    return F.regexp_extract_all(F.lower(folded), F.lit("[a-z0-9]+"), F.lit(0))


def slug(folded: Column, most: int = 4, drop_stop: bool = True) -> Column:
    every = words(folded)
    kept = F.filter(every, lambda w: ~w.isin(TITLE_STOP)) if drop_stop else every
    chosen = F.when(F.size(kept) > 0, kept).otherwise(every)
    text = F.array_join(F.slice(chosen, 1, most), "-")
    return F.when(F.coalesce(text, F.lit("")) == "", "untitled").otherwise(text)


def normalize_title(folded: Column) -> Column:
    return F.coalesce(F.array_join(words(folded), " "), F.lit(""))


def last_name(author: Column) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(author, F.lit(""))), r"^,+|,+$", "")
    part = F.when(F.contains(clean, F.lit(",")), F.substring_index(clean, ",", 1)).otherwise(F.element_at(F.split(squeezed(clean), " "), -1))
    return F.when(clean == "", "anon").otherwise(slug(part, 1, False))


def normalize_doi(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    found = F.regexp_extract(bare, DOI, 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"""[.,;)\]}>'"]+$""", "")))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def arxiv_id(text: Column) -> Column:
    return _found(text, ARXIV)


def pmid(text: Column) -> Column:
    return _found(text, PMID)


def pmcid(text: Column) -> Column:
    return _found(text, PMCID)


def token_set(folded: Column, extra_stop: list[str] | None = None) -> Column:
    stop = [*TITLE_STOP, *(extra_stop or [])]
    return F.array_distinct(F.filter(words(folded), lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of tokens in common; 0 if either side has none."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def short_hash(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def identity(doi: Column, doi_confidence: Column, arxiv: Column, pmid_: Column, pmcid_: Column, author: Column, year: Column, title: Column, content_hash: Column) -> Column:
    """struct(basis, key): the first of a trusted DOI, other identifiers, and metadata with the content's hash."""
    meta = F.concat(F.lit("meta:"), last_name(author), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")), F.lit("|"), normalize_title(title), F.lit("|"), F.substring(content_hash, 1, 16))
    clean = normalize_doi(doi)
    pick = lambda basis, key: F.struct(F.lit(basis).alias("basis"), key.alias("key"))
    return (
        F.when(clean.isNotNull() & (F.coalesce(doi_confidence, F.lit(0.0)) >= 0.6), pick("doi", F.concat(F.lit("doi:"), clean)))
        .when(arxiv.isNotNull(), pick("arxiv", F.concat(F.lit("arxiv:"), F.lower(arxiv))))
        .when(pmid_.isNotNull(), pick("pmid", F.concat(F.lit("pmid:"), pmid_)))
        .when(pmcid_.isNotNull(), pick("pmcid", F.concat(F.lit("pmcid:"), F.upper(pmcid_))))
        .otherwise(pick("metadata+content", meta))
    )


def paper_id(key: Column, author: Column, year: Column, title: Column) -> Column:
    return F.concat_ws("-", last_name(author), F.coalesce(year.cast("string"), F.lit("nd")), slug(title, 3), short_hash(key, 6))


def claim_id(paper: Column, statement: Column, ordinal: Column) -> Column:
    digest = short_hash(F.concat(paper, F.lit("|"), normalize_title(statement)), 6)
    return F.concat(paper, F.lit("#c"), F.when(ordinal < 100, F.lpad(ordinal.cast("string"), 2, "0")).otherwise(ordinal.cast("string")), F.lit("-"), digest)


def relation_id(source: Column, relation: Column, target: Column, dimension: Column) -> Column:
    return F.concat(F.lit("r-"), short_hash(F.concat_ws("|", source, relation, target, normalize_title(dimension)), 8))


def unit_id(index: Column) -> Column:
    return F.concat(F.lit("u"), F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string")))


def topic_id(name: Column) -> Column:
    return F.concat(F.lit("t-"), slug(name, 5))


def mentions(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in a text as whole words, without regard to case."""
    return says(F.lower(text), phrase)


def says(lowered: Column, phrase: str) -> Column:
    """``mentions`` of a text in lower case, for texts that are asked for many phrases.

    Texts without the phrase's characters are passed by their bytes; the pattern begins with the phrase and looks around
    afterwards, so most characters are passed at its first letter.
    """
    import re

    bare = phrase.strip().lower()
    inside = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", bare)
    return F.lit(bool(bare)) & F.contains(lowered, F.lit(bare)) & lowered.rlike(f"{inside}(?<![A-Za-z0-9]{inside})(?![A-Za-z0-9])")


def for_match(text: Column) -> Column:
    """Text in which quotes are looked up: curly quotes, dashes, ligatures and white space folded, lower case."""
    plain = F.translate(text, "\u2019\u2018\u201c\u201d\u2013\u2014\u2212\u00a0", "''\"\"--- ")
    plain = F.replace(F.replace(plain, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    plain = F.regexp_replace(plain, r"[\p{Cc}\p{Cf}\p{Co}&&[^\n\t\r\x0B\f]]", "")
    return F.lower(squeezed(plain))


def token_estimate(text: Column, per_token: int = 4) -> Column:
    return (F.floor(F.length(text) / per_token) + 1).cast("long")


def joined(values: Column, separator: str = " | ") -> Column:
    return F.coalesce(F.array_join(values, separator), F.lit(""))


def fingerprint(*parts: Column) -> Column:
    """16 digits that change whenever a part does; nulls count."""
    return short_hash(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 16)


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1_000_000, F.format_string("%.1f KB", n / 1000.0))
        .when(n < 1_000_000_000, F.format_string("%.1f MB", n / 1_000_000.0))
        .otherwise(F.format_string("%.1f GB", n / 1_000_000_000.0))
    )


def plausible_title(text: Column) -> Column:
    t = F.trim(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.coalesce(
        F.length(t).between(12, 320)
        & (F.size(F.split(squeezed(t), " ")) >= 3)
        & (letters >= F.length(t) * 0.6)
        & ~t.rlike(r"(?i)\.(?:pdf|docx?|tex)$")
        & ~t.rlike(r"(?i)^(?:untitled|microsoft word|op-[a-z0-9]+|\d+\.\.\d+)"),
        F.lit(False),
    )
