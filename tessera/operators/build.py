"""From a folder of documents to tables: scan, read, structure, metadata, vocabulary, families, index."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import documents, tables
from . import families, metadata, mining, search, state, structure

# The settings there are; free-form maps may have any keys.
DEFAULTS = {
    "sources": {"ignore": [], "max_file_mb": 200},
    "parsing": {"extra_section_headings": []},
    "terminology": {"synonyms": {}, "acronyms": {}, "priority_terms": []},
    "retrieval": {"top_units": 40, "top_claims": 30, "max_units_per_paper": 3, "default_budget_tokens": 8000},
}
FREE = {"terminology.synonyms", "terminology.acronyms"}


def layered(*layers: dict, base: dict | None = None, at: str = "") -> dict:
    """Settings: later layers win; a name that the defaults don't have is an error."""
    base = DEFAULTS if base is None else base
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
    for layer in layers:
        for k, v in (layer or {}).items():
            name = f"{at}.{k}" if at else k
            if k not in base and at not in FREE:
                raise KeyError(f"there is no setting {name}")
            out[k] = layered(out[k], v, base=base[k] if name not in FREE else {}, at=name) if isinstance(base.get(k), dict) and isinstance(v, dict) else v
    return out


def prompt_text(name: str, folder: str, seen: tuple[str, ...] = ()) -> str:
    """A prompt with its {{include: other}} lines filled in."""
    if name in seen:
        raise ValueError(f"{name} includes itself")
    with open(os.path.join(folder, f"{name}.md"), encoding="utf-8") as f:
        return re.sub(r"\{\{include:\s*([\w\-]+)\s*\}\}", lambda m: prompt_text(m[1], folder, (*seen, name)), f.read())


def prompt_version(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def questions(path: str) -> list[dict]:
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    found = found.get("questions", found) if isinstance(found, dict) else found
    for k, q in enumerate(found):
        if "question" not in q:
            raise ValueError(f"entry {k + 1} has no question")
        q.setdefault("id", f"q{k + 1}")
    return found


@dataclass
class Corpus:
    papers: DataFrame
    blocks: DataFrame
    units: DataFrame
    relations: DataFrame
    settings: dict
    files: DataFrame
    adopted: list[str] = field(default_factory=list)


DOCUMENT = (
    "path string, content_sha256 string, text string, meta map<string,string>, error string, "
    "blocks array<struct<order:int,block_id:string,text:string,style_hint:string,role:string,page_index:int,font_size:double,heading_level:int,section_path:array<string>,char_start:int,char_end:int>>, "
    "units array<struct<unit_id:string,kind:string,section_path:array<string>,heading:string,char_start:int,char_end:int,n_chars:int,text:string,sentence_offsets:array<array<int>>>>"
)


def assembled(read: DataFrame, extra: list[str]) -> DataFrame:
    """Documents as read to their texts, blocks with roles, and units."""
    known = frozenset(e.lower() for e in extra)

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                rows = [dict(b.asDict() if hasattr(b, "asDict") else b) for b in r.blocks]
                text, made = structure.assemble([b | {"page_index": None} for b in rows], known)
                blocks = [{k: b.get(k) for k in ("block_id", "text", "style_hint", "role", "page_index", "font_size", "heading_level", "section_path", "char_start", "char_end")} | {"order": i} for i, b in enumerate(made)]
                units = [{k: u[k] for k in ("unit_id", "kind", "section_path", "heading", "char_start", "char_end", "n_chars", "text", "sentence_offsets")} for u in structure.unitize(text, made)]
                out.append((r.path, r.content_sha256, text, dict(r.meta), r.error, blocks, units))
            yield pd.DataFrame(out, columns=["path", "content_sha256", "text", "meta", "error", "blocks", "units"])

    return read.mapInPandas(run, DOCUMENT)


@dataclass
class Update:
    """How many files an update found of each kind, how many it parsed, and the corpus as it is now."""

    corpus: Corpus
    added: int = 0
    modified: int = 0
    renamed: int = 0
    removed: int = 0
    unchanged: int = 0
    parsed: int = 0


def build(spark: SparkSession, root: str, out: str, settings: dict | None = None, overrides: dict[str, DataFrame] | None = None) -> Corpus:
    """Build all tables of a folder into ``out``. Headings that are mined are read as headings in a second pass; there is
    no third, as what was adopted stays adopted."""
    settings = layered(settings or {})
    files = documents.scan(spark, root, settings["sources"]["ignore"], settings["sources"]["max_file_mb"])
    tables.begin(spark, out, "build")
    tables.replace(documents.read_documents(files), f"{out}/read")
    read = spark.read.parquet(f"{out}/read")
    adopted = list(settings["parsing"]["extra_section_headings"])
    tables.replace(assembled(read, adopted), f"{out}/documents")
    adopted = _adopt(spark, out, adopted)
    tables.replace(read.select("path", "content_sha256"), f"{out}/manifest")
    made = _derive(spark, out, settings, files, adopted, overrides)
    tables.append_log(spark, f"{out}/log", "build", f"{root}: adopted {adopted}")
    tables.end(spark, out, "build")
    return made


def update(spark: SparkSession, root: str, out: str, settings: dict | None = None, overrides: dict[str, DataFrame] | None = None) -> Update:
    """Bring the tables in ``out`` up to a folder: only files of new content are read and parsed, renamed ones keep what was
    parsed of their content, and where nothing changed nothing is written. Papers that are gone, or have another identity
    now, stay as tombstones, and relations that name them are retired. Without tables, builds them.
    """
    settings = layered(settings or {})
    for name in ("read", "documents", "manifest", "papers", "relations", "adopted"):
        tables.recover(spark, f"{out}/{name}")
    if not tables.exists(spark, f"{out}/manifest"):
        made = build(spark, root, out, settings, overrides)
        n = spark.read.parquet(f"{out}/manifest").count()
        return Update(made, added=n, parsed=n)
    files = documents.scan(spark, root, settings["sources"]["ignore"], settings["sources"]["max_file_mb"])
    found = state.changes(files.where("category = 'document'"), spark.read.parquet(f"{out}/manifest"))
    tables.replace(found, f"{out}/changes")
    found = spark.read.parquet(f"{out}/changes")
    n = {r[0]: r[1] for r in found.groupBy("change").count().collect()}
    adopted = [r.heading for r in spark.read.parquet(f"{out}/adopted").orderBy("heading").collect()]  # fifteen a pass at most
    if set(n) <= {"unchanged"} and not overrides:
        return Update(_corpus(spark, out, settings, files, adopted), **n)
    tables.begin(spark, out, "update")
    fresh = found.where("change in ('added', 'modified')").select("path")
    moved = found.where("change in ('unchanged', 'renamed')").select(F.col("old_path"), F.col("path").alias("_path"))

    def kept(name: str) -> DataFrame:
        old = spark.read.parquet(f"{out}/{name}")
        return old.join(moved, old["path"] == moved["old_path"]).withColumn("path", F.col("_path")).select(*old.columns)

    tables.replace(kept("read").unionByName(documents.read_documents(files.join(fresh, "path", "left_semi"))), f"{out}/read")
    read = spark.read.parquet(f"{out}/read")
    tables.replace(kept("documents").unionByName(assembled(read.join(fresh, "path", "left_semi"), adopted)), f"{out}/documents")
    adopted = _adopt(spark, out, adopted)
    tables.replace(read.select("path", "content_sha256"), f"{out}/manifest")
    before = [spark.read.parquet(f"{out}/{name}") for name in ("papers", "relations")]
    made = _derive(spark, out, settings, files, adopted, overrides, *before)
    tables.append_log(spark, f"{out}/log", "update", f"{root}: {n}")
    tables.end(spark, out, "update")
    return Update(made, **n, parsed=n.get("added", 0) + n.get("modified", 0))


def _adopt(spark: SparkSession, out: str, adopted: list[str]) -> list[str]:
    """The headings adopted so far and those that the documents' texts recur in; with new ones, all are assembled again."""
    docs = spark.read.parquet(f"{out}/documents")
    lines = docs.select("path", F.explode("blocks").alias("b")).where("b.role in ('body', 'front_matter')").select("path", F.col("b.text").alias("text"))
    if new := [r.heading for r in mining.recurring_headings(lines, "path", adopted).collect()]:  # fifteen at most
        adopted = sorted({*adopted, *new})
        tables.replace(assembled(spark.read.parquet(f"{out}/read"), adopted), f"{out}/documents")
    tables.replace(spark.createDataFrame([(h,) for h in adopted], "heading string"), f"{out}/adopted")
    return adopted


def _derive(
    spark: SparkSession, out: str, settings: dict, files: DataFrame, adopted: list[str], overrides: dict[str, DataFrame] | None = None,
    old_papers: DataFrame | None = None, old_relations: DataFrame | None = None,
) -> Corpus:
    """Papers, families and the index from the assembled documents. Overrides (papers by source_path, relations by
    relation_id; ``delete`` and any columns) apply to papers before families are looked for, to relations after."""
    overrides = overrides or {}
    kept = spark.read.parquet(f"{out}/documents").where("error is null")
    meta = metadata.extract(kept.select(F.col("path").alias("paper_id"), F.col("path").alias("source_path"), F.col("blocks"), "meta", "text"))
    none = F.lit(None).cast("string")
    author = F.try_element_at("authors", F.lit(1))
    from ..functions.udfs import ascii_fold

    papers = meta.join(kept.select(F.col("path").alias("paper_id"), "content_sha256"), "paper_id").withColumnRenamed("paper_id", "source_path")
    papers = _overridden(papers, overrides.get("papers"), "source_path")
    folded, folded_author = ascii_fold("title"), ascii_fold(author)
    key = T.identity(F.col("doi"), F.col("doi_confidence"), F.coalesce("arxiv_id", none), F.coalesce("pmid", none), F.coalesce("pmcid", none), folded_author, F.col("year"), folded, F.col("content_sha256"))
    papers = papers.withColumn("identity", key).withColumn("paper_id", T.paper_id(F.col("identity.key"), folded_author, F.col("year"), folded)).withColumn("status", F.lit("active"))
    papers = papers.withColumn("source_stem", F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)).withColumn("tombstone_reason", none)
    if old_papers is not None:
        active = papers.select("paper_id", F.lit(True).alias("_on")).distinct()
        gone = old_papers.join(active, "paper_id", "left_anti").join(papers.select("source_path", F.lit(True).alias("_there")).distinct(), "source_path", "left")
        reason = F.coalesce("tombstone_reason", F.when(F.col("_there"), "identity changed").otherwise("source removed"))
        papers = papers.unionByName(gone.withColumn("tombstone_reason", reason).withColumn("status", F.lit("tombstoned")).select(*papers.columns))
    tables.replace(papers, f"{out}/papers")
    papers = spark.read.parquet(f"{out}/papers")
    ids = papers.where("status = 'active'").select("paper_id", F.col("source_path").alias("path"))
    blocks = kept.join(ids, "path").select("paper_id", F.explode("blocks").alias("b")).select("paper_id", "b.*")
    units = kept.join(ids, "path").select("paper_id", F.explode("units").alias("u")).select("paper_id", "u.*")
    relations = _overridden(families.detect(papers.where("status = 'active'")), overrides.get("relations"), "relation_id")
    if old_relations is not None:
        _, retired = state.retire(old_relations, ids, "source_paper_id", "target_paper_id", "paper_id")
        tables.replace(retired, f"{out}/retired_relations")
    index = search.build_index(units.withColumn("section", F.array_join("section_path", " > ")), ["paper_id", "unit_id"], search.WEIGHTS["units"], stemmed=True)
    tables.write_index({"blocks": blocks, "units": units, "relations": relations, "postings": index.postings, "lengths": index.lengths, "stats": index.stats}, out)
    return _corpus(spark, out, settings, files, adopted)


def _overridden(rows: DataFrame, patches: DataFrame | None, key: str) -> DataFrame:
    if patches is None:
        return rows
    patches = patches if "delete" in patches.columns else patches.withColumn("delete", F.lit(False))
    return state.apply_overrides(rows, patches, key, [c for c in patches.columns if c in rows.columns and c != key])


def _corpus(spark: SparkSession, out: str, settings: dict, files: DataFrame, adopted: list[str]) -> Corpus:
    load = lambda name: spark.read.parquet(f"{out}/{name}")
    return Corpus(load("papers"), load("blocks"), load("units"), load("relations"), settings, files, adopted)


def open_index(spark: SparkSession, out: str) -> search.Index:
    load = lambda name: spark.read.parquet(f"{out}/{name}")
    return search.Index(load("postings"), load("lengths"), load("stats"), ["paper_id", "unit_id"], search.WEIGHTS["units"])


def ask(spark: SparkSession, out: str, question: str, settings: dict | None = None, filters: search.Filters | None = None, limit: int = 10) -> DataFrame:
    """The best units of a built corpus for a question, with their papers."""
    settings = layered(settings or {})
    terms = settings["terminology"]
    phrases = search.compile_question(question)
    phrases += search.expand_question(question, terms["synonyms"], terms["acronyms"])
    papers = spark.read.parquet(f"{out}/papers").select("paper_id", "title", "year", "document_type", F.array_join("authors", " | ").alias("authors"), "status")
    payload = spark.read.parquet(f"{out}/units").join(papers, "paper_id")
    scores = search.bm25(open_index(spark, out), phrases, stemmed=True)
    return search.ranked(scores, payload, ["paper_id", "unit_id"], limit, filters.paper() if filters else None, active=F.col("status") == "active")
