"""From blocks of text to documents: reading order, running heads, headings and sections, roles, offsets, retrieval units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import sentences

MAX_CHARS, MIN_CHARS = 1500, 220
BAND, PAGE_SHARE = 0.10, 0.4
MIN_PAGE_CHARS, POOR_PAGES = 120, 0.34
UNIT_ROLES = ("front_matter", "body", "caption", "table", "code", "footnote", "equation_candidate")
ALONE = ("caption", "table", "code", "equation_candidate", "footnote")


def line_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, char_start, char_end, n_chars, text) of the lines that aren't blank; offsets in code points.

    Offsets come from a running sum inside the row, so nothing is shuffled.
    """
    lines = F.split(F.col(text), "\n")
    start = lambda: F.struct(F.array().cast("array<struct<s:int,t:string>>").alias("out"), F.lit(0).alias("at"))
    made = F.aggregate(
        lines, start(),
        lambda a, x: F.struct(F.array_append(a["out"], F.struct(a["at"].alias("s"), x.alias("t"))).alias("out"), (a["at"] + F.length(x) + 1).alias("at")),
        lambda a: a["out"],
    )
    rows = docs.select(key, F.posexplode(made).alias("line", "u")).where(F.trim(F.col("u.t")) != "")
    return rows.select(key, (F.col("line") + 1).cast("long").alias("ordinal"), F.col("u.s").cast("long").alias("char_start"), (F.col("u.s") + F.length("u.t")).cast("long").alias("char_end"), F.length("u.t").cast("long").alias("n_chars"), F.col("u.t").alias("text"))


def text_quality(n_chars: Column, alnum: Column, cid: Column | None = None, replaced: Column | None = None, poor_share: Column | None = None) -> Column:
    """Shares are compared as whole numbers: as doubles, 55 % of 200 characters are more than 110."""
    zero = F.lit(0)
    poor = F.lit(False) if poor_share is None else F.coalesce(poor_share >= POOR_PAGES, F.lit(False))
    some = F.lit(False) if poor_share is None else F.coalesce(poor_share > 0, F.lit(False))
    return (
        F.when(n_chars < 200, "empty")
        .when(poor | ((zero if cid is None else cid) > 20) | ((zero if replaced is None else replaced) * 100 > n_chars) | (alnum * 100 < n_chars * 55), "poor")
        .when(some | (alnum * 100 < n_chars * 65), "fair")
        .otherwise("good")
    )


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", alnum: str = r"[^\p{L}\p{N}]") -> DataFrame:
    """(key, n_chars, n_alnum, n_cid, n_replaced, text_quality), counted inside the row."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda part: ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("long")
    rows = docs.select(key, F.length(t).cast("long").alias("n_chars"), F.length(F.regexp_replace(t, alnum, "")).cast("long").alias("n_alnum"), count("(cid:").alias("n_cid"), count("�").alias("n_replaced"))
    return rows.withColumn("text_quality", text_quality(F.col("n_chars"), F.col("n_alnum"), F.col("n_cid"), F.col("n_replaced")))


def page_quality(blocks: DataFrame, n_pages: Column) -> DataFrame:
    """Share of pages with little text, per paper: (paper_id, poor_share)."""
    per_page = blocks.where(F.col("char_start").isNotNull()).groupBy("paper_id", "page_index").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("n"))
    full = per_page.groupBy("paper_id").agg(F.count_if(F.col("n") >= MIN_PAGE_CHARS).alias("rich"))
    return full.select("paper_id", (1 - F.col("rich") / n_pages).alias("poor_share"))


def running_heads(blocks: DataFrame, n_pages: str = "n_pages") -> DataFrame:
    """Blocks with ``role`` header, footer or page_number where their band of the page shows that.

    A head stands in the top or bottom tenth, has at most 3 lines and 200 characters, and its masked text is on at least
    max(3, round(0.4 * pages)) pages; papers of fewer than 3 pages have none.
    """
    band = F.when(F.col("y1") <= F.col("page_height") * BAND, "header").when(F.col("y0") >= F.col("page_height") * (1 - BAND), "footer")
    short = (F.col("n_lines") <= 3) & (F.length("text") <= 200) & (F.col(n_pages) >= 3)
    rows = blocks.withColumn("_band", F.when(short, band)).withColumn("_mask", T.mask(F.col("text")))
    pages = rows.where("_band is not null").groupBy("paper_id", "_band", "_mask").agg(F.count_distinct("page_index").alias("_on"))
    rows = rows.join(pages, ["paper_id", "_band", "_mask"], "left")
    least = F.greatest(F.lit(3), F.bround(F.col(n_pages) * PAGE_SHARE).cast("int"))
    folio = F.trim("text").rlike(r"(?i)^(?:[ivxlcdm]{1,7}|\d{1,5})$")
    role = F.when(F.col("_band").isNotNull() & folio, "page_number").when(F.col("_on") >= least, F.col("_band"))
    return rows.withColumn("role", role).drop("_mask", "_on").withColumnRenamed("_band", "band")


def repeated_lines(lines: DataFrame, least: int, key: str = "doc_id") -> DataFrame:
    """(mask, documents, n): masked short lines that stand in at least ``least`` documents."""
    short = lines.where(F.length("text") <= 200).select(key, T.mask(F.col("text")).alias("mask"))
    return short.groupBy("mask").agg(F.count_distinct(key).alias("documents"), F.count("*").alias("n")).where(F.col("documents") >= least)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``rank`` in their page: two columns are read one after the other between blocks that span the page."""
    page = Window.partitionBy("paper_id", "page_index")
    left, right = F.min("x0").over(page), F.max("x1").over(page)
    rows = blocks.withColumn("_span", F.greatest(F.lit(1.0), right - left)).withColumn("_mid", left + F.greatest(F.lit(1.0), right - left) / 2)
    rows = rows.withColumn("_wide", (F.col("x1") - F.col("x0")) > F.col("_span") * 0.62)
    rows = rows.withColumn("_column", F.when((F.col("x0") + F.col("x1")) / 2 < F.col("_mid"), 0).otherwise(1))
    narrow = ~F.col("_wide")
    n = lambda c: F.count_if(c).over(page)
    straddle = n(narrow & (F.col("x0") < F.col("_mid")) & (F.col("_mid") < F.col("x1")))
    two = (n(narrow & (F.col("_column") == 0)) >= 2) & (n(narrow & (F.col("_column") == 1)) >= 2) & (straddle / F.greatest(F.lit(1), n(narrow)) <= 0.25)
    rows = rows.withColumn("_two", two).withColumn("_y", F.round("y0", 1))
    down = page.orderBy("_y", "x0", "order")
    spans = F.sum(F.col("_wide").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_bandno", F.when(F.col("_two"), spans * 2 - F.col("_wide").cast("int")).otherwise(0))
    key = [F.col("_bandno"), F.when(F.col("_two") & narrow, F.col("_column")).otherwise(0), F.when(F.col("_two") & narrow, F.col("y0")).otherwise(F.col("_y")), F.col("x0"), F.col("order")]
    return rows.withColumn("rank", F.row_number().over(page.orderBy(*key))).drop("_span", "_mid", "_wide", "_column", "_two", "_y", "_bandno")


def body_font_size(blocks: DataFrame) -> DataFrame:
    """(paper_id, body_size): the median font size, each block weighted by its text."""
    rows = blocks.where(F.col("font_size").isNotNull() & ~F.coalesce(F.col("role").isin("header", "footer", "page_number"), F.lit(False)))
    weight = F.greatest(F.lit(1), F.floor(F.length("text") / 40)).cast("long")
    return rows.groupBy("paper_id").agg(F.percentile("font_size", 0.5, weight).alias("body_size"))


def page_labels(blocks: DataFrame) -> DataFrame:
    """(paper_id, label_offset) where at least two printed page numbers form one run with the pages."""
    folio = blocks.where("role = 'page_number'").groupBy("paper_id", "page_index").agg(F.min_by(F.trim("text"), "order").alias("label"))
    rows = folio.groupBy("paper_id").agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("label").rlike(r"^\d+$"), F.col("label").cast("int") - F.col("page_index"))).alias("offsets"))
    return rows.where((F.col("n") >= 2) & (F.size("offsets") == 1)).select("paper_id", F.col("offsets")[0].alias("label_offset"))


_CAPTION = re.compile(T.CAPTION.replace("(?i)", ""), re.I)
_NUMBERED = re.compile(T.NUMBERED)
_MATH = frozenset(T.MATH)
_CONTROL = re.compile(T.CONTROL)


def _canonical(text: str, extra: frozenset[str]) -> str | None:
    probe = re.sub(r"\s+", " ", re.sub(r"^\s*\d+(\.\d+)*[.)]?\s*", "", text.strip().rstrip(":.").lower()))
    return probe if probe in extra or probe in T.CANONICAL_SECTIONS else None


def _equation(text: str) -> bool:
    math = sum(c in _MATH for c in text)
    return 3 <= len(text) <= 220 and math >= 2 and math > 0.08 * len(text) and sum(map(str.isalpha, text)) < 0.6 * len(text)


def heading_level(text: str, hint: str, n_lines: int, font: float | None, bold: bool, body: float | None, extra: frozenset[str]) -> int | None:
    """Level of a heading by its style, its name, its number, its size, or its weight, in this order."""
    if m := re.fullmatch(r"heading([1-6])", hint):
        return int(m[1])
    named = _canonical(text, extra)
    if hint in ("table", "table_row", "code_block", "caption") or _CAPTION.match(text):
        return None
    if named:
        return 1
    if len(text) > 130 or n_lines > 2 or "\n" in text:
        return None
    if (m := _NUMBERED.match(text)) and len(text) <= 120 and not _equation(text):
        titled = text[-1] not in ".;," and re.match(r"[A-Z(]", m[2]) and re.search(r"[A-Za-z]{2}", m[2])
        if titled:
            return min(m[1].count(".") + 1, 4)
    if font and body:
        for factor, most, level in ((1.25, 120, 1), (1.10, 90, 2)):
            if font >= body * factor and len(text) <= most:
                return level
    return 3 if bold and len(text) <= 80 and not text.endswith(".") else None


def _clean(text: str, keep_lines: bool) -> str:
    text = _CONTROL.sub(" ", text.replace("\u00ad", ""))
    if keep_lines:
        return "\n".join(x for x in (re.sub(r"[ \t]+", " ", line).rstrip() for line in text.split("\n")) if x.strip())
    text = re.sub(r"([A-Za-z])[-‐‑]\n([a-z])", r"\1\2", text)
    return re.sub(r"[ \t\xa0]+", " ", re.sub(r"\s*\n\s*", " ", text)).strip()


def split_inline_headings(blocks: list[dict], extra: frozenset[str]) -> list[dict]:
    """A block whose first line is a known or numbered heading becomes two."""
    out = []
    for b in blocks:
        head, _, rest = b["text"].partition("\n")
        head = head.strip().rstrip(":")
        plain = b.get("style_hint") not in ("table", "table_row", "code_block")
        numbered = _NUMBERED.match(head)
        if plain and len(head) <= 60 and len(rest.strip()) >= 40 and (_canonical(head, extra) or numbered and re.match(r"[A-Z(]", numbered[2])):
            out += [b | {"text": head, "n_lines": 1, "style_hint": "heading_inline"}, b | {"text": rest.strip(), "n_lines": rest.count("\n") + 1}]
        else:
            out.append(b)
    return out


def assemble(blocks: list[dict], extra: frozenset[str] = frozenset(), body: float | None = None) -> tuple[str, list[dict]]:
    """The text of a document and its blocks with roles, section paths and offsets, from blocks in reading order."""
    path: list[str] = []
    parts: list[str] = []
    out: list[dict] = []
    at, references, abstract = 0, False, False
    for b in split_inline_headings(blocks, extra):
        raw, hint = b["text"].strip(), b.get("style_hint") or ""
        b = dict(b, block_id=f"b{len(out):05d}", char_start=None, char_end=None, heading_level=None)
        if b.get("role") in ("header", "footer", "page_number"):
            out.append(b | {"section_path": list(path)})
            continue
        level = heading_level(raw, hint, b.get("n_lines") or 1, b.get("font_size"), bool(b.get("bold")), body, extra) if raw else None
        named = _canonical(raw, extra)
        first_page = b.get("page_index") in (0, None)
        if level and not abstract and first_page and len(out) < 12 and not named and not _NUMBERED.match(raw):
            level = None  # title, authors and banners
        if level:
            if named and named.startswith(tuple(T.REFERENCE_SECTIONS)):
                references = True
            elif named and named.startswith(tuple(T.AFTER_REFERENCES)):
                references = False
            abstract = abstract or named in ("abstract", "summary")
            path = [*path[: level - 1], *["(unnumbered)"] * (level - 1 - len(path)), re.sub(r"\s+", " ", raw)]
            role = "heading"
        elif references:
            role = "references"
        elif _CAPTION.match(raw):
            role = "caption"
        elif hint in ("table", "table_row"):
            role = "table"
        elif hint == "code_block":
            role = "code"
        elif b.get("band") == "footer" and body and (b.get("font_size") or body) < 0.92 * body:
            role = "footnote"
        elif _equation(raw):
            role = "equation_candidate"
        else:
            role = "front_matter" if not abstract and first_page and len(parts) < 6 else "body"
        b |= {"role": role, "heading_level": level, "section_path": list(path)}
        text = _clean(raw, hint in ("table", "table_row", "code_block"))
        if text:
            at += 2 if parts else 0
            parts.append(text)
            b |= {"char_start": at, "char_end": at + len(text)}
            at += len(text)
        out.append(b)
    return "\n\n".join(parts), out


def unitize(text: str, blocks: list[dict], most: int = MAX_CHARS, least: int = MIN_CHARS) -> list[dict]:
    """Retrieval units: neighbouring blocks of one section up to ``most`` characters, closed once they have ``least``."""
    units: list[dict] = []
    held: list[dict] = []

    def close():
        if held:
            first, last = held[0], held[-1]
            a, z = first["char_start"], last["char_end"]
            path = first["section_path"]
            units.append({
                "unit_id": f"u{len(units) + 1:04d}", "kind": "paragraph" if first["role"] == "body" else first["role"], "section_path": path,
                "heading": path[-1] if path else None, "page_index_start": first.get("page_index"), "page_index_end": last.get("page_index"),
                "char_start": a, "char_end": z, "n_chars": z - a, "text": text[a:z], "block_ids": [b["block_id"] for b in held],
                "sentence_offsets": [[a + s, a + e] for s, e in sentences(text[a:z])],
            })
            held.clear()

    for b in blocks:
        if b["char_start"] is None or b["role"] == "references":
            continue
        if b["role"] == "heading" or b["role"] not in UNIT_ROLES:
            if b["role"] == "heading":
                close()
            continue
        if b["role"] in ALONE:
            close()
            held.append(b)
            close()
            continue
        if held:
            a = held[0]["char_start"]
            if held[0]["section_path"] != b["section_path"] or b["char_end"] - a > most or held[-1]["char_end"] - a >= least:
                close()
        held.append(b)
        if b["char_end"] - held[0]["char_start"] >= most:
            close()
    close()
    return units


UNIT = (
    "paper_id {key}, unit_id string, kind string, section_path array<string>, heading string, page_index_start int, page_index_end int, "
    "char_start int, char_end int, n_chars int, text string, block_ids array<string>, sentence_offsets array<array<int>>"
)


def units(blocks: DataFrame, extra: list[str] | None = None, key_type: str = "string") -> DataFrame:
    """blocks (paper_id, order, text, and what else is known of style and place) to units; a paper is one group."""
    known = frozenset(e.lower() for e in extra or [])

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order")
        rows = [{k: None if isinstance(v, float) and pd.isna(v) else v for k, v in r.items()} for r in frame.to_dict("records")]
        text, made = assemble(rows, known, rows[0].get("body_size"))
        out = pd.DataFrame(unitize(text, made))
        if out.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in re.sub(r"<[^ ]*>", "", UNIT).split(", ")])
        out.insert(0, "paper_id", frame["paper_id"].iloc[0])
        return out

    return blocks.groupBy("paper_id").applyInPandas(build, UNIT.format(key=key_type))
