"""Document files: a scan of a folder, and readers for Markdown, plain text, Word and archives, all over binaryFile rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..operators.policy import extension
from . import html as H

try:
    import yaml
except ImportError:  # front matter then stays text
    yaml = None

MOST_MB = 200
DOCUMENTS = ["pdf", "html", "htm", "xhtml", "md", "markdown", "txt", "text", "docx"]
ARCHIVES = ["zip"]
MOST_LISTED = 200
BLOCK = "order int, text string, style_hint string, n_lines int, line int, bold boolean"
_ATX = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")
_UNDERLINE = re.compile(r"(=+|-{2,})\s*$")
_NUMBERED = re.compile(r"\d+(\.\d+)*[.)]?\s+\S.{0,90}$")


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, most_mb: int = MOST_MB) -> DataFrame:
    """path, size_bytes, content_sha256, ext, category (document, archive, unsupported), reason, content of every file.

    Names that match an ignore glob, and folders that begin with a dot, are left out.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")
    if empty := _empty_files(spark, root):  # Spark's readers skip them
        rows = rows.union(spark.createDataFrame([(p, 0, bytearray()) for p in empty], "path string, length long, content binary"))
    base = F.regexp_replace(F.col("path"), r"^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    rows = rows.select(base.alias("path"), F.col("length").alias("size_bytes"), "content").where(~F.col("path").rlike(r"(^|/)\.[^/]*/"))
    for glob in ignore or []:
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob)
        rows = rows.where(~F.col("path").rlike(f"^(?:.*/)?{pattern}$"))
    ext = extension(F.col("path"))
    reason = (
        F.when(F.col("size_bytes") == 0, "empty file").when(F.col("size_bytes") > most_mb * 1024 * 1024, f"larger than {most_mb} MB")
        .when(~ext.isin([*DOCUMENTS, *ARCHIVES]), F.concat(F.lit("unsupported format: "), ext))
    )
    category = F.when(reason.isNotNull(), "unsupported").when(ext.isin(ARCHIVES), "archive").otherwise("document")
    return rows.select("path", "size_bytes", F.sha2("content", 256).alias("content_sha256"), ext.alias("ext"), category.alias("category"), reason.alias("reason"), "content")


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def front_matter(text: str) -> tuple[dict, str]:
    """The YAML mapping at a text's head, if there is a valid one, and what follows."""
    m = re.match(r"---\n(.*?)\n---\s*\n?", text, re.S)
    if m and yaml is not None:
        try:
            found = yaml.safe_load(m[1])
        except yaml.YAMLError:
            return {}, text
        if isinstance(found, dict):
            return {str(k): str(v) if not isinstance(v, list) else "; ".join(map(str, v)) for k, v in found.items() if v is not None}, text[m.end() :]
    return {}, text


def _plain_heading(line: str) -> bool:
    line = line.strip()
    if not line or len(line) > 90:
        return False
    if _NUMBERED.match(line):
        return True
    letters = [c for c in line if c.isalpha()]
    return line[-1] not in ".;,:" and bool(letters) and sum(c.isupper() for c in letters) > 0.8 * len(letters)


def parse_text(text: str, markdown: bool) -> tuple[list[dict], dict[str, str]]:
    """Blocks and metadata of Markdown (headings, fences, front matter) or plain text (paragraphs, likely headings)."""
    text = text.replace("\r\n", "\n")
    meta, text = front_matter(text) if markdown else ({}, text)
    out: list[dict] = []
    held: list[tuple[int, str]] = []

    def close(hint: str = "paragraph"):
        body = "\n".join(line for _, line in held).strip()
        if body:
            out.append({"order": len(out), "text": body, "style_hint": hint, "n_lines": body.count("\n") + 1, "line": held[0][0], "bold": hint.startswith("heading")})
        held.clear()

    fenced = False
    for no, line in enumerate(text.split("\n"), 1):
        if markdown and line.strip().startswith("```"):
            if fenced:
                held.append((no, line))
                close("code_block")
            else:
                close()
                held.append((no, line))
            fenced = not fenced
        elif fenced:
            held.append((no, line))
        elif markdown and (m := _ATX.match(line)):
            close()
            held.append((no, m[2]))
            close(f"heading{len(m[1])}")
        elif markdown and held and _UNDERLINE.match(line) and sum(len(x) for _, x in held) < 90:
            close("heading1" if line.lstrip().startswith("=") else "heading2")
        elif not line.strip():
            close()
        elif not markdown and not held and _plain_heading(line):
            held.append((no, line))
            close("heading2")
        else:
            held.append((no, line))
    close()
    return out, meta


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"


def _runs(node) -> str:
    parts = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    text = "".join((n.text or "") if n.tag == f"{_W}t" else parts.get(n.tag, "") for n in node.iter())
    return re.sub(r"[ \t\xa0]+", " ", text).strip()


def parse_docx(content: bytes) -> tuple[list[dict], dict[str, str]]:
    """Paragraphs with heading styles, tables as one block each, and the title and author of a Word file."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    for node in body if body is not None else []:
        hint, text = "paragraph", ""
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            level = re.match(r"heading\s*(\d)", name)
            hint = f"heading{level[1]}" if level else "heading1" if name == "title" else "caption" if name.startswith("caption") else "paragraph"
            text = _runs(node)
        elif node.tag == f"{_W}tbl":
            rows = [[_runs(c) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            hint, text = "table", "\n".join(" | ".join(r) for r in rows if any(r))
        if text:
            out.append({"order": len(out), "text": text, "style_hint": hint, "n_lines": text.count("\n") + 1, "line": None, "bold": hint.startswith("heading")})
    names = {"title": f"{_DC}title", "author": f"{_DC}creator"}
    return out, {k: core.findtext(tag) for k, tag in names.items() if core is not None and core.findtext(tag)}


def parse_pdf(content: bytes) -> tuple[list[dict], dict[str, str]]:
    """Pages' paragraphs, where a PDF library is installed; this package brings none."""
    from pypdf import PdfReader

    out: list[dict] = []
    for page in PdfReader(io.BytesIO(content)).pages:
        for text in re.split(r"\n\s*\n", page.extract_text() or ""):
            if text.strip():
                out.append({"order": len(out), "text": text.strip(), "style_hint": "paragraph", "n_lines": text.count("\n") + 1, "line": None, "bold": False})
    return out, {}


def _html(content: bytes) -> tuple[list[dict], dict[str, str]]:
    blocks, meta = H.parse(content.decode("utf-8", "replace"))
    return [{**{k: b[k] for k in ("order", "text", "style_hint", "n_lines")}, "line": None, "bold": b["style_hint"].startswith("heading")} for b in blocks], meta


#: Readers by extension; more can be added. A reader takes the file's bytes.
READERS: dict[str, Callable[[bytes], tuple[list[dict], dict[str, str]]]] = {
    **dict.fromkeys(("html", "htm", "xhtml"), _html),
    **dict.fromkeys(("md", "markdown"), lambda c: parse_text(c.decode("utf-8", "replace"), True)),
    **dict.fromkeys(("txt", "text"), lambda c: parse_text(c.decode("utf-8", "replace"), False)),
    "docx": parse_docx,
    "pdf": parse_pdf,
}
PARSED = f"path string, content_sha256 string, blocks array<struct<{', '.join(c.replace(' ', ':') for c in BLOCK.split(', '))}>>, meta map<string,string>, error string"


def read_documents(files: DataFrame) -> DataFrame:
    """Rows of ``scan`` of the category document to (path, content_sha256, blocks, meta, error)."""

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    blocks, meta = READERS[r.ext](bytes(r.content))
                    rows.append((r.path, r.content_sha256, blocks, meta, None))
                except Exception as error:  # one unreadable file is a row with its error
                    rows.append((r.path, r.content_sha256, [], {}, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "content_sha256", "blocks", "meta", "error"])

    own = files.where("category = 'document'").select("path", "content_sha256", "ext", "content")
    return own.mapInPandas(run, PARSED)


@F.pandas_udf(t.ArrayType(t.StructType().add("name", "string").add("size", "long")))
def _listed(content: pd.Series) -> pd.Series:
    def names(c):
        try:
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                return [{"name": i.filename, "size": i.file_size} for i in z.infolist()[:MOST_LISTED]]
        except zipfile.BadZipFile:
            return None

    return content.map(names)


def archive_listing(files: DataFrame) -> DataFrame:
    """(path, contents) of archives: the first 200 entries, which are listed and not read."""
    return files.where("category = 'archive'").select("path", _listed("content").alias("contents"))


def response(text):
    """The JSON of a model's answer, without the fence around it."""
    return F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", "")
