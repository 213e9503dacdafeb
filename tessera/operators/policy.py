"""Which files are uploaded, converted, migrated or left out; conversion states; checks of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1_000_000
# File extensions by what they hold.
EXPERIMENTAL = ["fastq", "fq", "sam", "bam", "cram", "fast5", "pod5", "czi", "lif", "nd2", "ims", "fcs", "mzml", "mzxml"]
IMAGE_VIEW = ["jpg", "jpeg", "png", "webp", "gif"]
IMAGE_SOURCE = ["tif", "tiff", "bmp", "psd", "heic", "eps", "ai"]
WORD = ["docx", "doc", "rtf", "odt"]
EXCEL = ["xlsx", "xlsm", "xls", "ods"]
POWERPOINT = ["pptx", "ppt", "odp"]
ARCHIVE = ["zip", "7z", "rar", "tar", "tgz", "tbz", "txz", "gz", "bz2", "xz", "zst"]
MEDIA = ["mp4", "mov", "avi", "mkv", "webm", "m4v", "wmv", "mp3", "wav", "flac", "m4a"]
DATA = [
    "npy", "npz", "pkl", "pickle", "h5", "hdf5", "mat", "parquet", "feather", "db", "sqlite", "sqlite3", "rds", "rdata", "pt", "pth",
    "ckpt", "safetensors", "joblib", "arrow", "bcolz", "zarr",
]
EXECUTABLE = ["exe", "dll", "so", "dylib", "bin", "o", "a", "class", "jar", "wasm", "msi", "dmg", "pkg", "deb", "rpm", "app"]
TEXT = [
    "md", "markdown", "txt", "rst", "tex", "bib", "cls", "sty", "py", "r", "rmd", "ipynb", "jl", "m", "sh", "bash", "zsh", "fish", "ps1",
    "bat", "c", "h", "cpp", "cc", "hpp", "cxx", "java", "kt", "go", "rs", "swift", "pl", "php", "rb", "lua", "js", "jsx", "ts", "tsx",
    "vue", "css", "scss", "html", "htm", "xml", "svg", "json", "jsonl", "ndjson", "yaml", "yml", "toml", "ini", "cfg", "conf", "properties",
    "env_example", "sql", "graphql", "proto", "snakefile", "nf", "cwl", "dockerfile", "makefile", "cmake", "gradle", "gitignore",
    "gitattributes", "log", "diff", "patch", "sbatch", "slurm", "smk", "wdl", "do", "sas", "f90", "f", "nb", "gp", "gnuplot", "csl", "lock",
    "editorconfig",
]
TEXT_NAMES = [
    "makefile", "dockerfile", "snakefile", "license", "licence", "readme", "changelog", "authors", "notice", "codeowners", "requirements",
    "pipfile",
]
REFUSED_FOLDERS = ["desktop", "downloads", "documents", "pictures", "movies", "music", "library", "applications", "dropbox", "onedrive", "icloud drive", "google drive", "mobile documents", "public"]
CLOUD_ROOTS = ["/library/mobile documents", "/dropbox", "/onedrive", "/google drive"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension; compressed experimental reads keep their own."""
    parts = F.split(F.lower(base_name(path)), r"\.")
    n = F.size(parts)
    packed = (n >= 3) & F.element_at(parts, -1).isin("gz", "bz2", "xz", "zst") & F.try_element_at(parts, F.lit(-2)).isin(EXPERIMENTAL)
    return F.when(packed, F.try_element_at(parts, F.lit(-2))).when(n >= 2, F.element_at(parts, -1)).otherwise("")


def output_name(path: Column, kind: Column) -> Column:
    base = F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", "")
    ending = F.when(kind == "image", ".preview.jpg").when(kind == "pdf", ".git.pdf").when(kind == "word", ".md")
    return F.concat(base, ending)


def classify(path: Column, size: Column, symlink_outside: Column | None = None, placeholder: Column | None = None, unreadable: Column | None = None, has_nul: Column | None = None) -> Column:
    """struct(category, decision, reason, kind) of a file; the first rule that holds counts."""
    ext, name = extension(path), F.lower(base_name(path))
    no = F.lit(False)

    def what(category: str, decision: str | None, reason: str | None = None, kind: str | None = None) -> Column:
        values = {"category": category, "decision": decision, "reason": reason, "kind": kind}
        return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])

    binary = "unsupported binary format"
    unknown = what("unknown", "ask")
    if has_nul is not None:
        unknown = F.when(has_nul, what("binary", "exclude", binary)).otherwise(unknown)
    return (
        F.when(no if symlink_outside is None else symlink_outside, what("symlink", "exclude", "symlink pointing outside the project"))
        .when(no if placeholder is None else placeholder, what("cloud", "exclude", "cloud file not present locally"))
        .when(no if unreadable is None else unreadable, what("unreadable", "exclude", "file could not be read"))
        .when(ext.isin(EXPERIMENTAL), what("experimental", "exclude", "raw experimental format"))
        .when(ext.isin(POWERPOINT), what("powerpoint", "exclude", "PowerPoint: managed locally only"))
        .when(ext.isin(ARCHIVE), what("archive", "exclude", f"{binary} (archive)"))
        .when(ext.isin(MEDIA), what("media", "exclude", f"{binary} (video/audio)"))
        .when(ext.isin(DATA), what("data-binary", "exclude", binary))
        .when(ext.isin(EXECUTABLE), what("executable", "exclude", binary))
        .when((ext == "csv") & (size > LIMIT), what("csv", "exclude", "CSV exceeds 1 MB"))
        .when(ext == "csv", what("csv", "upload"))
        .when(ext.isin(EXCEL), what("excel", "exclude", "Excel: managed locally only"))
        .when(ext.isin(WORD), what("word", "migrate", "document excluded; offer one-time Markdown migration", "word"))
        .when(ext == "pdf", what("pdf", "convert", "compress automatically", "pdf"))
        .when(ext.isin(IMAGE_SOURCE), what("image-source", "convert", "heavy image source; needs a viewing copy", "image"))
        .when(ext.isin(IMAGE_VIEW) & (size > LIMIT), what("image", "convert", "image above 1 MB; needs compression", "image"))
        .when(ext.isin(IMAGE_VIEW), what("image", "upload"))
        .when(ext.isin(TEXT) | name.isin(TEXT_NAMES) | F.substring_index(name, ".", 1).isin(TEXT_NAMES), what("text", "upload"))
        .otherwise(unknown)
    )


def refused_root(path: Column, home: str) -> Column:
    bare = F.regexp_replace(path, "/+$", "")
    inside = (F.regexp_replace(bare, "/[^/]*$", "") == home) & F.lower(base_name(bare)).isin(REFUSED_FOLDERS)
    cloud = F.lit(False)
    for root in CLOUD_ROOTS:
        cloud |= F.endswith(F.lower(bare), F.lit(root))
    return (bare == "") | (bare == home) | inside | cloud


def conversion_state(files: DataFrame, manifest: DataFrame, declined: DataFrame, outputs: DataFrame) -> DataFrame:
    """files (path, source_hash) with ``state``: new, unchanged, source_changed, output_changed, both_changed or declined.

    manifest (path, old_source, output, old_output); declined (path, declined_hash); outputs (output, output_hash). A source
    that moved to the archive is looked up by its path without that folder; an output that is missing has changed.
    """
    plain = F.regexp_replace("path", r"(^|/)_archive/", "$1")
    known = manifest.select(F.col("path").alias("_at"), "old_source", "output", "old_output")
    rows = files.withColumn("_plain", plain)
    rows = rows.join(known.toDF("path", "s1", "o1", "h1"), "path", "left").join(known.toDF("_plain", "s2", "o2", "h2"), "_plain", "left")
    rows = rows.withColumns({"old_source": F.coalesce("s1", "s2"), "output": F.coalesce("o1", "o2"), "old_output": F.coalesce("h1", "h2")})
    rows = rows.join(declined, "path", "left").join(outputs, "output", "left")
    source = F.col("source_hash") != F.col("old_source")
    output = ~F.coalesce(F.col("output_hash") == F.col("old_output"), F.lit(False))
    state = (
        F.when(F.col("declined_hash") == F.col("source_hash"), "declined").when(F.col("old_source").isNull(), "new")
        .when(source & output, "both_changed").when(source, "source_changed").when(output, "output_changed").otherwise("unchanged")
    )
    return rows.select(*files.columns, "output", state.alias("state"))


FORBIDDEN_PLAN_KEYS = ["force", "delete", "rewrite_history"]


def plan_errors(plan: DataFrame, root: str) -> DataFrame:
    """plan (path, output, consented, archived, keys) with ``errors``: what keeps each entry from being applied."""
    outside = lambda c: F.col(c).rlike(r"(^|/)\.\.(/|$)") | F.startswith(F.col(c), F.lit("/")) & ~F.startswith(F.col(c), F.lit(root.rstrip("/") + "/")) | F.col(c).rlike(r"(^|/)\.git(/|$)")
    taken = plan.where("output is not null").groupBy("output").agg(F.count("*").alias("_n"))
    rows = plan.join(taken, "output", "left")
    problems = [
        (~F.coalesce("consented", F.lit(False)), "not approved"), (outside("path"), "path leaves the project"),
        (F.coalesce(outside("output"), F.lit(False)), "output leaves the project"), (F.coalesce(F.col("_n") > 1, F.lit(False)), "outputs collide"),
        (F.size(F.array_intersect(F.coalesce("keys", F.array().cast("array<string>")), F.array(*map(F.lit, FORBIDDEN_PLAN_KEYS)))) > 0, "forbidden option"),
        (F.coalesce("archived", F.lit(False)) & F.col("output").isNull(), "archived without its output"),
    ]
    errors = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in problems]))
    return rows.withColumn("errors", errors).select(*plan.columns, "errors")


def decision_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("decision").agg(F.count("*").alias("n"))
