"""WARC archives as a chunked record table.

Writing: payloads are cut into chunks of ``CHUNK`` bytes by DataFrame functions; every task streams the chunk rows of its
records, in order, into one archive of its own (a gzip member for each record), so that neither side holds more of a record
than a chunk. Digests are carried from chunk to chunk and compared with the record's header at its end. The result is a
manifest, one row per archive of a task that succeeded; archives of failed or repeated attempts have names of their own
and are in no manifest, so a lost executor costs one more attempt and nothing else.

Reading: ``read_chunks`` streams archives into rows of record identifier and chunk number, with the digest and the number
of bytes so far; the row marked ``last`` has those of the whole payload.

Archives are opened through pyarrow's file systems by the folder's URI (file, hdfs, s3, gs), on the executors; the folder
must be shared.

Defined cases: a null payload is empty; a null url is left out; line breaks in urls are percent-encoded; records with equal
payloads of at least ``LEAST_SHARED`` bytes are revisits of the one with the smallest page_id; rows of one page_id with
equal payloads are all responses if that is the smallest; rows without page_id are always responses, and come back
without; an empty table gives no archives and no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mapped, resplit, shared_dir

CHUNK = 1 << 18
LEAST_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:tessera:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, "
    "payload binary, payload_bytes long, payload_digest string"
)


def records(pages: DataFrame, payload: Column | None = None, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each row."""
    body = F.coalesce(payload if payload is not None else F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    shared = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest")
    # Only payloads that occur again; Spark broadcasts them if their measured size is small, else it joins by shuffle.
    first = shared.agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    rows = rows.join(resplit(first), "payload_digest", "left")
    refers_to = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    record_type = F.when(refers_to.isNull(), "response").otherwise("revisit")
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", record_type.alias("record_type"), refers_to.alias("refers_to"))


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of the payloads; the rows of a record follow one another."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.ceil(F.length(body) / chunk), F.lit(1)) - 1
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    part = F.substring(body, (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk))
    return rows.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", (F.col("chunk_no") == last).alias("last"), part.alias("chunk"))


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _header(r: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n"
    url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    stored = r["payload_bytes"] if r["record_type"] == "response" else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: <{f'{_ID}{r["page_id"]}' if r['page_id'] is not None else f'urn:uuid:{uuid.uuid4()}'}>",
        f"WARC-Date: {DATE}",
        *[f"WARC-Target-URI: {url}"] * (r["url"] is not None),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        *([f"WARC-Refers-To: <{_ID}{r['refers_to']}>", f"WARC-Profile: {_PROFILE}"] if r["record_type"] == "revisit" else []),
        f"Content-Length: {len(http) + stored}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """Write archives into the shared folder; returns their manifest (archive, records, bytes), cut from its lineage."""

    def write(batches):
        system = path = out = None
        n = size = 0
        member = digest = None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "last", "chunk")}
                if out is None:
                    system, root = _open(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(path, compression=None)
                if r["chunk_no"] == 0:
                    member, digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256()
                    out.write(member.compress(_header(r)))
                digest.update(r["chunk"])
                out.write(member.compress(r["chunk"]))
                if r["last"]:
                    if r["record_type"] == "response" and digest.hexdigest() != r["payload_digest"]:
                        raise ValueError(f"record {r['page_id']}: its chunks don't make its payload")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path.rpartition("/")[2]], "records": [n], "bytes": [size]})

    return cut(mapped(chunks, write, "archive string, records long, bytes long"))


def read_archive(stream, chunk: int = CHUNK):
    """Rows of CHUNKS, as tuples, of one gzipped archive."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while line := f.readline().rstrip(b"\r\n").decode():
            name, _, value = line.partition(":")
            head[name.lower()] = value.strip()
        left = int(head["content-length"])
        http = {}
        while (raw := f.readline()) and (left := left - len(raw)) >= 0 and (line := raw.rstrip(b"\r\n").decode()):
            name, _, value = line.partition(":")
            http[name.lower()] = value.strip()
        ident, kind = head["warc-record-id"].strip("<>"), head["warc-type"]
        page = int(ident.removeprefix(_ID)) if ident.startswith(_ID) else None
        refers = head.get("warc-refers-to", "").strip("<>").removeprefix(_ID)
        fixed = (ident, page, head.get("warc-target-uri"), kind, int(refers) if refers else None)
        declared = head["warc-payload-digest"].partition(":")[2]
        digest, size, no = hashlib.sha256(), 0, 0
        while True:
            part = f.read(min(chunk, left))
            if left and not part:
                raise ValueError(f"record {ident} is cut short")
            left -= len(part)
            size += len(part)
            digest.update(part)
            if not left and kind == "revisit":
                yield (*fixed, no, True, b"", int(http["content-length"]), declared)
            else:
                if not left and digest.hexdigest() != declared:
                    raise ValueError(f"record {ident} has another digest than its header")
                yield (*fixed, no, not left, part, size, digest.hexdigest())
            no += 1
            if not left:
                break
        if f.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {ident} has no end")


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives of a manifest; without the payloads themselves if they aren't asked for."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(CHUNKS).names
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]

    def run(batches):
        system, root = _open(folder)
        for b in batches:
            for name in b.column("archive").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for r in read_archive(stream, chunk):
                        held += len(r[7]) * payloads + 200
                        rows.append(r if payloads else (*r[:7], None, *r[8:]))
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return mapped(manifest, run, CHUNKS)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages to archives, read these back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_chunks(chunked(records(pages)), folder)
    ends = read_chunks(manifest, folder, payloads=False).where("last")
    return ends.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
