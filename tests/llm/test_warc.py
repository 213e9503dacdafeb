import gzip
import hashlib
import io

import pytest

from tessera.llm import warc as W
from tessera.llm.queries import op5_warc


def expect(rows):
    out = []
    for page, html in rows:
        body = (html or "").encode()
        same = [p for p, h in rows if p is not None and (h or "").encode() == body]
        first = min(same) if page is not None and len(body) >= 100 else page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    return sorted(out, key=str)


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted([tuple(r) for r in op5_warc(spark, sf_dir).collect()], key=str) == expect(rows)


ODD = [(5, "x" * 100), (3, "x" * 100), (4, "x" * 99), (1, "x" * 99), (6, None), (7, ""), (None, "x" * 100), (9, "é😀\r\n\r\nWARC/1.1\r\n" * 3000), (10, "é😀\r\n\r\nWARC/1.1\r\n" * 3000), (3, "x" * 100)]


def test_odd_rows(spark):
    pages = spark.createDataFrame([(p, "http://a/\r\nb" if p == 5 else None, h, "q") for p, h in ODD], "page_id long, url string, html string, payload string")
    assert sorted([tuple(r) for r in W.round_trip(spark, pages).collect()], key=str) == expect(ODD)
    assert W.round_trip(spark, pages.limit(0)).collect() == []


def test_chunks_carry_digests(spark, tmp_path):
    pages = spark.createDataFrame([(p, f"http://h/{p}", h) for p, h in ODD if p is not None], "page_id long, url string, html string")
    folder = (tmp_path / "warc").as_uri()
    manifest = W.write_chunks(W.chunked(W.records(pages), 1000), folder)
    rows = W.read_chunks(manifest, folder, 700).where("page_id = 9").orderBy("chunk_no").collect()
    body, digest = b"", hashlib.sha256()
    assert [r.chunk_no for r in rows] == list(range(len(rows))) and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    for r in rows:
        body += r.payload
        digest.update(r.payload)
        assert len(r.payload) <= 700 and r.payload_digest == digest.hexdigest() and r.payload_bytes == len(body)
    assert body.decode() == dict(ODD)[9] and rows[0].url == "http://h/9"
    # Archives that no task has accounted for, of lost attempts, are not read.
    (tmp_path / "warc" / "part-lost.warc.gz").write_bytes(b"broken")
    assert W.read_chunks(manifest, folder, payloads=False).where("last").count() == 9


def test_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    folder = tmp_path / "w"
    W.write_chunks(W.chunked(W.records(pages)), folder.as_uri())
    (path,) = folder.glob("*.gz")
    plain = gzip.decompress(path.read_bytes())
    for bad in (plain.replace(b"yyyy", b"yyyz", 1), plain[:-900], plain[:-1]):
        with pytest.raises(ValueError):
            list(W.read_archive(io.BytesIO(gzip.compress(bad))))
