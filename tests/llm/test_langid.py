import zlib

from pyspark.sql import functions as F

from tessera.llm import langid as L
from tessera.llm.queries import op1_language_id


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.98 * len(out)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog are in the house " * 3, "en", 0.5) for i in range(12)] + [(20 + i, "der Hund und die Katze sind in dem Haus " * 3, "de", 0.5) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.train(docs)
    odd = [(1, None), (2, ""), (3, "12 34 !?"), (4, "The dog and the house"), (4, "The dog and the house"), (None, "das Haus und der Hund"), (6, "der Hund " * 200_000)]
    frame = spark.createDataFrame([(a, b, 9.0, "x") for a, b in odd], "doc_id long, text string, score double, lang_pred string")
    out = L.identify(frame, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    got = [(r.doc_id, r.lang_pred, r.score > 0, r.rejected) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "und", False, True), (2, "und", False, True), (3, "und", False, True), (4, "en", True, False), (4, "en", True, False), (None, "de", True, False), (6, "de", True, False)], key=str)
    assert L.identify(frame.limit(0), model).collect() == []
    none = L.train(docs.where("lang is null"))
    assert {r.lang_pred for r in L.identify(frame, none).collect()} == {"und"}
    one = L.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in L.identify(frame.where("doc_id = 4"), one).collect()} == {"en"}


def test_slices_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs, usable=F.lit(True))
    import pyarrow as pa

    texts = pa.array([r.text for r in docs.limit(40).collect()])
    whole = L.score_batch(texts, model)
    monkeypatch.setattr(L, "SLICE", 64)
    parts = L.score_batch(texts, model)
    assert (whole[0] == parts[0]).all() and abs(whole[1] - parts[1]).max() < 1e-6
