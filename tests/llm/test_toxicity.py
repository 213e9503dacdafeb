import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import toxicity as T
from tessera.llm.common import fold
from tessera.llm.queries import op7_toxicity


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op7_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [(r.score, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    bad, good = [s for s, m in out if m == 1], [s for s, m in out if m == 0]
    assert sum(s >= 0.5 for s in good) <= 0.01 * len(good) and sum(s >= 0.5 for s in bad) >= 0.75 * len(bad)


def test_small_sample_keeps_false_positives_low(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    usable = fold(F.col("doc_id")) != 0
    model = T.train(docs, labels, usable=usable, sample=360)  # of about 2800 clean and 350 toxic rows
    rows = T.score(docs.where(~usable), model, keep_text=False).join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    bad, good = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert sum(good) <= 0.01 * len(good) and sum(bad) >= 0.5 * len(bad)


def test_odd_rows(spark):
    rows = [(i, f"you are a moron number {i}" if i % 2 else f"have a nice day number {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    odd = [(1, None), (2, ""), (3, "what a moron"), (3, "what a moron"), (None, "nice day"), (5, "nice " * 300_000 + "moron")]
    frame = spark.createDataFrame([(a, b, "s") for a, b in odd], "doc_id long, text string, score string")
    got = [(r.doc_id, r.predicted) for r in T.score(frame, model).collect()]
    assert sorted(got, key=str)[-2:] == [(5, 1), (None, 0)] and got.count((3, 1)) == 2
    empty = {round(r.score, 9) for r in T.score(frame.where("doc_id < 3"), model).collect()}
    assert len(empty) == 1 and 0 < empty.pop() < 1
    assert T.score(frame.limit(0), model).collect() == []
    none = T.train(docs, labels.limit(0))
    assert all(r.score < 1e-300 and r.predicted == 0 for r in T.score(frame, none).collect())
    one = T.train(docs, labels.where("toxic = 1"))
    assert all(r.score > 0.5 for r in T.score(frame, one).collect())


def test_features_by_hand():
    def named(text):
        f, row = T.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (row == 0).all()
        return set(f.tolist())

    assert named(b"Alpha beta") == named(b"(alpha, BETA!") and len(named(b"ab cd ef gh")) == 4 + 3 + 2 + 1
    assert len(named(b"abcdefgh")) == 1 + 3
    f, row = T.features(np.frombuffer(b"a bc d", np.uint8), np.array([0, 1, 3, 6]))
    assert sorted(row.tolist()) == [0, 1, 2, 2, 2]


def test_ftrl_finds_the_word():
    rng = np.random.default_rng(0)
    y = (np.arange(400) % 2).astype(int)
    rows = [np.unique(np.append(rng.integers(100, 160, 12), [7] if m else [8])).astype(np.uint32) for m in y]
    model = T.fit(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])[:-1], np.cumsum([len(r) for r in rows]), y)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    assert weights[7] > 1 and weights[8] < -1 and len(weights) < 12


def test_slices_do_not_matter(monkeypatch):
    features = np.unique(T.features(np.frombuffer(b"you moron there", np.uint8), np.array([0, 15]))[0])
    model = T.Model(features, np.linspace(-1, 1, len(features)), 0.1)
    texts = pa.array(["you moron there", "moron", None, "there you are", ""] * 30)
    whole = T.score_batch(texts, model)
    monkeypatch.setattr(T, "SLICE", 32)
    assert np.allclose(whole, T.score_batch(texts, model))


def test_sample_is_bounded_by_its_features(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("vile words " if i % 4 == 0 else "kind words ") * 2 + f"and {i} more " * (i % 9)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    taken = []
    fit = T.fit
    monkeypatch.setattr(T, "fit", lambda f, *a: taken.append(len(f)) or fit(f, *a))
    for bound in (1 << 25, 1500, 0):
        monkeypatch.setattr(T, "FEATURES", bound)
        model = T.train(docs, labels)
        p = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
        assert bound == 0 or all(p[i] == (i % 4 == 0) for i in p)
    assert taken[0] > 1500 >= taken[1] > 1000 and taken[2] == 0
