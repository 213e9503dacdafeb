import duckdb
import pytest

from test_pipeline import mixed
from tessera.llm import mixing as M
from tessera.llm.queries import OP8_SQL, op8_mixing


def rows_of(rows):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=str)


def sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cursor = con.execute(OP8_SQL)
    names = [c[0] for c in cursor.description]
    order = [names.index(n) for n in ("doc_id", "size", "source_size", "target", "taken")]
    return [tuple(r[i] for i in order) for r in cursor.fetchall()]


def test_query(spark, sf_dir):
    got = op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(got) == rows_of(sql(docs))
    by = {}
    for d, r in zip(docs.orderBy("doc_id").collect(), sorted(got)):
        assert r.taken <= 3 * r.size
        by.setdefault(d.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= M.PACKET for taken, target in by.values())
    assert sum(t for t, _ in by.values()) == sum(r["size"] for r in got) and abs(sum(t for _, t in by.values()) - sum(r["size"] for r in got)) < 1
    assert rows_of(got) == rows_of(op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken").collect())


ODD = [(1, "a b c d", "x"), (2, None, "x"), (3, "", "y"), (4, " \t", None), (5, "one two three", None), (6, "w " * 50, "z"), (6, "w " * 50, "z"), (7, "k l", "Z"), (None, "m n o", "x"), (8, "p q r s t", "t")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "a") for r in ODD], "doc_id long, text string, source string, size int, _target string")
    got = M.mix(docs).drop("finish").collect()
    assert rows_of([(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got]) == rows_of(sql(docs.select("doc_id", "text", "source")))
    assert M.mix(docs.limit(0)).collect() == [] and M.mixed_documents(docs.limit(0)).collect() == []
    assert [r.taken for r in M.mix(docs.where("doc_id in (2, 3)")).collect()] == [0, 0]


def test_stream_of_deliveries(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted([(r.source, r.text) for r in rows], key=str) == mixed([{"doc_id": a, "text": b, "source": c} for a, b, c in ODD])


@pytest.mark.parametrize("exact", [1 << 16, 3])
def test_null_ids_long_texts_and_fine_ranges(spark, monkeypatch, exact):
    monkeypatch.setattr(M, "EXACT", exact)
    rows = [(None, f"w{i} " * (1 + i % 7), "x") for i in range(40)] + [(None, "same words", "y")] * 30 + [(9, "long " * 30000, "z"), (10, "k " * 999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in M.mix(docs).collect()]
    want = sql(docs.withColumn("doc_id", docs.doc_id.cast("string")))
    assert rows_of([(str(a) if a else a, *b) for a, *b in got]) == rows_of(want)
    assert sorted([(r.source, r.text) for r in M.mixed_documents(docs).collect()], key=str) == mixed([{"doc_id": a, "text": b, "source": c} for a, b, c in rows])


def test_total_budget(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 90), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    for share in (0.1, 0.5, 1.0):
        got = M.mix(docs, share=share).collect()
        assert sum(r.taken for r in got) == int(share * sum(r["size"] for r in got))
        by = {}
        for r in got:
            by.setdefault(r.doc_id % 3, [0, r.target])[0] += r.taken
        assert all(abs(taken - target) <= M.PACKET for taken, target in by.values())


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3}, {"a": 5}, {"a": 1, "b": 1, "c": 10**6, "d": 1}, {"a": 0, "b": 7}])
def test_water_level(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "_queue string, _source_size long")
    got = {r["_queue"]: r["_target"] for r in M.targets(frame).collect()}
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6
    weight = {q: (5, 2, 1)[i % 3] for i, q in enumerate(sorted(sizes))}
    level = [got[q] / weight[q] for q in sizes if got[q] < 3 * sizes[q] - 1e-9]
    assert all(got[q] <= 3 * sizes[q] + 1e-9 for q in sizes) and (not level or max(level) - min(level) < 1e-6)
    assert all(got[q] / weight[q] <= min(level) + 1e-6 for q in sizes if level and got[q] >= 3 * sizes[q] - 1e-9)
