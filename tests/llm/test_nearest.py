import numpy as np

from pyspark.sql import functions as F

from tessera.llm import nearest as N
from tessera.llm.queries import op3_nearest


def exact(rows, k, is_query):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for q in ids[[is_query(i) for i in ids]]:
        s = (x * x[ids == q][0]).sum(1)
        others = np.flatnonzero(ids != q)
        order = others[np.lexsort((ids[others], -s[others]))][:k]
        out[int(q)] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def recall(got, want, k):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, best in want.items():
        mine = sorted(by.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [(m[1], m[2]) for m in mine] == [(i, s) for i, s in sorted([(m[1], m[2]) for m in mine], key=lambda t: (-t[1], t[0]))]
        hits += len({m[1] for m in mine} & {i for i, _ in best})
        total += len(best)
    assert set(by) <= set(want)
    return hits / max(total, 1)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = exact(rows, 20, lambda i: i % 20 == 0)
    assert recall(op3_nearest(spark, sf_dir).collect(), want, 20) >= 0.95


def test_blocks_norms_and_copies(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)) * rng.random((900, 1)) * 3
    x[100:400] = x[100]
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact(rows, 20, lambda i: i % 20 == 0)
    got = N.nearest(frame, F.col("vec_id") % 20 == 0, 20, 128).collect()
    assert recall(got, want, 20) >= 0.9
    scores = {(q, i): s for q, best in want.items() for i, s in best}
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in scores)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (40, [float("inf"), 1.0]), (8, [1.0, 0.0]), (9, [1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in N.nearest(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 8, 1.0), (0, 2, 20, 1.0), (0, 3, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 8, 1.0), (20, 3, 3, 0.5)]
    assert N.nearest(frame.limit(0), F.lit(True)).collect() == []
    assert N.nearest(frame.where("vec_id = 0"), F.lit(True)).collect() == []
