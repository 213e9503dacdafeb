import re

import numpy as np
import pytest

from tessera.llm import graph
from tessera.llm import neardup as N
from tessera.llm.graph import components
from tessera.llm.queries import op6_near_duplicates


def brute(rows, size, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = {doc: doc for doc, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for g in by.values() if len(g) > 1 for k, i in enumerate(g) for j in g[k + 1 :]}
    for i, j in pairs:
        if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = root(rows[i][0]), root(rows[j][0])
            label[max(a, b)] = min(a, b)
    return sorted((doc, len(s), root(doc), root(doc) == doc) for (doc, _), s in zip(rows, sets))


def hold(got, rows, size, num, den):
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, size, num, den)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    hold(op6_near_duplicates(spark, sf_dir).collect(), rows, 3, 85, 100)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(9, base), (3, base.upper()), (5, base + " x"), (4, base + " x y"), (1, None), (2, ""), (6, " \t\n"), (7, "Ab"), (8, "aB"), (10, "a b c"), (11, "lone")]
    docs = spark.createDataFrame([(a, b, True) for a, b in rows], "doc_id long, text string, kept boolean")
    hold(N.near_duplicates(docs, 3, 0.85).collect(), rows, 3, 85, 100)
    assert N.near_duplicates(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(None, base), (1, base), (1, base), (1, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in N.near_duplicates(none, 3, 0.85).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True)]


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 5)):
            w[k] = f"z{rng.integers(0, 9)}"
        rows.append((100 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold, num in ((0.85, 85), (0.7, 70)):
        hold(N.near_duplicates(docs, 3, threshold).collect(), rows, 3, num, 100)
    monkeypatch.setattr(N, "REPS", 1)
    hold(N.near_duplicates(docs, 3, 0.85).collect(), rows, 3, 85, 100)


def test_rows_of_a_large_group_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    moved = []
    each = N._each_task
    monkeypatch.setattr(N, "_each_task", lambda rows, look: moved.append(rows.count()) or each(rows, look))
    base = [f"w{i}" for i in range(200)]
    for n in (60, 240):
        rows = [(i, " ".join([*base[: i % 199], f"z{i}", *base[i % 199 + 1 :]])) for i in range(n)]
        moved.append(0)
        got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()
        assert {r.component_id for r in got} == {0}
        moved[:] = [*moved[: moved.index(0)], sum(moved[moved.index(0) :])]
    assert moved[1] < 6 * moved[0]


def test_long_texts(spark):
    rng = np.random.default_rng(8)
    w = [f"v{i}" for i in rng.integers(0, 1 << 30, 150000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:1000], "new", *w[1000:]])), (3, " ".join(w[:120000])), (4, "x" * 3_000_000), (5, "X" * 3_000_000 + " y")]
    hold(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect(), rows, 3, 85, 100)


@pytest.mark.parametrize("part", [7, 1 << 18])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(400, 440)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: y for x, y in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_pruning_keeps_similar_pairs():
    least = N.least_matches(0.85)
    assert len(least) == N.HASHES // N.BATCH and all(0 < m <= (k + 1) * N.BATCH for k, m in enumerate(least))
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(300):
        n = int(rng.integers(40, 400))
        shared = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        more = rng.integers(0, 1 << 63, int(n * 0.15 / 0.85), dtype=np.uint64)
        sig = np.stack([N.small(N.signature(x)) for x in (shared, np.concatenate([shared, more]))])
        lost += not len(N.survivors(sig, 0, np.array([1]), least))
    assert lost == 0


def test_rows_per_band():
    for t in (0.6, 0.8, 0.85, 0.95):
        r = N.rows_per_band(t)
        assert (1 - t**r) ** (N.HASHES // r) <= N.MISS_BANDS
    assert N.rows_per_band(0.85) == pytest.approx(5)
