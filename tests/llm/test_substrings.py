import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common
from tessera.llm import substrings as S
from tessera.llm.queries import op10_repeated_passages


def brute(rows, length):
    texts = [(doc, (t or "").encode()) for doc, t in rows]
    seen = {}
    for _, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def hold(got, rows, length):
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows, length)
    for r in got:
        assert (len(r.removed), sum(x.stop - x.start for x in r.removed)) == (r.n_spans, r.n_removed)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    hold(op10_repeated_passages(spark, sf_dir).collect(), rows, 400)


def test_passages_go_by_bytes_not_words(spark, tmp_path):
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = lambda n: " ".join([letters(6) for _ in range(56)] + [letters(n - 56 * 7)])
    texts, want = [], []
    for n, near, gone in ((399, "\n", 0), (400, "\n", 400), (398, " ", 400), (397, " ", 0)):  # equal spaces beside them count
        p = passage(n)
        assert (len(p), len(p.split())) == (n, 57)
        texts += [f"one {p} one", f"two{near}{p}{near}two"]
        want += [(gone, int(gone > 0))] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op10_repeated_passages(spark, str(tmp_path)).collect())
    assert [(r.n_removed, r.n_spans) for r in got] == want
    assert [r.n_bytes for r in got] == [len(x) for x in texts]


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    a, b = word(90), word(70)
    rows = [(1, None), (2, ""), (3, a), (3, a), (4, "x" * 200), (5, b + a[:50] + b), (None, b[5:60]), (6, a[10:49]), (7, a[10:50] + "q")]
    docs = spark.createDataFrame([(x, y, "s") for x, y in rows], "doc_id long, text string, spans string")
    for options in ({}, {"hot": 150, "shard": 400}):
        hold(S.repeated(docs, 40, **options).collect(), rows, 40)
    assert S.repeated(docs.limit(0), 40).collect() == []


def test_hot_anchors_meet_across_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    passage = letters(120)
    rows = [(i, letters(50) + passage + letters(50)) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:]) for i in range(8)] + [(200, "ab" * 100), (201, passage[40:])]
    rows += [(300 + i, rows[10 + i % 3][1]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, sent in ((1500, 1 << 18), (300, 1 << 18), (300, 0), (1, 1 << 18)):
        monkeypatch.setattr(S, "MOST_SENT", sent)
        hold(S.repeated(docs, 60, hot=hot, shard=4000).collect(), rows, 60)


def brute_words(rows, length, across):
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    seen, texts = Counter(), {}
    windows = [[b" ".join(t.encode()[a:z] for a, z in w[i : i + length]) for i in range(len(w) - length + 1)] for (_, t), w in zip(rows, split)]
    for (_, t), own in zip(rows, windows):
        for x in own:
            seen[x] += 1
            texts.setdefault(x, set()).add(t)
    out = []
    for (doc, t), w, own in zip(rows, split, windows):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i, x in enumerate(own):
            if len(texts[x]) > 1 if across else seen[x] > 1:
                a, z = w[i][0], w[i + length - 1][1]
                gone[a:z] = b"\1" * (z - a)
        out.append((doc, sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("options", [{}, {"hot": 200, "shard": 1000}, {"slice": 300}])
def test_words(spark, monkeypatch, across, options):
    rng = np.random.default_rng(11)
    say = lambda n: "".join(rng.choice(["a", "bb", "ccc", "é", "dddd", "e"]) + rng.choice([" ", "  ", "\n"], p=[0.9, 0.05, 0.05]) for _ in range(n))
    passage = say(30)
    rows = [(i, say(20) + passage + say(30)) for i in range(40)] + [(50, None), (51, ""), (52, passage), (53, passage[5:]), (54, " ".join(["over"] * 60))]
    rows += [(60, "once and again " * 12), (None, rows[3][1]), (61, rows[3][1]), (62, rows[4][1][:90]), (63, " x" * 7), (64, "w" * 700 + " " + passage + "v" * 500)]
    options = dict(options)
    monkeypatch.setattr(common, "SLICE", options.pop("slice", common.SLICE))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.repeated(docs, 12, unit="words", across=across, **options).collect() if not options and common.SLICE > 300 else None
    spans = {(r.t1, r.t2): S.merged([(x.lo, x.hi) for x in r.spans]) for r in S.repeated_spans(docs, 12, unit="words", across=across, **options).collect()}
    made = []
    for doc, t in rows:
        t = (t or "").encode()
        gone = spans.get(tuple(np.frombuffer(hashlib.md5(t).digest(), ">i8").tolist()), [])
        made.append((doc, sum(hi - lo for lo, hi in gone), hashlib.sha256(S.kept(t, gone)).hexdigest()))
    assert sorted(made, key=str) == brute_words(rows, 12, across)
    if got is not None:
        assert sorted([(r.doc_id, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_words(rows, 12, across)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=120), st.integers(1, 6), st.integers(4, 40), st.sampled_from(["bytes", "words"]))
def test_long_texts_in_pieces(symbols, length, slice_, unit):
    data = np.frombuffer("".join("ab c\ndé "[i] for i in symbols).encode(), np.uint8)
    pieces = list(S.long_pieces(data, length, unit, slice_))
    x = S.Symbols(data, np.array([0, len(data)]), unit)
    want = [(int(x.starts[i]), int(x.ends[i + length - 1])) for i in range(len(x.starts) - length + 1)]
    got = []
    for a, z in pieces:
        own = S.Symbols(data[a:z], np.array([0, z - a]), unit)
        got += [(a + int(own.starts[i]), a + int(own.ends[i + length - 1])) for i in range(len(own.starts) - length + 1)]
    assert got == want


def test_texts_over_a_slice(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop é"), n))
    passage = letters(90)
    rows = [(1, letters(900) + passage + letters(700) + passage), (2, passage[3:] + letters(2000)), (3, letters(1500)), (4, letters(30)), (5, None)]
    monkeypatch.setattr(common, "SLICE", 256)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = {(r.t1, r.t2): r.spans for r in S.repeated_spans(docs, 50).collect()}
    rows_ = []
    for doc, t in rows:
        t = (t or "").encode()
        gone = S.merged([(x.lo, x.hi) for x in made.get(tuple(np.frombuffer(hashlib.md5(t).digest(), ">i8").tolist()), [])])
        rows_.append((doc, len(t), sum(hi - lo for lo, hi in gone), len(gone), hashlib.sha256(S.kept(t, gone)).hexdigest()))
    assert sorted(rows_, key=str) == brute(rows, 50)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.lists(st.sampled_from([0, 1, 97]), max_size=80).map(bytes)))
def test_suffix_array(text):
    data = np.frombuffer(text, np.uint8)
    sa, _ = S.suffix_array(data)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert sa.tolist() == want

    def common(i, j):
        n = 0
        while i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        return n

    assert S.common_prefixes(data, sa, 10).tolist() == [min(10, common(want[k - 1], want[k])) if k else 0 for k in range(len(want))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 12))
def test_window_minima(values, width):
    got = S.window_minima(np.array(values, np.uint64), width)
    assert got.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
