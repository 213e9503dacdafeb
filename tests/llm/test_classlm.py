import re
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import classlm as C
from tessera.llm.queries import op4_class_lm


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def hold(got, rows, held):
    counts = Counter(t for (doc, text), h in zip(rows, held) if not h for t in toks(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for (doc, text), h in zip(rows, held):
        t = toks(text)
        base = sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        want.append((doc, h, len(t), sum(counts[x] > 0 for x in t), n, base))
    got = sorted(got, key=lambda r: (str(r.doc_id), r.base_score))
    want.sort(key=lambda r: (str(r[0]), r[5]))
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert isclose(r.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_query(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = [zlib.crc32(str(doc).encode()) % 5 == 1 for doc, _ in rows]
    for common in (C.COMMON, 300):  # also where most words are joined
        monkeypatch.setattr(C, "COMMON", common)
        monkeypatch.setattr(C, "ITEMS", min(common, C.ITEMS))
        got = op4_class_lm(spark, sf_dir).collect()
        hold(got, rows, held)
        out = [r for r in got if r.held_out and r.n_tokens > 50]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
        assert all(r.score < 0 for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b A"), (3, "a b A"), (None, "c"), (4, "\t ")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, row int")
    from pyspark.sql import functions as F

    model, counts = C.train(docs.where("doc_id is null or doc_id <> 4"))
    held = [doc == 4 for doc, _ in rows]
    hold(C.score(docs, model, counts, keep=[F.coalesce(F.col("doc_id") == 4, F.lit(False)).alias("held_out")]).collect(), rows, held)
    empty = docs.limit(0)
    model, counts = C.train(empty)
    assert C.score(empty, model, counts).collect() == []
    assert all(r.n_known == 0 for r in C.score(docs, model, counts).collect())


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b", "b c d", "a a e", ""])], "doc_id long, text string")
    model, counts = C.train(docs, classes=3)
    count = {r.word: r["count"] for r in counts.collect()}
    total = 0.0
    text = np.frombuffer(b"a b c d e", np.uint8)
    h, ending, bounds = C.tokens(text, np.array([0, len(text)]))
    seq, _, _ = model.lookup.sequences(h, ending, bounds)
    for prev in range(len(model.log_transition)):
        total = sum(10 ** (model.log_transition[prev, model.label[i]] - model.log_emission[model.label[i]]) * ((count[w] if w is not None else 4) + 0.5) for i, w in zip(seq, [*h.tolist(), None]))
        # Each class that has no word at all leaves its whole share to unseen words.
        unseen = sum(10 ** (model.log_transition[prev, c] - model.log_emission[c]) * 0.5 for c in range(len(model.log_emission)))
        assert isclose(total + unseen, 1, rel_tol=1e-9)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    group = np.arange(24) % 3
    seq = []
    g = 0
    for _ in range(6000):
        g = (g + 1) % 3 if rng.random() < 0.9 else int(rng.integers(3))
        seq.append(int(rng.choice(np.flatnonzero(group == g))))
    m = np.zeros((26, 26))
    np.add.at(m, (seq[:-1], seq[1:]), 1)
    label = C.exchange(m, 2, 3)
    for k in range(3):
        assert len(set(label[:24][group == k])) == 1


def test_words_beyond_the_items_have_classes_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(C, "ITEMS", 8)
    monkeypatch.setattr(C, "HELD", 50)  # contexts in several parts
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(300):
        pick = [f"{side}{rng.integers(4)}" if rng.random() < 0.7 else f"{side}{rng.integers(4, 34)}same" for _ in range(12) for side in "ab"]
        texts.append(" ".join(pick))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, counts = C.train(docs, classes=2)
    seen = Counter(w for t in texts for w in t.split())
    names = [w for w in sorted(seen) if seen[w] >= 5]
    assert len(names) > 50
    text = np.frombuffer(" ".join(names).encode(), np.uint8)
    h, ending, _ = C.tokens(text, np.array([0, len(text)]))
    label = dict(zip(names, model.label[model.lookup.items(h, ending)].tolist()))
    assert len({label[w] for w in names if w[0] == "a"}) == len({label[w] for w in names if w[0] == "b"}) == 1 and label["a0"] != label["b0"]
    hold(C.score(docs, model, counts, keep=[F.lit(False).alias("held_out")]).collect(), list(enumerate(texts)), [False] * len(texts))


def test_scores_by_hand_on_shuffled_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model, counts = C.train(docs)
    count = Counter(t for text in texts.values() for t in toks(text))
    raw = np.frombuffer(" ".join(w for w in count if w is not None).encode(), np.uint8)
    h, ending, _ = C.tokens(raw, np.array([0, len(raw)]))
    label = dict(zip([w for w in count if w is not None], model.label[model.lookup.items(h, ending)].tolist()))
    label[None], begin = int(model.label[-2]), int(model.label[-1])
    pairs, size, kinds = Counter(), Counter(), Counter(label[t] for t in count)
    for text in texts.values():
        c = [begin, *[label[t] for t in toks(text)]]
        pairs.update(zip(c, c[1:]))
        size.update(c[1:])
    before = Counter()
    for (a, _), k in pairs.items():
        before[a] += k
    total = sum(size.values())
    k = len(model.log_transition)

    def p(a, t):
        share = (size[label[t]] + 0.5) / (total + 0.5 * (k - 1))
        transition = (pairs[a, label[t]] + C.OWN_SHARE * share) / (before[a] + C.OWN_SHARE)
        return log10(transition * (count[t] + 0.5) / (size[label[t]] + 0.5 * (kinds[label[t]] + 1)))

    want = {}
    for doc, text in texts.items():
        t = toks(text)
        want[doc] = (len(t), sum(p(a, b) for a, b in zip([begin, *[label[x] for x in t]], t)))
    for shuffled in (docs, docs.dropDuplicates(["doc_id"]), docs.repartition(16)):
        got = C.score(shuffled, model, counts).collect()
        assert len(got) == len(want)
        for r in got:
            assert r.n_tokens == want[r.doc_id][0] and isclose(r.score, want[r.doc_id][1], rel_tol=1e-9)


def test_most_frequent_words_of_one_count(spark):
    counts = spark.range(5000).select(F.xxhash64("id").alias("word"), F.lit(1).alias("ending"), F.when(F.col("id") < 10, 50).otherwise(7).cast("long").alias("count"))
    word, _, count = C._most_frequent(counts, 1000)
    assert 900 < len(word) <= 1000 and (count[:10] == 50).all() and (count[10:] == 7).all()
