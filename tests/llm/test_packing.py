import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as P
from tessera.llm.queries import op2_packing


def hold(rows, texts):
    """What the contract says of the pieces of these texts (a list of (doc_id, text))."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary())
    want = []
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        assert cuts[-1] == len(ids)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), -(-sum(w[3] for w in want) // 1024)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used, least = hold(op2_packing(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= least * 1.02 + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x " * 3000), (5, "<|endoftext|> é 😀"), (6, "y" * 5000)]
    docs = spark.createDataFrame([(a, b, 9) for a, b in rows], "doc_id long, text string, offset int")
    hold(P.pack(docs).collect(), rows)
    long = [(1, "some words and <|endoftext|> others, é " * 20000), (2, "z"), (3, None)]
    hold(P.pack(spark.createDataFrame(long, "doc_id long, text string")).collect(), long)
    assert P.pack(docs.limit(0)).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
def test_solution_covers_every_piece_once(histogram):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths])
    used = P.solve(lengths, counts, 64, 50)
    assert (sum(c * n for c, n in used) == counts).all()
    assert all((c * lengths).sum() <= 64 and n > 0 for c, n in used)
    assert sum(n for _, n in used) <= sum(n for _, n in P.best_fit(lengths, counts, 64))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "|>", " ", "a", "é", "\n"]), max_size=12).map("".join)))
def test_encoders_agree(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary())
    assert list(P.encoder(P.vocabulary())(text)) == t.encode(text, add_special_tokens=False).ids


def test_pricing_is_a_knapsack():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 20, 6))
        weights = rng.random(len(lengths))
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *[best[c - x] + w for x, w in zip(lengths, weights) if x <= c]])
        got = P.price(weights, lengths, np.full(len(lengths), 99), 30)
        assert (got * lengths).sum() <= 30 and (got * weights).sum() == pytest.approx(best[30])


def test_configurations_beat_best_fit():
    lengths = np.array([260, 270, 300, 340, 350, 370, 400, 410])
    counts = np.array([294, 302, 351, 390, 206, 228, 364, 389])
    least = -(-int((lengths * counts).sum()) // 1024)
    used = sum(n for _, n in P.solve(lengths, counts))
    assert used < 0.92 * sum(n for _, n in P.best_fit(lengths, counts, 1024)) and used <= 1.05 * least
