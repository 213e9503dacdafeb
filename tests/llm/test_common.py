import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import classlm, toxicity
from tessera.llm import common as C

TEXT = st.text(alphabet="aB é\t\n.x", max_size=40)


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 30))
def test_words_of_slices(texts, limit):
    data, offsets = C.text_buffers(pa.array(texts, pa.string()))
    got = []
    for i, j in C.doc_slices(offsets, limit):
        own = data[offsets[i] : offsets[j]]
        starts, ends, bounds = C.words(own, offsets[i : j + 1] - offsets[i])
        for r in range(j - i):
            got.append([own[a:z].tobytes() for a, z in zip(starts[bounds[r] : bounds[r + 1]], ends[bounds[r] : bounds[r + 1]])])
    assert got == [split((t or "").encode()) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 12))
def test_long_rows_in_pieces(text, limit):
    data, offsets = C.text_buffers(pa.array([text]))
    whole, one = C.word_hashes(data, offsets)
    parts, two = C.word_hashes(data, offsets, limit)
    assert (whole == parts).all() and one[-1] == two[-1] == len(split(text.encode()))
    assert b"".join(p.tobytes() for p, _ in C.word_pieces(data, offsets, limit)) == text.encode()


def test_pieces_change_nothing(monkeypatch):
    text = "Some words, (here) and there. " * 40
    data, offsets = C.text_buffers(pa.array([text]))
    before = [classlm.tokens(data, offsets), toxicity.features(data, offsets)]
    monkeypatch.setattr(C, "SLICE", 50)
    after = [classlm.tokens(data, offsets), toxicity.features(data, offsets)]
    assert all((x == y).all() for x, y in zip(before[0], after[0]))
    assert sorted(zip(*[a.tolist() for a in before[1]])) == sorted(zip(*[a.tolist() for a in after[1]]))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 30))
def test_span_hashes(data, i, j, n):
    span = C.SpanHash(np.frombuffer(data, np.uint8))
    if i + n <= len(data) and j + n <= len(data):
        a, b = (span(np.array([k]), np.array([k + n]))[0] for k in (i, j))
        assert (a == b) == (data[i : i + n] == data[j : j + n])


def test_span_hashes_tell_thue_morse_strings_apart():
    bits = np.array([bin(i).count("1") & 1 for i in range(1 << 14)], np.uint8)
    for a, b in (b"ab", b"01", b" x"):
        for size in (64, 512, 1024, 1 << 14):
            one, two = (np.where(x, a, b).astype(np.uint8) for x in (bits[:size], 1 - bits[:size]))
            span = C.SpanHash(np.concatenate([one, two, one]))
            h = span(np.array([0, size, 2 * size]), np.array([size, 2 * size, 3 * size]))
            assert h[0] != h[1] and h[0] == h[2]


def test_span_hashes_spread():
    rng = np.random.default_rng(5)
    span = C.SpanHash(rng.integers(0, 3, 1 << 20).astype(np.uint8))
    at = np.arange((1 << 20) - 40)
    assert len(np.unique(span(at, at + 40))) == len(at)


def test_sliced_columns():
    column = pa.array(["zero", None, "two", "", "é"]).slice(1, 3)
    data, offsets = C.text_buffers(column)
    assert data.tobytes() == b"two" and offsets.tolist() == [0, 0, 3, 3]
    assert C.row_sums(np.arange(6.0), np.array([0, 2, 2, 6])).tolist() == [1, 0, 14]
