import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fingerprints as P
from tessera.llm.queries import op9_fingerprints


def one(text):
    h = P.PrefixHash(P.code_points(text))
    return P.fingerprint(h, P.span_hashes(h))


def expect(rows):
    rows = sorted(((a, b or "") for a, b in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        same = next((k for k, (a, b) in enumerate(zip(text, edited)) if a != b), min(len(text), len(edited)))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), same, text, after, edited))
    return out


def hold(got, rows):
    want = expect(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:4])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.common_edited) for r in got], key=key) == sorted([w[:4] for w in want], key=key)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op9_fingerprints(spark, sf_dir).collect()
    hold(got, docs)
    by = {r.doc_id: r for r in got}
    want = {w[0]: w for w in expect(docs)}
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.65
    texts = dict(docs)
    prints = {}
    for r in got:
        assert prints.setdefault(r.fingerprint, texts[r.doc_id] or "") == (texts[r.doc_id] or "")
        assert r.edited_fingerprint == one(want[r.doc_id][6])
    assert len(by) == len(docs)


def test_odd_rows(spark):
    rows = [(5, "b" * 50), (5, "a" * 50), (None, "x" * 9), (7, None), (8, ""), (9, "é😀" * 300), (9, "é😀" * 300)]
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, fingerprint string")
    for n in (1, 3, 8):
        hold(P.compare_with_edited(docs, n).collect(), rows)
    hold(P.compare_with_edited(docs.limit(1)).collect(), [(r.doc_id, r.text) for r in docs.limit(1).collect()])
    assert P.compare_with_edited(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.integers(0, 20), st.integers(0, 20), st.integers(1, 20))
def test_spans_and_extensions(x, y, i, j, size):
    a, b = P.PrefixHash(P.code_points(x)), P.PrefixHash(P.code_points(y))
    i, j = min(i, len(x)), min(j, len(y))
    inside = i + size <= len(x) and j + size <= len(y)
    assert P.equal_spans(a, i, b, j, size) == (inside and x[i : i + size] == y[j : j + size])
    n = 0
    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
        n += 1
    assert P.common_extension(a, i, b, j) == n
    grown = a.extended(i, P.code_points(y))
    assert grown.span(0, grown.n) == P.PrefixHash(P.code_points(x[:i] + y)).span(0, grown.n)


def test_likeness():
    words = " ".join(str(i * i) for i in range(900))
    other = " ".join(str(i * i * 7 + 1) for i in range(900))
    assert P.likeness(one(words), one(words)) == 1
    assert P.likeness(one(""), one("")) == 1 and P.likeness(one(""), one("a")) == 0
    assert P.likeness(one(words), one(words[:-50] + "x" * 50)) > 0.85
    assert P.likeness(one(words), one(other)) < 0.2


def test_short_texts_keep_a_likeness(spark):
    for n in (4, 8, 12, 15, 16, 20, 24, 40, 63):
        texts = ["".join(chr(0x4E00 + 100 * i + k) for k in range(n)) for i in range(3)]
        texts.append(texts[2][: n - n // 4] + "x" * 200)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in P.compare_with_edited(docs, 1).collect()}
        assert all(0.5 <= got[i].near_edited < 1 for i in range(3)), n
        assert got[0].near_next == 0 and got[2].near_next > 0
