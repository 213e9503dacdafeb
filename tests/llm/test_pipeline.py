import hashlib
import re
from collections import Counter

from test_neardup import brute as near
from test_packing import hold as packed
from tessera.llm import pipeline as P

WORD = r"[^\x20\x09-\x0D]+"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def without_repeats(texts, length=P.PASSAGE_WORDS):
    """What is left of the texts without the windows of ``length`` words that another text has too."""
    split = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    windows = [[tuple(t[a:z] for a, z in w[i : i + length]) for i in range(len(w) - length + 1)] for t, w in zip(texts, split)]
    seen = {}
    for t, own in zip(texts, windows):
        for x in own:
            seen.setdefault(x, set()).add(t)
    out = []
    for t, w, own in zip(texts, split, windows):
        gone = bytearray(len(t))
        for i, x in enumerate(own):
            if len(seen[x]) > 1:
                gone[w[i][0] : w[i + length - 1][1]] = b"\1" * (w[i + length - 1][1] - w[i][0])
        out.append((bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore"), any(gone)))
    return out


def mixed(rows):
    """(source, doc_id, text) of every delivery."""
    rows = [(r, len(re.findall(WORD, r["text"] or ""))) for r in rows]
    size = Counter()
    for r, n in rows:
        size[r["source"]] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 3 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        free -= full
    packets = []
    for s in order:
        at, own = 0, sorted((hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']} {r['text'] or ''}".encode()).hexdigest(), n, i) for i, (r, n) in enumerate(rows) if r["source"] == s)
        for epoch in range(3):
            for _, n, i in own:
                for p in range(0, n, 64):
                    words = min(64, n - p)
                    at += words
                    packets.append((at / target[s] if target[s] else 0, order.index(s), at, words, i, epoch))
    left, got = sum(size.values()), Counter()
    for _, _, _, words, i, epoch in sorted(packets):
        got[i, epoch] += min(words, left)
        left -= min(words, left)
    out = []
    for (i, _), take in got.items():
        r, n = rows[i]
        if take:
            out.append((r["source"], r["text"] if take == n else "".join(re.findall(r"[\x20\x09-\x0D]*" + WORD, r["text"])[:take])))
    return sorted(out, key=str)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "mixing", "packing"]
    stages = [f for _, f in P.STAGES]
    one = stages[0](spark, docs, sf_dir).cache()
    assert one.columns == NAMES and one.count() >= 0.99 * docs.where(docs.text.rlike(r"\p{L}")).count()
    assert one.exceptAll(docs).isEmpty()

    two = stages[1](spark, one, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert two.columns == NAMES
    assert sorted(r.doc_id for r in two.collect()) == [w[0] for w in near(rows, 5, 80, 100) if w[3]]

    three = stages[2](spark, two, sf_dir).cache()
    assert three.columns == NAMES
    before = two.collect()
    want = [(r.doc_id, text, len(text) if cut else r.n_chars) for r, (text, cut) in zip(before, without_repeats([r.text.encode() for r in before])) if not cut or text.strip(" \t\n\v\f\r")]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in three.collect()) == sorted(want)

    four = stages[3](spark, three, sf_dir).cache()
    got = four.collect()
    assert four.columns == NAMES
    assert sorted(((r.source, r.text) for r in got), key=str) == mixed([r.asDict() for r in three.collect()])

    five = stages[4](spark, four, sf_dir).collect()
    used, least = packed(five, [(r.doc_id, r.text) for r in got])
    assert used <= least * 1.02 + 1


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, "The cat and the dog are in the house. " * 9, "en", "a", 5), (2, None, None, None, 0), (3, "", "en", "a", 0), (4, "12 34", "en", "b", 5), (5, "Der Hund und die Katze sind im Haus. " * 9, "de", None, 1), (5, "Der Hund und die Katze sind im Haus. " * 9, "de", None, 1), (None, "Und die Hunde bellen laut in der Nacht.", "de", "a", 2)]
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {5}
    names = docs.columns
    frame = docs
    for _, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == names
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).collect() == []


def test_no_passage_of_51_words_stays(spark):
    letters = [chr(97 + (i * i + i // 7) % 26) for i in range(51)]
    for size in (1, 2, 4):
        passage = " ".join(x * size for x in letters)
        around = [" ".join(hashlib.md5(f"{size} {i} {k}".encode()).hexdigest() for k in range(20)) for i in range(6)]
        rows = [(i, f"{a} {passage} {a[::-1]}" if i < 3 else a, "en", "a", 0) for i, a in enumerate(around)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = {r.doc_id: r for r in P.repeated_passages(spark, docs, "").collect()}
        for i, a in enumerate(around):
            if i >= 3:
                assert got[i].text == a and got[i].n_chars == 0
                continue
            assert got[i].text == f"{a}  {a[::-1]}" and got[i].n_chars == len(got[i].text)
