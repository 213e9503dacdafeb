"""BM25, phrases and stems against SQLite's full-text index; filters, over-fetch, caps."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions.udfs import porter
from tessera.operators import search as S

DOCS = [
    (1, "The genome assembler joins reads; assembling is fast.", "Assembly"), (2, "K-mer counting of reads, k-mer by k mer", "Counting"), (3, "", "Empty"),
    (4, "Reads of the genome are mapped. Mapping reads", "Mapping reads"), (5, "Nothing to see here", "Other"), (6, "genome genome genome", "genome"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, heading string")


def sqlite(question, tokenizer, weights):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(text, heading, tokenize='{tokenizer}')")
    con.executemany("INSERT INTO t(rowid, text, heading) VALUES (?, ?, ?)", DOCS)
    return dict(con.execute(f"SELECT rowid, bm25(t, {', '.join(map(str, weights))}) FROM t WHERE t MATCH ?", (" OR ".join(f'"{p}"' for p in question),)).fetchall())


@pytest.mark.parametrize("question", [["genome"], ["reads", "genome"], ["k mer"], ["mapping reads", "reads"], ["genome", "genome"], ["absent"], ["k mer counting", "fast"]])
@pytest.mark.parametrize("stemmed", [False, True])
def test_scores_equal_sqlite(docs, question, stemmed):
    weights = {"text": 1.0, "heading": 2.0}
    index = S.build_index(docs, ["doc_id"], weights, stemmed=stemmed)
    got = {r.doc_id: r.score for r in S.bm25(index, question, stemmed=stemmed).collect()}
    want = sqlite(question, "porter unicode61" if stemmed else "unicode61", weights.values())
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stems_equal_sqlite():
    words = (
        "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky "
        "relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism "
        "decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance "
        "inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective "
        "bowdlerize probate rate cease controll roll yes y by ion flying dying generalizations oscillators archaeology"
    ).split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(w, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t(rowid, w) VALUES (?, ?)", list(enumerate(words, 1)))
    want = {doc: term for term, doc in con.execute("SELECT term, doc FROM v")}
    assert {i: porter(w) for i, w in enumerate(words, 1)} == want


def test_question():
    assert S.compile_question('How is "read mapping" done with v1.2, and by whom? (k-mer)') == ["read mapping", "done", "v1.2", "whom", "k-mer"]
    more = S.expand_question("What is TP for assembly?", {"assembly": ["assembling", "contigs"], "true positive": ["TP"]}, {"TP": "true positive"}, [("contig", "contigs", ["assembly"])])
    assert more[:3] == ["assembling", "contigs", "true positive"] and len({m.lower() for m in more}) == len(more)
    assert S.expand_question("the output", {"true positive": ["TP"]}, {"TP": "true positive"}) == []


def test_overfetch_differs_from_exact(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(20)], "doc_id long, score double")
    payload = spark.createDataFrame([(i, "en" if i >= 6 else "de") for i in range(20)], "doc_id long, document_type string")
    keep = S.Filters(doc_types=["EN"]).paper("doc_id")
    ids = lambda exact: [r.doc_id for r in S.ranked(scores, payload, ["doc_id"], 2, keep, exact).collect()]
    assert ids(True) == [6, 7] and ids(False) == [6, 7]
    payload = payload.withColumn("document_type", F.when(F.col("doc_id") >= 9, "en").otherwise("de"))
    assert [r.doc_id for r in S.ranked(scores, payload, ["doc_id"], 2, keep, False).collect()] == []
    assert [r.doc_id for r in S.ranked(scores, payload, ["doc_id"], 2, keep, True).collect()] == [9, 10]


def test_claim_filters(spark):
    rows = spark.createDataFrame([("a", None, "limitation", True, "BLAST | x"), ("b", 0.9, "mechanism", False, None), ("c", 0.5, "limitation", True, "blast")], "paper_id string, confidence double, claim_type string, is_primary_evidence boolean, methods string")
    pick = lambda **k: [r.paper_id for r in rows.where(S.Filters(**k).claim()).orderBy("paper_id").collect()]
    assert pick(min_confidence=0.5) == ["b", "c"] and pick(claim_types=["Limitation"]) == ["a", "c"] and pick(methods=["blas"]) == ["a", "c"]
    assert pick(primary_only=True, exclude_papers=["a"]) == ["c"] and pick() == ["a", "b", "c"]
    assert S.Filters(years=[2020]).describe() == "years=[2020]" and not S.Filters()


def test_contribution(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2)], "paper_id string, o int")
    b = spark.createDataFrame([("q", 1), ("r", 2), ("q", 3)], "paper_id string, o int")
    got = {r.paper_id: (r.contribution, r.first_place) for r in S.contribution([(3.0, a), (1.0, b)], "paper_id", [F.col("o")]).collect()}
    assert got == {"p": (3.0, 0), "q": (5.0, 1), "r": (1.0, 1)}


def test_papers_are_found_by_words_far_behind(spark, tmp_path):
    from tessera.plans.details import search_papers

    docs = [(1, "word " * 3000 + "license", "en", "a"), (2, "nothing here", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.id for r in search_papers(spark, str(tmp_path)).collect()] == ["1"]
