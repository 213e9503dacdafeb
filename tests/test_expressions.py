import sqlite3

import pytest

from test_search import DOCS
from tessera.operators import expressions as E
from tessera.operators.search import build_index


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(DOCS, "doc_id long, text string, heading string"), ["doc_id"], {"text": 1.0, "heading": 2.0})


@pytest.mark.parametrize("text", [
    "genome AND reads", "genome OR counting", "reads NOT mapping", "(genome OR nothing) AND reads", '"mapping reads"', "assem*", "heading:genome", "heading:map* OR see", "NEAR(genome mapped, 3)", "NEAR(genome reads, 1)",
    'genome AND "k mer" OR other', "reads genome", "genome NOT reads NOT joins", '"of the gen" *',
])
def test_equal_sqlite(index, text):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, heading, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, text, heading) VALUES (?, ?, ?)", DOCS)
    want = dict(con.execute("SELECT rowid, bm25(t, 1.0, 2.0) FROM t WHERE t MATCH ?", (text,)).fetchall())
    got = {r.doc_id: r.score for r in E.search(index, text).collect()}
    assert got.keys() == want.keys()
    if "NOT" not in text and "NEAR" not in text:
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("text", ["(a", "a AND", "OR b", "a )"])
def test_errors(text):
    with pytest.raises(ValueError):
        E.parse(text)
