"""Every query with SQL must give the same rows as DuckDB, and a changed result must be noticed."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(v, 9) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return sorted(repr([plain(r[i]) for i in order]) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert rows_of(df.collect(), df.columns) == rows_of(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["doc_quality", "text_quality_histogram"])
def test_quality_of_odd_texts(spark, tmp_path, name):
    texts = [None, "", "a" * 110 + "." * 90, "a" * 109 + "." * 91, "a" * 451 + "." * 369, "a" * 130 + "." * 70, "x (cid:1) " * 40, "a" * 200 + "\ufffd" * 20, "\u00e9\U0001d400" * 200, "a\nb\x00" * 60]
    rows = [(i, x, "en" if i % 2 else None) for i, x in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, cursor = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.SQL[name])
    assert rows_of(df.collect(), df.columns) == rows_of(cursor.fetchall(), [c[0] for c in cursor.description])


ODD = [
    None, "", "the", "THE der", "other there lathe", "other\nthe\n", "the\n", "\u00e9the and\u00e9", "\U0001d400the\U0001d400", "x_the_y -der- et.", "thethe the1 1the", "thethe the", "und\x00", "le le", "licence, Lizenz", "license\r\n",
    "unlicensed licenses", "et al; AND", "(und)et[le]", "the der le and und et license licence lizenz",
]


@pytest.mark.parametrize("name", ["synonym_expansion_pairs", "whole_word_mentions"])
def test_whole_words_of_odd_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, cursor = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.SQL[name])
    assert rows_of(df.collect(), df.columns) == rows_of(cursor.fetchall(), [c[0] for c in cursor.description])


def test_nine_names_take_less_than_one_pattern_that_begins_anywhere(spark, tmp_path):
    text = "wither undern landy etler licenses " * 30000
    spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def seconds(df):
        took = []
        for _ in range(3):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    one = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.lower("text").rlike("(?:^|[^A-Za-z0-9])the(?:[^A-Za-z0-9]|$)"))
    assert seconds(catalog.QUERIES["synonym_expansion_pairs"](spark, str(tmp_path))) < 2 * seconds(one)  # was nine times and more


def test_a_changed_result_is_noticed(spark, duck, sf_dir):
    df = catalog.QUERIES["doc_quality"](spark, sf_dir).selectExpr("doc_id", "n_chars + 1 as n_chars", "n_alnum", "text_quality")
    cursor = duck.execute(catalog.SQL["doc_quality"])
    assert rows_of(df.collect(), df.columns) != rows_of(cursor.fetchall(), [c[0] for c in cursor.description])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n[:2] == 'op' and n[2].isdigit() for n in e.queries()), len(e.queries()) > 50)"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == ["0", "True"], out.stderr
