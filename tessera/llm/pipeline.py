"""From raw documents to packed training sequences: five stages, each written as Parquet before the next one reads it.

1. language_id: documents whose language is undetermined or rejected go.
2. near_duplicates: one document of each group of five-word-shingle similarity of 0.8 or more stays.
3. repeated_passages: strings of ``PASSAGE_WORDS`` words or more that another document has too are cut from the texts.
4. mixing: documents, repeated or left out, so that the sources' words have their target weights.
5. packing: the documents' tokens in sequences of 1024.

All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, neardup, packing, substrings
from .common import read, remove, shared_dir

#: Passages of over 50 words are repeated text.
PASSAGE_WORDS = 51


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, usable=langid.not_held_out())
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return langid.identify(rows, model, keep_text=False).where(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, size=5, threshold=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs, PASSAGE_WORDS, unit="words", across=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Language identification, MinHash and packing have no equal in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Its folder below the shared one stays, as the result is read from it; those before are removed."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{k}-{name}"
    return docs
