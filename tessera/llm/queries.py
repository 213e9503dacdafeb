"""The thin queries of this subpackage's operators over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = read(spark, sf_dir, "documents")
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    return identify(docs.select("doc_id", "text", held_out), train(docs, usable=fold(F.col("doc_id")) != 0), keep_text=False)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classlm import score, train

    docs = read(spark, sf_dir, "documents")
    model, counts = train(docs.where(fold(F.col("doc_id")) != 1))
    return score(docs, model, counts, keep=[(fold(F.col("doc_id")) == 1).alias("held_out")])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, read(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), size=3, threshold=0.85, percent=(85, 100))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 85 * (n + m - k)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON s.doc_id = l.id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), usable=fold(F.col("doc_id")) != 0)
    return score(docs.select("doc_id", "text", (fold(F.col("doc_id")) == 0).alias("held_out")), model, keep_text=False)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).drop("finish")


OP8_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 't') AS q,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
queues AS (SELECT q, CAST(sum(size) AS BIGINT) AS s FROM docs GROUP BY q),
weighed AS (
  SELECT q, s, 3 * s AS cap, CAST(CASE (row_number() OVER (ORDER BY q) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM queues),
levels AS (
  SELECT *, (CAST(sum(s) OVER () AS DOUBLE) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / w, q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
         / sum(w) OVER (ORDER BY cap / w, q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
free AS (SELECT level FROM levels WHERE w * level < cap ORDER BY cap / w, q LIMIT 1),
goals AS (
  SELECT q, s, least(CAST(cap AS DOUBLE), coalesce(w * (SELECT level FROM free), CAST(cap AS DOUBLE))) AS target FROM levels),
ends AS (
  SELECT d.*, g.s, g.target,
         CAST(sum(size) OVER (PARTITION BY d.q ORDER BY k, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e
  FROM docs d JOIN goals g ON d.q = g.q),
packets AS (
  SELECT r, q, least(64, size - 64 * p) AS words, epoch * s + e - size + least(64 * (p + 1), size) AS upto, target
  FROM (SELECT *, unnest(range((size + 63) // 64)) AS p FROM (SELECT *, unnest([0, 1, 2]) AS epoch FROM ends WHERE size > 0 AND target > 0))),
line AS (
  SELECT r, words, coalesce(CAST(sum(words) OVER (ORDER BY CAST(upto AS DOUBLE) / target, q, upto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM packets),
served AS (
  SELECT r, CAST(sum(greatest(0, least(words, (SELECT CAST(sum(size) AS BIGINT) FROM docs) - before))) AS BIGINT) AS taken FROM line GROUP BY r)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0) AS taken FROM ends LEFT JOIN served ON ends.r = served.r
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_edited

    return compare_with_edited(read(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated

    return repeated(read(spark, sf_dir, "documents"))
