"""Further queries of the catalogue: the parts of parsing, identification, checks, ingest and packs, on rows that are made
from the provided tables in the same way by the expression and by the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..operators import context, graph, ingest, mining, nested, report, search, state, structure, validation
from .catalog import _LINES, ASCII, _bm25_sql, query, table

# ---------------------------------------------------------------------------------------------- lines with marks

#: Lines of the documents, some of them turned into captions, numbered or known headings, folios, equations.
_MARKS = {0: "'Table ' || {n} || ': ' || {t}", 1: "'' || {n} || '.2 Results and ' || {t}", 2: "'Materials and Methods:'", 3: "' ' || {n} || ' '", 4: "'y = a' || {n} || ' + b = ' || {n}", 5: "'Fig. ' || {n} || ' ' || {t}", 6: "'xiv'"}
_MARKED = _LINES + ", marked AS (SELECT doc_id, ordinal, char_start, CASE (doc_id + ordinal) % 11 " + " ".join(f"WHEN {k} THEN {v.format(n='ordinal', t='substr(text, 1, 60)')}" for k, v in _MARKS.items()) + " ELSE text END AS text FROM units)"


def marked(spark, sf_dir) -> DataFrame:
    lines = structure.line_units(table(spark, sf_dir, "documents"))
    cases = " ".join(f"WHEN {k} THEN {v.format(n='ordinal', t='substr(text, 1, 60)')}" for k, v in _MARKS.items())
    return lines.withColumn("text", F.expr(f"CASE (doc_id + ordinal) % 11 {cases} ELSE text END"))


@query(rf"WITH {_MARKED} SELECT doc_id, ordinal, text FROM marked WHERE regexp_matches(text, '(?i)^\s*(?:supplementary\s+)?(?:table|tab\.|figure|fig\.?|scheme|algorithm|listing|box|equation|eq\.)\s*(?:s?\d+[a-z]?|[ivxlc]+)(?:[\s.:|)]|$)')")
def captions_among_lines(spark, sf_dir):
    return marked(spark, sf_dir).where(T.is_caption(F.col("text"))).select("doc_id", "ordinal", "text")


@query(rf"""WITH {_MARKED}
SELECT doc_id, ordinal, CAST(least(4, length(n) - length(replace(n, '.', '')) + 1) AS BIGINT) AS level
FROM (SELECT doc_id, ordinal, regexp_extract(text, '^(\d+(?:\.\d+){{0,3}})[.)]?\s+(\S.{{0,110}})$', 1) AS n FROM marked) WHERE n <> ''""")
def numbered_headings_among_lines(spark, sf_dir):
    number = F.regexp_extract("text", T.NUMBERED, 1)
    depth = F.least(F.lit(4), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).cast("long")
    return marked(spark, sf_dir).where(number != "").select("doc_id", "ordinal", depth.alias("level"))


_PROBE = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[:.]+$', ''), '^\s*\d+(?:\.\d+)*[.)]?\s*', ''), '\s+', ' ', 'g')"


@query(f"WITH {_MARKED}, p AS (SELECT doc_id, ordinal, {_PROBE} AS heading FROM marked) SELECT * FROM p WHERE heading IN ({', '.join(repr(s) for s in T.CANONICAL_SECTIONS)})")
def canonical_headings_among_lines(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", "ordinal", T.canonical_heading(F.col("text")).alias("heading")).where("heading is not null")


@query(rf"WITH {_MARKED} SELECT doc_id, ordinal, trim(text) AS label FROM marked WHERE regexp_matches(trim(text), '(?i)^(?:[ivxlcdm]{{1,7}}|\d{{1,5}})$')")
def folios_among_lines(spark, sf_dir):
    return marked(spark, sf_dir).where(F.trim("text").rlike(r"(?i)^(?:[ivxlcdm]{1,7}|\d{1,5})$")).select("doc_id", "ordinal", F.trim("text").alias("label"))


@query(rf"""WITH {_MARKED}, c AS (SELECT doc_id, ordinal, length(text) AS n, length(text) - length(translate(text, '{T.MATH}', '')) AS m, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS l FROM marked)
SELECT doc_id, ordinal FROM c WHERE n BETWEEN 3 AND 220 AND m >= 2 AND m > n * 0.08 AND l < n * 0.6""")
def equations_among_lines(spark, sf_dir):
    return marked(spark, sf_dir).where(T.looks_like_equation(F.col("text"))).select("doc_id", "ordinal")


# ---------------------------------------------------------------------------------------------- identifiers and text

_RAW = """CASE doc_id % 6 WHEN 0 THEN ' https://doi.org/10.' || (1000 + doc_id) || '/Ab.' || doc_id || '. ' WHEN 1 THEN 'DOI: 10.5555/' || doc_id || '),' WHEN 2 THEN 'see arXiv:2101.' || (10000 + doc_id % 9000) || 'v2 there'
WHEN 3 THEN 'PMID: ' || (1000000 + doc_id) || ' and PMC' || (2000000 + doc_id) WHEN 4 THEN 'arxiv hep-th/9901001 ' || source ELSE lang || ' none' END"""


@query(rf"""WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents),
d AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(trim(raw), '(?i)^(?:https?://)?(?:dx\.)?doi\.org/', ''), '(?i)^doi:\s*', ''), '(?i)(10\.\d{{4,9}}/[^\s"''<>,;)\]]+)', 1) AS found FROM r)
SELECT doc_id, CASE WHEN found <> '' THEN lower(regexp_replace(found, '[.,;)\]}}>''"]+$', '')) END AS doi, nullif(regexp_extract(raw, '(?i)arxiv[:/\s]*(\d{{4}}\.\d{{4,5}}(?:v\d+)?|[a-z\-]+/\d{{7}}(?:v\d+)?)', 1), '') AS arxiv,
nullif(regexp_extract(raw, '(?i)PMID[:\s]*(\d{{6,9}})', 1), '') AS pmid, nullif(regexp_extract(raw, '(?i)(PMC\d{{6,9}})', 1), '') AS pmcid FROM d""")
def identifiers(spark, sf_dir):
    raw = F.col("raw")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW).alias("raw"))
    return rows.select("doc_id", T.normalize_doi(raw).alias("doi"), T.arxiv_id(raw).alias("arxiv"), T.pmid(raw).alias("pmid"), T.pmcid(raw).alias("pmcid"))


@query("""SELECT o_orderkey, CASE WHEN k % 5 = 0 AND c >= 0.6 THEN 'doi' WHEN k % 3 = 0 THEN 'arxiv' WHEN k % 2 = 0 THEN 'pmid' WHEN k % 7 = 0 THEN 'pmcid' ELSE 'metadata+content' END AS basis,
CASE WHEN k % 5 = 0 AND c >= 0.6 THEN 'doi:10.1234/x' || k WHEN k % 3 = 0 THEN 'arxiv:2101.0000' || k || 'v1' WHEN k % 2 = 0 THEN 'pmid:' || (100000 + k) WHEN k % 7 = 0 THEN 'pmcid:PMC' || (100000 + k) ELSE 'meta:doe|2020|some title ' || k || '|abcdef' END AS key
FROM (SELECT o_orderkey, o_orderkey AS k, (o_orderkey % 10) / 10.0 AS c FROM orders)""")
def identity_basis(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n, text: F.when(k % n == 0, F.concat(F.lit(text), k.cast("string")))
    number = lambda n, text: F.when(k % n == 0, F.concat(F.lit(text), (k + 100000).cast("string")))
    arxiv = F.concat(some(3, "2101.0000"), F.lit("V1"))
    key = T.identity(some(5, "https://doi.org/10.1234/X"), (k % 10) / 10.0, arxiv, number(2, ""), number(7, "pmc"), F.lit("Doe, Jane"), F.lit(2020), F.concat(F.lit("Some Title: "), k.cast("string")), F.lit("abcdef"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("i")).select("o_orderkey", "i.basis", "i.key")


@query("SELECT p_partkey, coalesce(array_to_string(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE string_split(p_name, ' ') END, ' | '), '') AS text FROM part")
def list_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.joined(F.when(F.col("p_partkey") % 4 != 0, F.split("p_name", " "))).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f KB', n / 1000.0) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1000000.0) ELSE printf('%.1f GB', n / 1000000000.0) END AS size
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_orderkey % 1000 WHEN 1 THEN l_orderkey % 9000 * 100 + 1000 WHEN 2 THEN l_orderkey % 9000 * 100000 + 1000000 ELSE l_orderkey * 100000000 + 1000000000 END AS n FROM lineitem)""")
def human_sizes(spark, sf_dir):
    n = F.expr("CASE l_linenumber % 4 WHEN 0 THEN l_orderkey % 1000 WHEN 1 THEN l_orderkey % 9000 * 100 + 1000 WHEN 2 THEN l_orderkey % 9000 * 100000 + 1000000 ELSE l_orderkey * 100000000 + 1000000000 END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.human_size(n).alias("size"))


@query("SELECT doc_id, strip_accents(t) AS folded FROM (SELECT doc_id, 'Ångström naïve ' || chr(CAST(192 + doc_id % 6 AS INT)) || ' café ' || source AS t FROM documents)")
def folded_text(spark, sf_dir):
    text = F.concat(F.lit("Ångström naïve "), F.expr("element_at(split('À Á Â Ã Ä Å', ' '), CAST(doc_id % 6 AS INT) + 1)"), F.lit(" café "), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", udfs.ascii_fold(text).alias("folded"))


@query(r"""WITH t AS (SELECT doc_id, 'The first sentence ' || doc_id || ' is here. See Fig. 2 of Smith et al. in it! Short. And ' || source || ' was really the last one?' AS t FROM documents)
SELECT doc_id, unnest([0, length(t) - length('See Fig. 2 of Smith et al. in it! Short. And ' || substr(t, instr(t, 'And ') + 4)), instr(t, 'Short.') - 1]) AS a FROM t""")
def sentence_starts(spark, sf_dir):
    text = F.concat(F.lit("The first sentence "), F.col("doc_id").cast("string"), F.lit(" is here. See Fig. 2 of Smith et al. in it! Short. And "), F.col("source"), F.lit(" was really the last one?"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(udfs.sentence_spans(text)).alias("s"))
    return rows.select("doc_id", F.col("s")[0].cast("long").alias("a"))


# ---------------------------------------------------------------------------------------------- page layout

#: Blocks of pages: a paper for each supplier's orders, pages by order, places from the line's numbers.
_BLOCKS = """blocks AS (SELECT l_suppkey AS paper_id, CAST(l_orderkey % 6 AS INT) AS page_index, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 6 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS "order",
  CAST(l_quantity AS DOUBLE) AS q, l_linenumber AS ln, l_orderkey AS ok, l_partkey AS pk FROM lineitem),
placed AS (SELECT paper_id, page_index, "order", 6 AS n_pages, 1 AS n_lines, 1000.0 AS page_height, q AS y0, q + 10 AS y1, CASE WHEN pk % 5 = 0 THEN 50.0 WHEN pk % 2 = 0 THEN 50.0 ELSE 310.0 END AS x0,
  CASE WHEN pk % 5 = 0 THEN 550.0 WHEN pk % 2 = 0 THEN 290.0 ELSE 550.0 END AS x1, CASE WHEN ln = 1 THEN 'Journal of Examples ' || (ok % 6) WHEN ln = 2 THEN ' ' || (ok % 6 + 11) || ' ' ELSE 'text ' || pk END AS text,
  CAST(8 + ln AS DOUBLE) AS font_size FROM blocks)"""


def placed(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    page = Window.partitionBy("l_suppkey", F.col("l_orderkey") % 6).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("order", F.row_number().over(page).cast("long"))
    return rows.selectExpr(
        "l_suppkey AS paper_id", "CAST(l_orderkey % 6 AS INT) AS page_index", "order", "6 AS n_pages", "1 AS n_lines", "1000.0D AS page_height", "CAST(l_quantity AS DOUBLE) AS y0", "CAST(l_quantity AS DOUBLE) + 10 AS y1",
        "CASE WHEN l_partkey % 5 = 0 THEN 50.0D WHEN l_partkey % 2 = 0 THEN 50.0D ELSE 310.0D END AS x0", "CASE WHEN l_partkey % 5 = 0 THEN 550.0D WHEN l_partkey % 2 = 0 THEN 290.0D ELSE 550.0D END AS x1",
        "CASE WHEN l_linenumber = 1 THEN 'Journal of Examples ' || (l_orderkey % 6) WHEN l_linenumber = 2 THEN ' ' || (l_orderkey % 6 + 11) || ' ' ELSE 'text ' || l_partkey END AS text", "CAST(8 + l_linenumber AS DOUBLE) AS font_size",
    )


@query(rf"""WITH {_BLOCKS}, b AS (SELECT *, CASE WHEN y1 <= page_height * 0.10 THEN 'header' WHEN y0 >= page_height * 0.90 THEN 'footer' END AS band,
  substr(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '\d+', '#', 'g'), 1, 90) AS mask FROM placed),
m AS (SELECT paper_id, band, mask, count(DISTINCT page_index) AS pages FROM b WHERE band IS NOT NULL GROUP BY ALL)
SELECT b.paper_id, b.page_index, b."order", b.band, CASE WHEN b.band IS NOT NULL AND regexp_matches(trim(text), '(?i)^(?:[ivxlcdm]{{1,7}}|\d{{1,5}})$') THEN 'page_number' WHEN pages >= 3 THEN b.band END AS role
FROM b LEFT JOIN m ON b.paper_id = m.paper_id AND b.band = m.band AND b.mask = m.mask""")
def running_heads_by_place(spark, sf_dir):
    return structure.running_heads(placed(spark, sf_dir)).select("paper_id", "page_index", "order", "band", "role")


@query(f"""WITH {_BLOCKS}, p AS (SELECT *, min(x0) OVER w AS l, greatest(1.0, max(x1) OVER w - min(x0) OVER w) AS span FROM placed WINDOW w AS (PARTITION BY paper_id, page_index)),
c AS (SELECT *, x1 - x0 > span * 0.62 AS wide, CASE WHEN (x0 + x1) / 2 < l + span / 2 THEN 0 ELSE 1 END AS col, l + span / 2 AS mid FROM p),
t AS (SELECT *, count(*) FILTER (NOT wide AND col = 0) OVER w >= 2 AND count(*) FILTER (NOT wide AND col = 1) OVER w >= 2
  AND count(*) FILTER (NOT wide AND x0 < mid AND mid < x1) OVER w / greatest(1, count(*) FILTER (NOT wide) OVER w) <= 0.25 AS two FROM c WINDOW w AS (PARTITION BY paper_id, page_index)),
n AS (SELECT *, CASE WHEN two THEN 2 * count(*) FILTER (wide) OVER (PARTITION BY paper_id, page_index ORDER BY round(y0, 1), x0, "order" ROWS UNBOUNDED PRECEDING) - CAST(wide AS INT) ELSE 0 END AS band FROM t)
SELECT paper_id, page_index, "order", row_number() OVER (PARTITION BY paper_id, page_index ORDER BY band, CASE WHEN two AND NOT wide THEN col ELSE 0 END, CASE WHEN two AND NOT wide THEN y0 ELSE round(y0, 1) END, x0, "order") AS rank FROM n""")
def reading_order(spark, sf_dir):
    return structure.reading_order(placed(spark, sf_dir)).select("paper_id", "page_index", "order", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BLOCKS}, w AS (SELECT paper_id, font_size, unnest(range(greatest(1, length(text) // 4))) FROM (SELECT paper_id, font_size, repeat(text, 10) AS t, text FROM placed))
SELECT paper_id, median(font_size) AS body_size FROM w GROUP BY paper_id""")
def body_font_size(spark, sf_dir):
    return structure.body_font_size(placed(spark, sf_dir).withColumns({"text": F.repeat("text", 10), "role": F.lit(None).cast("string")}))


@query(f"""WITH {_BLOCKS}, f AS (SELECT paper_id, page_index, arg_min(trim(text), "order") AS label FROM placed WHERE text LIKE ' %' AND paper_id % 3 > 0 GROUP BY ALL),
o AS (SELECT paper_id, count(*) AS n, count(DISTINCT CAST(label AS INT) - page_index) AS runs, min(CAST(label AS INT) - page_index) AS label_offset FROM f GROUP BY paper_id)
SELECT paper_id, label_offset FROM o WHERE n >= 2 AND runs = 1""")
def page_labels(spark, sf_dir):
    rows = placed(spark, sf_dir).where("paper_id % 3 > 0").withColumn("role", F.when(F.startswith("text", F.lit(" ")), "page_number"))
    return structure.page_labels(rows)


@query(f"WITH {_LINES}, p AS (SELECT doc_id, ordinal % 5 AS page, sum(char_end - char_start) AS n FROM units GROUP BY ALL) SELECT doc_id AS paper_id, 1 - count(*) FILTER (n >= {structure.MIN_PAGE_CHARS}) / 5.0 AS poor_share FROM p GROUP BY doc_id")
def poor_pages(spark, sf_dir):
    units = structure.line_units(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("paper_id"), (F.col("ordinal") % 5).alias("page_index"), "char_start", "char_end")
    return structure.page_quality(units, F.lit(5.0))


@query("SELECT l_suppkey AS paper_id, coalesce(CASE l_linenumber WHEN 1 THEN 'header' WHEN 2 THEN 'body' WHEN 3 THEN 'caption' END, 'unknown') AS role, count(*) AS n FROM lineitem GROUP BY ALL")
def roles_of_blocks(spark, sf_dir):
    role = F.when(F.col("l_linenumber") == 1, "header").when(F.col("l_linenumber") == 2, "body").when(F.col("l_linenumber") == 3, "caption")
    return report.role_histogram(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("paper_id"), role.alias("role")))


# ---------------------------------------------------------------------------------------------- vocabulary and questions

_MADE = "text || CASE doc_id % 4 WHEN 0 THEN ' Principal Component Analysis (PCA) of data-base' WHEN 1 THEN ' a principal component analysis (PCA) database' WHEN 2 THEN ' the Random Forest Models (RFM) data-base' ELSE ' not Any Thing (XYZ) data/base' END"


@query(rf"""WITH d AS (SELECT doc_id, {_MADE} AS t FROM documents),
x AS (SELECT doc_id, unnest(regexp_extract_all(t, '\(([A-Z][A-Za-z0-9\-]{{1,9}}?)s?\)', 1)) AS acronym, unnest(string_split_regex(t, '\([A-Z][A-Za-z0-9\-]{{1,9}}?s?\)')) AS before FROM d),
l AS (SELECT doc_id, acronym, regexp_extract_all(acronym, '[A-Za-z]') AS s, before FROM x WHERE acronym IS NOT NULL),
w AS (SELECT *, regexp_extract_all(substr(before, greatest(1, length(before) - len(s) * 12 - 19)), '[A-Za-z][A-Za-z0-9\-/'']*') AS w FROM l WHERE len(s) >= 2),
e AS (SELECT doc_id, acronym, lower(array_to_string(w[len(w) - len(s) + 1:], ' ')) AS expansion FROM w WHERE len(w) >= len(s)
      AND lower(array_to_string(list_transform(w[len(w) - len(s) + 1:], lambda z: substr(z, 1, 1)), '')) = lower(array_to_string(s, ''))),
c AS (SELECT acronym, expansion, count(DISTINCT doc_id) AS papers, count(*) AS n FROM e WHERE length(expansion) >= 6 AND expansion <> lower(acronym) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY acronym ORDER BY papers DESC, n DESC, expansion) AS k FROM c)
SELECT acronym, expansion, papers, n, papers >= 2 AS confident FROM o WHERE k = 1""")
def acronyms(spark, sf_dir):
    return mining.acronyms(table(spark, sf_dir, "documents").withColumn("text", F.expr(_MADE)), "doc_id", "text")


_WORDS = r"regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\-/'']*')"
_STOPS = ", ".join(repr(w) for w in mining.STOP)


@query(rf"""
WITH d AS (SELECT {_MADE} AS text FROM documents), w AS (SELECT regexp_replace(lower(unnest({_WORDS})), '^[-/'']+|[-/'']+$', '', 'g') AS token FROM d),
n AS (SELECT token, count(*) AS n, regexp_replace(token, '[-/'']', '', 'g') AS key FROM w WHERE length(token) >= 4 AND token NOT IN ({_STOPS}) GROUP BY token),
g AS (SELECT key, list(token ORDER BY n DESC, key DESC, token DESC)[1] AS canonical, list_sort(list(token)) AS forms, CAST(sum(n) AS BIGINT) AS n FROM n WHERE length(key) >= 4 GROUP BY key HAVING count(*) > 1 AND sum(n) >= 3)
SELECT canonical, list_filter(forms, lambda x: x <> canonical) AS aliases, n FROM g""")
def variants_of_words(spark, sf_dir):
    return mining.spelling_variants(table(spark, sf_dir, "documents").withColumn("text", F.expr(_MADE)), "text")


@query("""WITH r AS (SELECT lower(unnest(string_split(p_name, ' '))) AS concept, p_size AS paper_id, p_partkey AS claim_id FROM part)
SELECT concept, list_sort(list(DISTINCT paper_id)) AS papers, list_sort(list(DISTINCT claim_id)) AS claims, count(DISTINCT claim_id) AS n_claims FROM r WHERE trim(concept) <> '' GROUP BY concept""")
def concept_index(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("paper_id"), F.col("p_partkey").alias("claim_id"), F.split(F.upper("p_name"), " ").alias("concepts"))
    return mining.concept_index(rows, "concepts", "paper_id", "claim_id")


_QUESTIONS = ['How does "random forest" compare with k-means under a license?', "What is the difference between C++ and std.io", "PCA or not?", "a I of"]


@query("WITH q(nth, text) AS (VALUES " + ", ".join(f"({k}, {q!r})" for k, q in enumerate(_QUESTIONS)) + r"""),
m AS (SELECT nth, unnest(regexp_extract_all(text, '"[^"]+"|[A-Za-z0-9][A-Za-z0-9_.\-/+]*')) AS w FROM q),
p AS (SELECT nth, CASE WHEN w LIKE '"%' THEN replace(w, '"', '') ELSE trim(w, '.-/+_') END AS phrase, w LIKE '"%' AS quoted FROM m)
SELECT CAST(nth AS BIGINT) AS nth, phrase, count(*) AS n FROM p WHERE quoted OR (length(phrase) >= 2 AND lower(phrase) NOT IN (""" + ", ".join(repr(w) for w in sorted(search.QUERY_STOP)) + ")) GROUP BY nth, phrase")
def question_phrases(spark, sf_dir):
    rows = [(k, p) for k, q in enumerate(_QUESTIONS) for p in search.compile_question(q)]
    return spark.createDataFrame(rows, "nth long, phrase string").groupBy("nth", "phrase").agg(F.count("*").alias("n"))


_SYNONYMS = {"random forest": ["RF", "forest of trees", "rf"], "k-means": ["kmeans", "Lloyd"], "license": ["licence", "Lizenz"]}
_ACRONYMS = {"PCA": "principal component analysis", "SVM": "support vector machine"}
_ASKED = ["random forest and a Licence", "pca of kmeans", "support vector machine", "nothing here"]


def _expansion_sql() -> str:
    asked = ", ".join(f"({k}, {q!r})" for k, q in enumerate(_ASKED))
    groups = ", ".join(f"({g}, {i}, {n!r})" for g, (t, ns) in enumerate(_SYNONYMS.items()) for i, n in enumerate([t, *ns]))
    shorts = ", ".join(f"({len(_SYNONYMS) + g}, {i}, {n!r})" for g, pair in enumerate(_ACRONYMS.items()) for i, n in enumerate(pair))
    said = "regexp_matches(lower(text), '(?:^|[^A-Za-z0-9])' || replace(lower(name), '-', '\\-') || '(?:[^A-Za-z0-9]|$)')"
    return f"""WITH q(nth, text) AS (VALUES {asked}), g(g, i, name) AS (VALUES {groups}, {shorts}), h AS (SELECT nth, g, i, name, {said} AS hit FROM q, g),
    f AS (SELECT nth, g, min(i) AS first FROM h WHERE hit GROUP BY nth, g), a AS (SELECT h.nth, h.g, h.i, h.name FROM h JOIN f ON h.nth = f.nth AND h.g = f.g JOIN g x ON x.g = h.g AND x.i = f.first
      WHERE lower(h.name) <> lower(x.name) AND length(h.name) > 1)
    SELECT CAST(nth AS BIGINT) AS nth, arg_min(name, g * 100 + i) AS name FROM a GROUP BY nth, lower(name)"""


@query(_expansion_sql())
def question_expansion(spark, sf_dir):
    rows = [(k, n) for k, q in enumerate(_ASKED) for n in search.expand_question(q, _SYNONYMS, _ACRONYMS)]
    return spark.createDataFrame(rows, "nth long, name string")


@query("SELECT DISTINCT heading FROM (SELECT p_brand AS heading FROM part UNION ALL SELECT p_type FROM part WHERE p_size < 10)")
def adopted_headings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return mining.adopted(part.select(F.col("p_brand").alias("heading")), part.where("p_size < 10").select(F.col("p_type").alias("heading")))


# ---------------------------------------------------------------------------------------------- search of all kinds

_KINDS = {"units": ("text, heading, section", 10), "claims": ("statement, facets, tags", 10), "papers": ("title, authors, abstract, keywords", 12), "topics": ("name, summary, tags", 5)}
_KIND_ROWS = f"""WITH {_LINES}, rows_units AS (SELECT doc_id || ':' || ordinal AS id, text, '' AS heading, '' AS section FROM units),
rows_claims AS (SELECT conv_id || '#' || turn AS id, text AS statement, role AS facets, '' AS tags FROM conversations),
rows_papers AS (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10))[1] AS title, source AS authors, text AS abstract, lang AS keywords FROM documents),
rows_topics AS (SELECT CAST(item_id AS VARCHAR) AS id, string_split(text, ' ')[1] || ' the ' || string_split(text, ' ')[2] AS name, text AS summary, 'license' AS tags FROM benchmark)"""


def _kind_sql(kind: str) -> str:
    limit = _KINDS[kind][1]
    return f"{_KIND_ROWS}, {_bm25_sql(['license', 'the'], f'rows_{kind}', 'id', search.WEIGHTS[kind])} SELECT '{kind}' AS kind, id, round(score, 6) AS score FROM scored ORDER BY round(score, 9), id LIMIT {limit}"


def _kind_rows(spark, sf_dir, kind: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    blank = F.lit("")
    if kind == "units":
        return structure.line_units(docs).select(F.concat_ws(":", "doc_id", "ordinal").alias("id"), "text", blank.alias("heading"), blank.alias("section"))
    if kind == "claims":
        return table(spark, sf_dir, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("id"), F.col("text").alias("statement"), F.col("role").alias("facets"), blank.alias("tags"))
    if kind == "papers":
        return docs.select(F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("authors"), F.col("text").alias("abstract"), F.col("lang").alias("keywords"))
    word = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat_ws(" the ", word[0], word[1]).alias("name"), F.col("text").alias("summary"), F.lit("license").alias("tags"))


def _kind(spark, sf_dir, kind: str) -> DataFrame:
    """The best rows of a kind: scores are rounded before the limit, so that sums in another order don't change it."""
    rows = _kind_rows(spark, sf_dir, kind)
    index = search.build_index(rows, ["id"], search.WEIGHTS[kind], ASCII)
    scores = search.bm25(index, ["license", "the"], ASCII).withColumn("score", F.round("score", 9))
    best = search.ranked(scores, rows.select("id"), ["id"], _KINDS[kind][1])
    return best.select(F.lit(kind).alias("kind"), "id", F.round("score", 6).alias("score"))


@query(_kind_sql("units"))
def search_units(spark, sf_dir):
    return _kind(spark, sf_dir, "units")


@query(_kind_sql("claims"))
def search_claims(spark, sf_dir):
    return _kind(spark, sf_dir, "claims")


@query(_kind_sql("papers"))
def search_papers(spark, sf_dir):
    return _kind(spark, sf_dir, "papers")


@query(_kind_sql("topics"))
def search_topics(spark, sf_dir):
    return _kind(spark, sf_dir, "topics")


_CLAIMS = """c AS (SELECT c_custkey AS claim_id, c_nationkey AS paper_id, c_acctbal / 10000.0 AS confidence, CASE c_custkey % 3 WHEN 0 THEN 'mechanism' WHEN 1 THEN 'Limitation' ELSE NULL END AS claim_type,
  c_custkey % 4 = 0 AS is_primary_evidence, c_mktsegment AS methods FROM customer)"""


def _claim_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS claim_id", "c_nationkey AS paper_id", "CAST(c_acctbal AS DOUBLE) / 10000.0D AS confidence", "CASE c_custkey % 3 WHEN 0 THEN 'mechanism' WHEN 1 THEN 'Limitation' END AS claim_type", "c_custkey % 4 = 0 AS is_primary_evidence", "c_mktsegment AS methods"
    )


@query(f"WITH {_CLAIMS} SELECT claim_id, paper_id FROM c WHERE coalesce(confidence, 0) >= 0.2 AND lower(claim_type) IN ('limitation', 'mechanism') AND paper_id NOT IN (3, 4) AND (contains(lower(methods), 'auto') OR contains(lower(methods), 'mach'))")
def claim_filter(spark, sf_dir):
    keep = search.Filters(min_confidence=0.2, claim_types=["LIMITATION", "mechanism"], exclude_papers=[3, 4], methods=["Auto", "mach"])
    return _claim_rows(spark, sf_dir).where(keep.claim()).select("claim_id", "paper_id")


@query(f"WITH {_CLAIMS} SELECT claim_id FROM c WHERE is_primary_evidence AND paper_id IN (1, 2, 5)")
def primary_claims(spark, sf_dir):
    return _claim_rows(spark, sf_dir).where(search.Filters(papers=[1, 2, 5], primary_only=True).claim()).select("claim_id")


@query(f"WITH {_CLAIMS}, n AS (SELECT n_nationkey AS paper_id FROM nation WHERE n_regionkey = 1) SELECT claim_id, confidence FROM c WHERE paper_id IN (SELECT paper_id FROM n) ORDER BY confidence DESC NULLS LAST, claim_id LIMIT 50")
def claims_of_papers(spark, sf_dir):
    papers = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("paper_id"))
    return graph.claims_for(_claim_rows(spark, sf_dir), papers, "paper_id", 50).select("claim_id", "confidence")


_BM = _bm25_sql(["the", "and"], "documents", "doc_id", {"text": 1.0})


@query(f"WITH {_BM} SELECT s.doc_id, round(score, 6) AS score FROM scored s JOIN documents d ON s.doc_id = d.doc_id WHERE d.doc_id % 3 <> 0 ORDER BY round(score, 9), s.doc_id LIMIT 15")
def search_active_only(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "tombstoned").otherwise("active").alias("status"))
    scores = search.bm25(search.build_index(docs, ["doc_id"], {"text": 1.0}, ASCII), ["the", "and"], ASCII).withColumn("score", F.round("score", 9))
    return search.ranked(scores, docs.drop("text"), ["doc_id"], 15, active=F.col("status") == "active").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_CLAIMS}, a AS (SELECT claim_id, 0 AS nth, 'negative' AS part FROM c WHERE claim_id % 5 = 0 UNION ALL SELECT claim_id, 1, 'opposing' FROM c WHERE claim_id % 3 = 0)
SELECT claim_id, arg_min(part, nth) AS part FROM a WHERE claim_id % 7 <> 0 GROUP BY claim_id""")
def first_of_lists(spark, sf_dir):
    c = _claim_rows(spark, sf_dir).select("claim_id")
    return graph.first_of_each([c.where("claim_id % 5 = 0").withColumn("part", F.lit("negative")), c.where("claim_id % 3 = 0").withColumn("part", F.lit("opposing"))], "claim_id", c.where("claim_id % 7 = 0"))


@query("""WITH r AS (SELECT l_partkey * 3 AS part, count(*) AS n FROM lineitem GROUP BY 1) SELECT part, n FROM r WHERE part NOT IN (SELECT p_partkey FROM part)""")
def references_to_nothing(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 3).alias("part"))
    return graph.dangling(refs, table(spark, sf_dir, "part"), "part", "p_partkey").groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE starts_with(CAST(c_custkey AS VARCHAR), '0001') OR contains(lower(c_name), '0001')")
def resolve_part_of_title(spark, sf_dir):
    return search.resolve(table(spark, sf_dir, "customer"), " 0001", "c_custkey", "c_name")


# ---------------------------------------------------------------------------------------------- checks, ingest, state

_LOCATORS = r"""loc AS (SELECT doc_id * 1000 + ordinal AS locator_id, doc_id AS paper_id, ordinal AS unit_id, excerpt, char_start + instr(text, excerpt) - 1 AS a
  FROM (SELECT *, substr(text, 4, 60) AS excerpt FROM units) WHERE length(text) > 80 AND NOT regexp_matches(excerpt, '\s\s|^\s|\s$'))"""


def _locators(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    units = structure.line_units(table(spark, sf_dir, "documents")).withColumnsRenamed({"doc_id": "paper_id", "ordinal": "unit_id"})
    rows = units.withColumn("excerpt", F.substring("text", 4, 60)).where((F.length("text") > 80) & ~F.col("excerpt").rlike(r"\s\s|^\s|\s$"))
    at = F.col("char_start") + F.instr("text", F.col("excerpt")) - 1
    return rows.select((F.col("paper_id") * 1000 + F.col("unit_id")).alias("locator_id"), "paper_id", "unit_id", "excerpt", at.alias("a")), units


@query(f"""WITH {_LINES}, {_LOCATORS}, bad AS (SELECT locator_id, paper_id, a % 4 AS k FROM loc)
SELECT CASE k WHEN 1 THEN 'broken_locator' WHEN 2 THEN 'excerpt_mismatch' ELSE 'offset_outside_unit' END AS kind, CAST(locator_id AS VARCHAR) AS id, CAST(paper_id AS VARCHAR) AS detail, count(*) AS n FROM bad WHERE k > 0 GROUP BY ALL""")
def locator_issues(spark, sf_dir):
    rows, units = _locators(spark, sf_dir)
    k, at = F.col("a") % 4, F.when(F.col("a") % 4 != 3, F.col("a"))
    rows = rows.select(
        "locator_id", "paper_id", F.when(k == 1, F.lit(-1)).otherwise(F.col("unit_id")).alias("unit_id"), F.coalesce(at, F.lit(-9)).alias("char_start"),
        (F.col("a") + F.length("excerpt")).alias("char_end"), F.when(k == 2, F.lit("qzqz not there qzqz")).otherwise(F.col("excerpt")).alias("excerpt"),
    )
    drifted = validation.locator_issues(rows, units).where("kind <> 'offset_drift'")
    return drifted.groupBy("kind", "id", "detail").agg(F.count("*").alias("n"))


@query(f"WITH {_LINES}, {_LOCATORS} SELECT locator_id, paper_id, a AS char_start, a + length(excerpt) AS char_end, CAST(0.8 AS DOUBLE) AS confidence FROM loc")
def resolved_locators(spark, sf_dir):
    rows, units = _locators(spark, sf_dir)
    rows = rows.select("locator_id", "paper_id", "unit_id", "excerpt", F.lit(None).cast("double").alias("confidence"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    out = validation.resolve_locators(rows, units, texts)
    return out.select("locator_id", "paper_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "confidence")


@query("""WITH p AS (SELECT c_custkey AS id, 'See [a](f' || c_custkey || '.md#x) and [b](https://x.org/y) or [c](f' || (c_custkey * 2) || '.md "t")' AS text FROM customer)
SELECT id, 'f' || (id * 2) || '.md' AS target FROM p WHERE id * 2 NOT IN (SELECT c_custkey FROM customer)""")
def markdown_links(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    text = F.expr("""'See [a](f' || id || '.md#x) and [b](https://x.org/y) or [c](f' || (id * 2) || '.md "t")'""")
    return validation.link_errors(c.withColumn("text", text), c.select(F.concat(F.lit("f"), "id", F.lit(".md")).alias("path")), "id", "text")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'supports' ELSE 'extends' END AS relation, o_custkey % 5 <> 0 AS known, o_orderkey % 8 = 0 AS explained FROM orders)
SELECT o_orderkey, list_filter([CASE WHEN NOT known THEN 'source_paper_id:unknown' END, CASE WHEN relation = 'contradicts' AND NOT explained THEN 'difference_explanations:required' END], lambda x: x IS NOT NULL) AS errors FROM r""")
def relation_checks(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'supports' ELSE 'extends' END").alias("relation"), F.col("o_custkey").cast("string").alias("source_paper_id"),
        none.alias("target_paper_id"), none.alias("source_claim_id"), none.alias("target_claim_id"), F.when(F.col("o_orderkey") % 8 == 0, F.array(F.lit("why"))).alias("difference_explanations"),
    )
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"), F.when(F.col("c_custkey") % 5 == 0, "tombstoned").otherwise("active").alias("status"))
    return validation.relation_errors(rows, papers, rows.select(F.lit("x").alias("claim_id"))).select("o_orderkey", "errors")


_BODY = """'```json\n[{{"statement": "{0} first of ' || {1} || '", "claim_type": "mechanism", "support": [{{"unit_id": "u1", "excerpt": "e"}}]}}, {{"statement": "' || CASE WHEN {1} % 3 = 0 THEN '' ELSE 'Second: x' END || '", "claim_type": "' || CASE WHEN {1} % 4 = 0 THEN 'guess' ELSE 'limitation' END || '", "support": [{{"unit_id": "u2", "excerpt": "f"}}]}}]\n```'""".format("The", "c_custkey")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 6 <> 1 AS known FROM customer),
x AS (SELECT k, 1 AS ordinal, CASE WHEN known THEN [] ELSE ['paper_id:unknown'] END AS errors FROM c UNION ALL
      SELECT k, 2, list_concat(CASE WHEN known THEN [] ELSE ['paper_id:unknown'] END, list_concat(CASE WHEN k % 3 = 0 THEN ['statement:required'] ELSE [] END, CASE WHEN k % 4 = 0 THEN ['claim_type:enum'] ELSE [] END)) FROM c)
SELECT CAST(k AS VARCHAR) AS paper_id, ordinal, errors, max(len(errors)) OVER (PARTITION BY k) = 0 AS accepted FROM x""")
def ingested_claims(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    responses = c.select(F.col("c_custkey").cast("string").alias("paper_id"), F.expr(_BODY).alias("body"))
    papers = c.select(F.col("c_custkey").cast("string").alias("paper_id"), F.when(F.col("c_custkey") % 6 == 1, "tombstoned").otherwise("active").alias("status"))
    return ingest.claims(responses, papers).select("paper_id", "ordinal", "errors", "accepted")


@query("""WITH t AS (SELECT p_partkey AS response, p_name AS name, [p_size, p_size + 1] AS papers FROM part),
r AS (SELECT response, name, unnest(papers) AS ref FROM t), b AS (SELECT response, list_sort(list('papers:unknown ' || ref)) AS errors FROM r WHERE ref % 10 = 0 GROUP BY response)
SELECT t.response, 't-' || array_to_string(list_filter(string_split(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN (""" + ", ".join(repr(w) for w in T.TITLE_STOP) + """) AND w <> '')[1:5], '-') AS topic_id,
coalesce(errors, []) AS errors, errors IS NULL AS accepted FROM t LEFT JOIN b ON t.response = b.response""")
def ingested_topics(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("response"), F.col("p_name").alias("name"), F.array(F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")).alias("papers"))
    papers = spark.range(0, 100).select(F.col("id").cast("string").alias("paper_id"), F.when(F.col("id") % 10 == 0, "tombstoned").otherwise("active").alias("status"))
    return ingest.topics(rows, papers, "response").select("response", "topic_id", "errors", "accepted")


@query("""WITH t AS (SELECT p_partkey AS topic_id, [p_size, p_size + 1] AS papers FROM part), r AS (SELECT topic_id, unnest(papers) AS p FROM t)
SELECT topic_id, list_sort(list(DISTINCT p) FILTER (p % 7 = 0)) AS stale_papers FROM r GROUP BY topic_id""")
def stale_topics(spark, sf_dir):
    topics = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_id"), F.array("p_size", F.col("p_size") + 1).alias("papers"))
    return ingest.stale_topics(topics, spark.range(0, 200).where("id % 7 <> 0").select(F.col("id").cast("int").alias("paper_id"))).select("topic_id", "stale_papers")


@query("""WITH r AS (SELECT c_nationkey AS id, sha256(CAST(c_custkey % 40 AS VARCHAR)) AS content FROM customer), n AS (SELECT id, count(DISTINCT content) AS n FROM r GROUP BY id)
SELECT CASE WHEN n > 1 THEN r.id || '-' || substr(content, 1, 4) ELSE CAST(r.id AS VARCHAR) END AS id, count(*) AS rows FROM r JOIN n ON r.id = n.id GROUP BY ALL""")
def colliding_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("id"), F.sha2((F.col("c_custkey") % 40).cast("string").cast("binary"), 256).alias("content"))
    return state.distinct_ids(rows, "id", "content").groupBy("id").agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus) AS h FROM orders),
x AS (SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(h, 1, 12)) AS BIGINT)) AS VARCHAR) AS h1, CAST(sum(CAST(('0x' || substr(h, 13, 12)) AS BIGINT)) AS VARCHAR) AS h2 FROM s)
SELECT substr(sha256(concat_ws(chr(31), 'claims', CAST(n AS VARCHAR), h1, h2)), 1, 16) AS fingerprint FROM x""")
def corpus_fingerprint(spark, sf_dir):
    stages = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("claims").alias("stage"), F.col("o_orderstatus").alias("fingerprint"))
    return state.corpus_fingerprint(stages, "claims", "o_orderkey")


@query("""SELECT 'papers' AS what, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'stage ' || o_orderpriority, o_orderstatus, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'issues', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def status_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return nested.status(o.select(F.col("o_orderstatus").alias("status")), o.select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("state")), o.select(F.col("o_orderpriority").alias("kind")))


@query("SELECT DISTINCT p_name AS path FROM part WHERE p_partkey % 2 = 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 3 = 0)")
def staged_not_approved(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return nested.missing_from(part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("path")), part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("path")))


_POINTS = "named_struct('text', o_orderstatus, 'basis', CASE o_orderkey % 3 WHEN 0 THEN 'author_stated' WHEN 1 THEN 'agent_inferred' ELSE 'other' END, 'rationale', CASE WHEN o_orderkey % 2 = 0 THEN 'why' END, 'locators', CASE WHEN o_orderkey % 5 = 0 THEN array('u1') ELSE array() END)"


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'missing_locator' ELSE 'schema_error' END AS kind, CAST(o_orderkey AS VARCHAR) AS id, 'analysis.findings#0' AS detail FROM orders
WHERE (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) OR (o_orderkey % 3 = 1 AND o_orderkey % 2 <> 0)""")
def nested_statements(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.array(F.expr(_POINTS)).alias("findings")).alias("analysis"))
    return nested.statement_issues(rows, "o_orderkey")


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE ['c' || (o_orderkey % 50)] END AS claims, ['p' || (o_orderkey % 30)] AS papers FROM orders)
SELECT 'unsupported_synthesis' AS kind, CAST(k AS VARCHAR) AS id, 'body.agreements' AS detail FROM o WHERE len(claims) = 0
UNION ALL SELECT 'dangling_reference', CAST(k AS VARCHAR), 'body.agreements' FROM o WHERE len(claims) > 0 AND k % 50 >= 40 UNION ALL SELECT 'dangling_reference', CAST(k AS VARCHAR), 'body.agreements' FROM o WHERE k % 30 >= 20""")
def synthesis_checks(spark, sf_dir):
    point = F.expr("named_struct('claim_ids', CASE WHEN o_orderkey % 4 = 0 THEN array() ELSE array('c' || (o_orderkey % 50)) END, 'paper_ids', array('p' || (o_orderkey % 30)))")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.array(point).alias("agreements")).alias("body"))
    claims, papers = spark.range(40).select(F.concat(F.lit("c"), "id").alias("claim_id")), spark.range(20).select(F.concat(F.lit("p"), "id").alias("paper_id"))
    return nested.synthesis_issues(rows, "o_orderkey", claims, papers)


_SPLIT = {"claims": 0.4, "passages": 0.3, "papers": 0.2, "topics": 0.3}


@query("WITH s(section, share) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _SPLIT.items()) + "), t(total) AS (VALUES (1000), (8000), (777)) SELECT CAST(total AS BIGINT) AS total, section, CAST(floor(total * (CAST(share AS DOUBLE) / CAST(1.2 AS DOUBLE))) AS BIGINT) AS tokens FROM s, t")
def budget_shares(spark, sf_dir):
    rows = [(total, k, n) for total in (1000, 8000, 777) for k, n in context.Budget(total, _SPLIT).limits.items()]
    return spark.createDataFrame(rows, "total long, section string, tokens long")


@query("""SELECT l_orderkey, l_linenumber, '- **c' || l_partkey || '** line of ' || l_suppkey || ' (' || l_returnflag || '; ' || l_linestatus || CASE WHEN l_linenumber % 2 = 0 THEN '; confidence ' || printf('%.2f', l_linenumber / 8.0) ELSE '' END || '; when a, b) [x]' AS text
FROM lineitem WHERE l_linenumber = 4""")
def claim_items(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 4").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("claim_id"), F.concat(F.lit("line of "), F.col("l_suppkey").cast("string")).alias("statement"), F.col("l_returnflag").alias("claim_type"), F.col("l_linestatus").alias("polarity"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") / 8.0).alias("confidence"), F.array(F.lit("a"), F.lit("b")).alias("conditions"), F.lit("[x]").alias("cite"),
    )
    return report.claim_block(rows).select("l_orderkey", "l_linenumber", "text")
