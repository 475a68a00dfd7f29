"""Queries that hold pages of an output against pages of their source.

Documents have neither tables nor formulas, so that pages get them by a stated rule: of every six lines, the first stands in a
table, the third under an image and the fifth beside a formula; the source knows what is there, the output loses some of it
by document. Every line of every document takes part; its characters other than letters, digits and spaces become spaces.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.functions import text as texts
from fathomline.operators import validation as op
from fathomline.sources.tables import CHUNKS_SQL, chunks, table

WORDS = "regexp_replace(content, '[^A-Za-z0-9 ]', ' ')"
#: A line in the output: tables are flattened in documents 5n + 1 and changed in 5n + 2, images lost in 5n + 3, formulas changed in 5n + 4 and lost in 7n.
OUTPUT = f"""CASE i % 6 WHEN 0 THEN CASE doc_id % 5 WHEN 1 THEN concat('k v ', i, ' ', {WORDS}) ELSE concat('| k | v |\\n|---|---|\\n| ', i + CAST(doc_id % 5 = 2 AS INT), ' | ', {WORDS}, ' |') END
WHEN 2 THEN CASE doc_id % 5 WHEN 3 THEN {WORDS} ELSE concat('![seen](img/', i, '.png)\\n\\n', {WORDS}) END
WHEN 4 THEN CASE WHEN doc_id % 7 = 0 THEN {WORDS} WHEN doc_id % 5 = 4 THEN concat('$$E_{{', i, '}} = A_i + 0.5$$\\n\\n', {WORDS}) ELSE concat('$$\\\\displaystyle E_{{', i, '}} = A_i \\\\times 0.5$$\\n\\n', {WORDS}) END
ELSE {WORDS} END"""


def lines(spark, sf):
    return chunks(spark, sf).select("doc_id", F.expr("cast(chunk_index div 6 + 1 as int)").alias("page"), F.col("chunk_index").alias("i"), "content")


def output_pages(spark, sf):
    line = lines(spark, sf).select("doc_id", "page", F.struct("i", F.expr(OUTPUT).alias("t")).alias("l"))
    return line.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["t"]), "\n\n").alias("markdown"))  # the six lines of a page


def source_pages(spark, sf):
    spoken, i, kind = F.regexp_replace(F.expr(WORDS), "\\s+", ""), F.col("i").cast("string"), F.col("i") % 6
    line = lines(spark, sf).select(
        "doc_id", "page", F.when(kind == 0, F.array(F.array(F.lit("k"), F.lit("v")), F.array(i, spoken))).alias("matrix"), (kind == 2).alias("image"),
        F.when(kind == 4, op.signature(F.concat(F.lit("E_{"), i, F.lit("} = A_i × 0.5")))).alias("formula"),
    )
    pages = line.groupBy("doc_id", "page").agg(
        F.count("matrix").cast("int").alias("tables"), F.count_if("image").cast("int").alias("images"), F.count("formula").cast("int").alias("formulas"), F.lit(0).alias("hinted"),
        F.collect_list("matrix").alias("matrices"), F.collect_list("formula").alias("signatures"),
    )
    return pages.withColumn("image_share", F.when((F.col("images") > 0) & (F.col("doc_id") % 2 == 0), 0.7).otherwise(0.1))


ISSUES_SQL = f"""{CHUNKS_SQL}, due AS (
  SELECT doc_id, CAST(chunk_index // 6 + 1 AS INTEGER) AS page, bool_or(chunk_index % 6 = 0) AS t, bool_or(chunk_index % 6 = 2) AS p, bool_or(chunk_index % 6 = 4) AS f FROM chunks GROUP BY ALL
), issues AS (
  SELECT doc_id, page, 'table' AS kind, CASE doc_id % 5 WHEN 1 THEN 'TABLE_OUTPUT_MISSING' ELSE 'TABLE_CONTENT_MISMATCH' END AS code, 'BLOCKING' AS severity FROM due WHERE t AND doc_id % 5 IN (1, 2)
  UNION ALL SELECT doc_id, page, 'image', CASE doc_id % 2 WHEN 0 THEN 'HIGH_IMAGE_COVERAGE_OUTPUT_MISSING' ELSE 'IMAGE_OUTPUT_MISSING' END, CASE doc_id % 2 WHEN 0 THEN 'BLOCKING' ELSE 'WARNING' END FROM due WHERE p AND doc_id % 5 = 3
  UNION ALL SELECT doc_id, page, 'formula', CASE doc_id % 7 WHEN 0 THEN 'FORMULA_OUTPUT_MISSING' ELSE 'FORMULA_TOKEN_MISMATCH' END, 'BLOCKING' FROM due WHERE f AND (doc_id % 7 = 0 OR doc_id % 5 = 4)
)"""


@query("page_validation", f"WITH {ISSUES_SQL} SELECT * FROM issues")
def page_validation(spark, sf):
    """Tables, images and formulas that the output's pages lack or have with other content."""
    return op.page_issues(source_pages(spark, sf), output_pages(spark, sf))


@query(
    "page_verdicts",
    f"""WITH {ISSUES_SQL} SELECT doc_id, count(DISTINCT due.page) AS pages, count(*) FILTER (WHERE severity = 'BLOCKING') AS blocking, count(*) FILTER (WHERE severity = 'WARNING') AS warnings,
  count(*) FILTER (WHERE severity = 'BLOCKING') = 0 AS passed, list_sort(coalesce(list(page) FILTER (WHERE kind = 'table'), [])) AS table_pages, list_sort(coalesce(list(page) FILTER (WHERE kind = 'image'), [])) AS image_pages,
  list_sort(coalesce(list(page) FILTER (WHERE kind = 'formula'), [])) AS formula_pages FROM due LEFT JOIN issues USING (doc_id, page) GROUP BY doc_id""",
)
def page_verdicts(spark, sf):
    """Which documents pass the page validation, and the pages that don't, by kind."""
    source = source_pages(spark, sf)
    return op.document_verdicts(source, op.page_issues(source, output_pages(spark, sf)))


@query("md_signals")
def md_signals(spark, sf):
    """What the Markdown of each whole document shows."""
    found = table(spark, sf, "documents").select("doc_id", op.page_signals(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s.tables").alias("tables"), "s.images", "s.descriptions", F.size("s.formulas").alias("formulas"), F.transform("s.formulas", lambda f: F.array_join(f, " ")).alias("signatures"))


@query(
    "formula_collections",
    f"""WITH {CHUNKS_SQL}, due AS (SELECT doc_id, count(*) AS n FROM chunks WHERE chunk_index % 6 = 4 GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 4 THEN 0 ELSE n END AS matched, n AS wanted, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n END AS given, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 4 THEN 0e0 ELSE 1e0 END AS exactness FROM due""",
)
def formula_collections(spark, sf):
    """The formulas of each document's source against those that its output's pages show, page by page."""
    gold = source_pages(spark, sf).select("doc_id", "page", F.explode("signatures").alias("signature"))
    shown = output_pages(spark, sf).select("doc_id", "page", F.explode(op.page_signals(F.col("markdown"))["formulas"]).alias("signature"))
    return op.exactness(gold, shown, ["doc_id"], ["page", "signature"])


@query(
    "critical_exact",
    f"""WITH {CHUNKS_SQL}, whole AS (
  SELECT doc_id, chunk_index AS page, nfc_normalize(content) AS a, nfc_normalize(replace(content, CASE WHEN doc_id % 3 = 0 THEN '9' ELSE '~~none~~' END, '')) AS b FROM chunks
), gold AS (
  SELECT doc_id, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'number' ELSE 'code' END AS category, token, CASE WHEN page % 2 = 0 THEN page END AS at, count(*) AS w
  FROM (SELECT doc_id, page, unnest(regexp_extract_all(a, '[0-9A-Za-z_]+')) AS token FROM whole) WHERE regexp_matches(token, '[0-9]') GROUP BY ALL
), seen AS (
  SELECT doc_id, page, token, count(*) AS n FROM (SELECT doc_id, page, unnest(regexp_extract_all(b, '[0-9A-Za-z_]+')) AS token FROM whole) GROUP BY ALL
), counted AS (
  SELECT g.doc_id, g.category, g.w, coalesce((SELECT sum(n) FROM seen s WHERE s.doc_id = g.doc_id AND s.token = g.token AND (g.at IS NULL OR g.at = s.page)), 0) AS g FROM gold g
)
SELECT doc_id, category, CAST(sum(least(w, g)) AS BIGINT) AS matched, CAST(sum(w) AS BIGINT) AS wanted, CAST(sum(g) AS BIGINT) AS given, sum(least(w, g)) / greatest(sum(w), sum(g), 1) AS exactness FROM counted GROUP BY doc_id, category""",
)
def critical_exact(spark, sf):
    """Numbers and codes of every line, by line on even lines and in the whole document else, in an output that loses each 9 of every third document."""
    rows = chunks(spark, sf).select("doc_id", F.col("chunk_index").alias("page"), "content")
    word = F.explode(F.filter(F.regexp_extract_all(texts.series(texts.composed)("string")("content"), F.lit("[0-9A-Za-z_]+"), 0), lambda w: w.rlike("[0-9]")))
    gold = rows.select("doc_id", word.alias("value"), F.when(F.col("page") % 2 == 0, F.col("page")).alias("page"))
    gold = gold.withColumn("category", F.when(F.col("value").rlike("^[0-9]+$"), "number").otherwise("code"))
    less = F.when(F.col("doc_id") % 3 == 0, F.replace("content", F.lit("9"), F.lit(""))).otherwise(F.col("content"))
    return op.critical_tokens(gold, rows.select("doc_id", "page", less.alias("text")))


@query(
    "undescribed_images",
    f"""WITH {CHUNKS_SQL}, seen AS (
  SELECT doc_id, chunk_id, length(regexp_replace(content, '[\\s\\p{{Z}}]+', '', 'g')) >= 8 AND NOT (chunk_index % 4 = 1) AS told FROM chunks WHERE chunk_index % 3 = 1
) SELECT doc_id, count(*) AS images, list_sort(coalesce(list(chunk_id) FILTER (WHERE NOT told), [])) AS undescribed FROM seen GROUP BY doc_id""",
)
def undescribed_images(spark, sf):
    """Every third line as an image's chunk, whose text says that there is no description on every fourth line."""
    silent = F.col("chunk_index") % 4 == 1
    image = F.concat(F.lit("![x](i.png)"), F.when(silent, F.lit("image description missing")).otherwise(F.col("content")))
    rows = chunks(spark, sf).where("chunk_index % 3 = 1").select("doc_id", "chunk_id", image.alias("text"), F.lit(None).cast("string").alias("alt_text"))
    return op.undescribed_images(rows, ["alt_text", "text"])
