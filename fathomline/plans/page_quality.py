"""Queries of page quality. Lines of documents are pages of 600 by 800; what is measured on them follows a stated rule by document.

In documents 4n the output is right, in 4n + 1 there is none, in 4n + 2 pages are scans with a hidden text behind the image and recognised text
of some confidence on even pages, in 4n + 3 the output holds each text twice. Characters other than letters, digits and spaces become spaces.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import page_quality as op
from fathomline.plans.validation import WORDS
from fathomline.sources.tables import CHUNKS_SQL, chunks


def measured(spark, sf):
    rows = chunks(spark, sf).select("doc_id", F.col("chunk_index").alias("page"), F.expr(WORDS).alias("t"))
    kind, n = F.col("doc_id") % 4, F.col("page").cast("double")
    scan, even = kind == 2, F.col("page") % 2 == 0
    box = lambda *v: F.struct(*(F.lit(x).cast("double").alias(k) if not hasattr(x, "cast") else x.cast("double").alias(k) for k, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)))
    none = F.array().cast(op.BOXES)
    texts = F.array(box(0, 0, 300, 400), box(150, 200, 450, 600), box(500, 700, 900, 900 + n))  # two that overlap, one over the edge
    return rows.select(
        "doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.when(scan, "").otherwise(F.col("t")).alias("text"), F.when(scan, "").otherwise(F.col("t")).alias("visible_text"), F.when(scan, F.col("t")).alias("hidden_text"),
        F.when(scan, none).otherwise(texts).alias("text_boxes"), F.when(scan, none).otherwise(texts).alias("visible_boxes"), F.when(scan, F.array(box(600, 800, 0, 200))).otherwise(none).alias("image_boxes"), none.alias("vector_boxes"),
        F.when(kind == 0, F.col("t")).when(kind == 3, F.concat("t", F.lit("\n\n"), "t")).when(scan, "![](page.png)").alias("markdown"), F.when(scan & even, F.col("t")).alias("ocr_text"), F.when(scan & even, F.when(F.col("page") % 4 == 0, 0.9).otherwise(0.5)).alias("ocr_confidence"),
    )


RECORDS_SQL = f"""{CHUNKS_SQL}, seen AS (
  SELECT doc_id, chunk_index AS page, doc_id % 4 AS kind, length(regexp_replace(content, '[^A-Za-z0-9]', '', 'g')) AS n FROM chunks
), records AS (
  SELECT doc_id, page, kind, n, kind = 2 AS scanned, CASE WHEN kind = 2 OR n = 0 THEN NULL WHEN kind = 1 THEN 0e0 ELSE 1e0 END AS retention, CASE WHEN kind = 2 OR n = 0 THEN NULL WHEN kind = 0 THEN 1e0 WHEN kind = 1 THEN 0e0 ELSE 0.5e0 END AS precision,
    CASE WHEN kind = 2 THEN page % 2 = 1 OR n < 20 ELSE n > 0 AND kind <> 0 END AS ocr_required, CASE WHEN kind = 2 THEN page % 2 = 0 AND n >= 20 ELSE n = 0 OR kind = 0 END AS content_covered FROM seen
)"""


@query(
    "page_records",
    f"""WITH {RECORDS_SQL} SELECT doc_id, page, scanned, retention, precision, ocr_required, content_covered, CASE WHEN kind = 2 THEN 0e0 ELSE round((300 * 400 + 300 * 400 - 150 * 200 + 100 * 100) / 480000e0, 6) END AS text_area_ratio, CASE WHEN kind = 2 THEN 0.75e0 ELSE 0e0 END AS image_coverage_ratio,
  list_filter([CASE WHEN kind = 1 THEN 'MARKDOWN_SECTION_MISSING' END, CASE WHEN kind = 2 OR n > 0 AND kind IN (1, 3) THEN 'TEXT_INSUFFICIENT' END, CASE WHEN kind = 1 AND n > 0 THEN 'TEXT_RETENTION_LOW' END, CASE WHEN kind IN (1, 3) AND n > 0 THEN 'TEXT_PRECISION_LOW' END,
    CASE WHEN kind = 2 THEN 'IMAGE_ONLY' END, CASE WHEN kind = 2 AND n > 0 THEN 'HIDDEN_TEXT_LAYER' END, CASE WHEN kind = 2 AND page % 2 = 0 AND n < 20 THEN 'OCR_TEXT_INSUFFICIENT' END, CASE WHEN kind = 2 AND page % 4 = 2 THEN 'OCR_LOW_CONFIDENCE' END, CASE WHEN ocr_required THEN 'OCR_REQUIRED' END], lambda x: x IS NOT NULL) AS warnings FROM records""",
)
def page_records(spark, sf):
    """The quality record of every page."""
    return op.records(measured(spark, sf)).select("doc_id", "page", "scanned", "retention", "precision", "ocr_required", "content_covered", "text_area_ratio", "image_coverage_ratio", "warnings")


@query("scan_reports", f"WITH {RECORDS_SQL} SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE scanned OR n > 0) AS substantive, list_sort(coalesce(list(page) FILTER (WHERE scanned), [])) AS scanned_pages, list_sort(coalesce(list(page) FILTER (WHERE NOT scanned AND n = 0), [])) AS blank_pages, CASE WHEN bool_or(scanned) THEN 1e0 ELSE 0e0 END AS ratio, bool_or(scanned) AS is_scan FROM records GROUP BY doc_id")
def scan_reports(spark, sf):
    """Which documents are scans."""
    return op.scan_reports(op.records(measured(spark, sf)))


@query("scan_coverage", f"WITH {RECORDS_SQL} SELECT doc_id, count(*) FILTER (WHERE scanned) AS scans, count(*) FILTER (WHERE scanned AND page % 2 = 0) AS covered, CASE WHEN bool_or(scanned) THEN count(*) FILTER (WHERE scanned AND page % 2 = 0) / count(*) ELSE 1e0 END AS coverage, list_sort(coalesce(list(page) FILTER (WHERE scanned AND page % 2 = 1), [])) AS missing FROM records GROUP BY doc_id")
def scan_coverage(spark, sf):
    """The share of each document's scanned pages that have recognised text."""
    pages = measured(spark, sf)
    return op.scan_coverage(op.records(pages).where("scanned"), pages.where("ocr_text is not null"), pages)
