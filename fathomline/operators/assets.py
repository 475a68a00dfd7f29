"""Images of parsed documents and the verdict on parsed word-processor files, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.reports import errors

# Image classes by the words that name them, first match wins; classes that are shown but never searched.
IMAGE_WORDS = {
    "signature": ["签名", "签字", "签章", "signature"],
    "seal": ["印章", "公章", "盖章", "stamp", "seal"],
    "decorative": ["装饰", "页眉", "页脚", "水印", "logo", "图标", "icon", "background"],
    "system_boundary": ["系统边界", "组织边界", "核算边界", "boundary diagram"],
    "flowchart": ["流程图", "工艺流程", "workflow", "flowchart", "process flow"],
    "chart": ["图表", "柱状图", "折线图", "饼图", "趋势图", "chart", "graph"],
    "photo": ["照片", "现场图", "photo", "photograph"],
}
SHOWN_ONLY = ("signature", "seal", "decorative")
LEAST_DESCRIPTION = 12

#: A page marker, a Markdown image, or an HTML image, in the order of the text.
_EVENT = r"(?is)<!--\s*ODL_PAGE:\d+\s*-->|!\[[^\]]*\]\(\s*(?:<[^>]+>|[^\s)]+)|<img\b[^>]*>"


def image_class(named: Column, file: Column) -> Column:
    """The class whose word comes first in the text about an image, else in its file name, else unknown."""
    out = F.coalesce(*(F.when(F.lower(text).rlike("|".join(words)), kind) for text in (named, file) for kind, words in IMAGE_WORDS.items()))
    return F.coalesce(out, F.lit("unknown"))


def images(documents: DataFrame) -> DataFrame:
    """One row for each image of ``documents`` (doc_id, text): occurrence (from 1), page of the last marker above (else null), source_ref, alt and class."""
    events = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_EVENT), 0)).alias("at", "event"))
    marked = F.regexp_extract("event", r"(?s)^<!--\s*ODL_PAGE:(\d+)", 1).try_cast("int")
    page = F.last(marked, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("at"))
    html = F.lower("event").startswith("<img")

    def attribute(name: str) -> Column:
        found = F.regexp_extract("event", rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
        return F.regexp_replace(found, "^[\"']|[\"']$", "")

    source = F.when(html, attribute("src")).otherwise(F.regexp_replace(F.regexp_extract("event", r"(?s)\]\(\s*(.+)$", 1), "^<|>$", ""))
    alt = F.when(html, attribute("alt")).otherwise(F.regexp_extract("event", r"(?s)^!\[([^\]]*)\]", 1))
    found = events.select("doc_id", "at", "event", page.alias("page"), source.alias("source_ref"), alt.alias("alt"))
    found = found.where(~F.lower("event").startswith("<!--") & (F.col("source_ref") != ""))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return found.select("doc_id", place.alias("occurrence"), "page", "source_ref", "alt", image_class(F.col("alt"), F.col("source_ref")).alias("class"))


def image_policy(found: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``images`` with status, searched and warnings, by their descriptions (doc_id, occurrence, source_page, summary).

    Signatures, seals and decoration need no description and are only shown. Everything else needs one of enough
    characters whose page is the image's; only such images are searched. Unknown images are not taken for decoration.
    """
    both = found.join(descriptions, ["doc_id", "occurrence"], "left")
    shown, described = F.col("class").isin(*SHOWN_ONLY), F.col("summary").isNotNull()
    rules = {
        "MISSING_IMAGE_PAGE_PROVENANCE": F.col("page").isNotNull(),
        "PREVIEW_ONLY_CATEGORY": ~shown,
        "VISUAL_DESCRIPTION_REQUIRED": shown | described,
        "VISUAL_DESCRIPTION_PAGE_MISMATCH": shown | ~described | F.col("page").eqNullSafe(F.col("source_page")) & F.col("page").isNotNull(),
        "VISUAL_DESCRIPTION_TOO_SHORT": shown | ~described | (F.length(F.trim("summary")) >= LEAST_DESCRIPTION),
    }
    warnings = errors(rules)
    bad = F.arrays_overlap(warnings, F.array(F.lit("VISUAL_DESCRIPTION_PAGE_MISMATCH"), F.lit("VISUAL_DESCRIPTION_TOO_SHORT")))
    status = F.when(shown, "NOT_REQUIRED").when(~described, "REQUIRED").when(bad, "INVALID").otherwise("COMPLETE")
    judged = both.withColumns({"status": status, "warnings": warnings})
    return judged.select(*found.columns, "status", (F.col("page").isNotNull() & (F.col("status") == "COMPLETE")).alias("searched"), "warnings")


#: Share of a source's characters that must come out.
LEAST_RETENTION = 0.97


def word_verdict(counters: DataFrame) -> DataFrame:
    """``counters`` of parsed word-processor files with retention, issues and status: every count of the source must come out again.

    Columns: source_chars, output_chars, and (source_*, output_*) of formulas, tables, nested_tables and images,
    table_failures, images_stored. Null counts are 0; a source without text keeps all of it.
    """

    def n(name: str) -> Column:
        return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0))

    ratio = F.when(n("source_chars") > 0, F.least(F.lit(1.0), n("output_chars") / F.nullif(n("source_chars"), F.lit(0)))).otherwise(F.lit(1.0))
    rules = {
        "WORD_TEXT_RETENTION_LOW": ratio >= LEAST_RETENTION,
        "WORD_FORMULA_COUNT_MISMATCH": n("source_formulas") == n("output_formulas"),
        "WORD_TABLE_COUNT_MISMATCH": n("source_tables") == n("output_tables"),
        "WORD_TABLE_IR_FAILED": n("table_failures") == 0,
        "WORD_NESTED_TABLE_COUNT_MISMATCH": n("source_nested_tables") == n("output_nested_tables"),
        "WORD_IMAGE_COUNT_MISMATCH": n("source_images") == n("output_images"),
        "WORD_IMAGE_ASSETS_NOT_PERSISTED": (n("source_images") == 0) | F.coalesce("images_stored", F.lit(False)),
    }
    judged = counters.withColumn("retention", F.round(ratio, 6)).withColumn("issues", errors(rules))
    return judged.withColumn("status", F.when(F.size("issues") == 0, "PASSED").otherwise("CONTENT_VALIDATION_FAILED"))
