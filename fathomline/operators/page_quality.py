"""Quality records of pages: how much of a page its text and images cover, how much of its text the output keeps, and what follows.

Pages are rows of measures that any reader of a format may give: doc_id, page, width, height, text, visible_text, hidden_text, text_boxes,
visible_boxes, image_boxes, vector_boxes (arrays of x0, y0, x1, y1), markdown, ocr_text and ocr_confidence; ``ocr_text`` and
``markdown`` are null where there is none. Reading a format isn't part of this.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as fn
from fathomline.functions.geometry import clipped, union_area
from fathomline.functions.signals import effective_text

CORNERS = "x0", "y0", "x1", "y1"
BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
# Characters of a text that counts and of an image's page, share of a page that images cover, share that visible text has on
# a scan at most, confidence of recognised text, share of a text that is kept, share of pages that makes a document a scan.
LEAST_CHARS, IMAGE_CHARS, COVERING, LITTLE_TEXT, CONFIDENCE, KEPT, SCANNED = 20, 8, 0.6, 0.02, 0.8, 0.97, 0.8
IMAGES = (r"!\[[^\]\r\n]*\]\(\s*(?:<[^>\r\n]*>|[^)\r\n]*)\s*\)", r"!\[[^\]\r\n]*\]\s*\[[^\]\r\n]*\]", r"(?i)<img\b[^>]*>")
#: Fixed value: from here a page's Markdown describes its pictures, and isn't held against the page's text.
SUPPLEMENT = r"(?im)^[\t ]*<!--[\t ]*PAGE_FALLBACK:VISION[\t ]*-->[\t ]*(?:\r?\n)+[\t ]*图片说明：(?s:.*)"


def covered(boxes: Column, width: Column, height: Column) -> Column:
    """n (rectangles with a part on the page) and area (covered together)."""

    @F.pandas_udf("n int, area double")
    def measured(lists: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
        rows = []
        for corners, w, h in zip(lists, widths, heights, strict=True):
            each = iter(corners.tolist() if corners is not None else ())
            inside = [c for b in zip(each, each, each, each) if (c := clipped(dict(zip(CORNERS, b, strict=True)), w, h))]
            rows.append((len(inside), union_area(inside)))
        return pd.DataFrame(rows, columns=["n", "area"])

    flat = F.flatten(F.transform(boxes, lambda b: F.array(*(b[c] for c in CORNERS))))  # numbers travel far faster than structs
    return measured(flat, F.coalesce(width, F.lit(0.0)).cast("double"), F.coalesce(height, F.lit(0.0)).cast("double"))


def _best(source: str, given: list[str]) -> tuple[float | None, float | None]:
    """retention and precision of the output that keeps the source best; null where there is no source."""
    if not source:
        return None, None
    given = [t for t in dict.fromkeys(given) if t]
    best = given[fn.best_candidate(source, given)] if len(given) > 1 else given[0] if given else ""
    return fn.fidelity(source, best) if best else (0.0, 0.0)


def page_measures(raster: bool, bare: bool, text: str | None, visible: str | None, hidden: str | None, markdown: str | None, ocr: str | None, body: str | None) -> tuple:
    """Effective characters of text, visible text, hidden text, Markdown and recognised text, and how well ``body`` (Markdown without a
    description of its pictures) and recognised text keep the page's text, on a scan the visible one. Equal texts are folded once."""
    given = text, visible, hidden, markdown, ocr, body
    folded = {t: effective_text(t) for t in set(given)}
    text, visible, hidden, markdown, ocr, body = (folded[t] for t in given)
    source = visible if raster and (bare or hidden or len(visible) <= IMAGE_CHARS) else text
    return (*map(len, (text, visible, hidden, markdown, ocr)), *_best(source, [body, ocr]))


def _measured(raster: Column, bare: Column, *texts: Column) -> Column:
    names = ["text", "visible", "hidden", "markdown", "ocr"]

    @F.pandas_udf(", ".join(f"{n} int" for n in names) + ", retention double, precision double")
    def measured(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_measures(*r) for r in zip(*columns, strict=True)], columns=[*names, "retention", "precision"])

    return measured(raster, bare, *texts)


def records(pages: DataFrame) -> DataFrame:
    """A record of every page: areas and shares, counts of effective characters, retention and precision, flags and ``warnings``.

    A page mostly under images with next to no visible text, or with hidden text behind them, is a scan: only its visible text is held
    against the output, and it needs recognised text. A page without text and images is covered as it is.
    """
    size = F.col("width") * F.col("height")
    share = lambda c: F.when(size > 0, c / size).otherwise(0.0)
    marks = sum((F.regexp_count(F.coalesce("markdown", F.lit("")), F.lit(p)) for p in IMAGES), F.lit(0))
    rows = pages.withColumns({f"_{k}": covered(F.col(f"{k}_boxes"), F.col("width"), F.col("height")) for k in ("text", "visible", "image", "vector")})
    rows = rows.withColumns({
        "text_area_ratio": share(F.col("_text.area")), "visible_text_area_ratio": share(F.col("_visible.area")), "image_coverage_ratio": share(F.col("_image.area")), "vector_coverage_ratio": share(F.col("_vector.area")),
        "image_count": F.col("_image.n"), "vector_count": F.col("_vector.n"), "markdown_images": marks,
    })
    raster = (F.col("image_count") > 0) & (F.col("image_coverage_ratio") >= COVERING)
    bare = raster & (F.col("visible_text_area_ratio") <= LITTLE_TEXT)
    texts = "text", "visible_text", "hidden_text", "markdown", "ocr_text"
    rows = rows.withColumn("_kept", _measured(raster, bare, *map(F.col, texts), F.regexp_replace("markdown", SUPPLEMENT, "")))
    rows = rows.withColumns({f"{n}_chars": F.col(f"_kept.{n}") for n in ("text", "visible", "hidden", "markdown", "ocr")})
    hidden = raster & (F.col("hidden_chars") > 0)
    rows = rows.withColumns({"_hidden": hidden, "_bare": bare, "scanned": raster & ((F.col("visible_chars") <= IMAGE_CHARS) | hidden | bare)})
    read, images = F.col("ocr_text").isNotNull(), (F.col("image_count") > 0) | (F.col("markdown_images") > 0)
    texted = F.when(F.col("scanned"), F.col("visible_chars") > 0).otherwise(F.col("text_chars") > 0)
    lost = texted & F.coalesce(F.col("_kept.retention") < KEPT, F.lit(True))
    added = texted & F.coalesce(F.col("_kept.precision") < KEPT, F.lit(True))
    output_chars, unread = F.greatest("markdown_chars", "ocr_chars"), F.col("ocr_chars") < LEAST_CHARS
    image_only = F.col("scanned") | ((F.col("markdown_images") > 0) & (F.col("markdown_chars") <= IMAGE_CHARS))
    required = (F.col("scanned") & (~read | unread)) | lost | added | (images & (output_chars < LEAST_CHARS))
    unsure = read & F.coalesce(F.col("ocr_confidence") < CONFIDENCE, F.lit(True))
    short = F.col("markdown_chars") < F.least(F.lit(LEAST_CHARS), F.greatest(F.lit(1), F.col("text_chars")))
    says = lambda test, code: F.when(test, F.lit(code))
    warnings = F.array_compact(F.array(
        says(F.col("markdown").isNull(), "MARKDOWN_SECTION_MISSING"), says((images | texted) & (short | lost | added), "TEXT_INSUFFICIENT"), says(lost, "TEXT_RETENTION_LOW"), says(added, "TEXT_PRECISION_LOW"),
        says(image_only, "IMAGE_ONLY"), says(F.col("_hidden"), "HIDDEN_TEXT_LAYER"), says(F.col("_bare") & (F.col("visible_chars") > 0), "RASTER_DOMINANT_LOW_VISIBLE_TEXT_AREA"), says(read & unread, "OCR_TEXT_INSUFFICIENT"),
        says(read & F.col("ocr_confidence").isNull(), "OCR_CONFIDENCE_MISSING"), says(read & F.col("ocr_confidence").isNotNull() & unsure, "OCR_LOW_CONFIDENCE"), says(required, "OCR_REQUIRED"),
    ))
    complete = F.when(texted, ~lost & ~added & (output_chars > 0)).when(images, read & ~unread).otherwise(True)
    level = F.abs(F.col("width") - F.col("height")) <= 0.01
    measures = ["text_area_ratio", "visible_text_area_ratio", "image_coverage_ratio", "vector_coverage_ratio"]
    counts = ["image_count", "vector_count", "markdown_images", "text_chars", "visible_chars", "hidden_chars", "markdown_chars", "ocr_chars"]
    return rows.select(
        "doc_id", "page", F.when(level, "square").when(F.col("width") > F.col("height"), "landscape").otherwise("portrait").alias("orientation"), *(F.round(m, 6).alias(m) for m in measures), *counts,
        F.round("_kept.retention", 6).alias("retention"), F.round("_kept.precision", 6).alias("precision"), "scanned", image_only.alias("image_only"), required.alias("ocr_required"), unsure.alias("low_confidence"), complete.alias("content_covered"), warnings.alias("warnings"),
    )


def scan_reports(page_records: DataFrame, least: float = SCANNED) -> DataFrame:
    """doc_id, pages, substantive, scanned_pages, blank_pages, ratio and is_scan of every document; pages that show nothing don't count."""
    shows = (F.col("image_count") > 0) | (F.col("text_chars") > 0) | (F.col("vector_count") > 0)
    listed = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("page"))))
    found = page_records.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(shows).alias("substantive"), listed(shows & F.col("image_only")).alias("scanned_pages"), listed(~shows).alias("blank_pages"))
    ratio = F.coalesce(F.try_divide(F.size("scanned_pages"), "substantive"), F.lit(0.0))
    return found.withColumns({"ratio": F.round(ratio, 6), "is_scan": (F.col("substantive") > 0) & (ratio >= least)})


def scan_coverage(scans: DataFrame, done: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, scans, covered, coverage and missing (pages) of every document of ``documents``: the pages of ``scans`` that are in ``done``
    (doc_id, page; repeats count once). A document without scans is covered."""
    both = scans.select("doc_id", "page").distinct().join(done.select("doc_id", "page", F.lit(True).alias("_done")).distinct(), ["doc_id", "page"], "left")
    found = both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("scans"), F.count("_done").alias("covered"), F.sort_array(F.collect_list(F.when(F.col("_done").isNull(), F.col("page")))).alias("missing"))
    every = documents.select("doc_id").distinct().join(found, "doc_id", "left")
    kind = found.schema["missing"].dataType
    return every.select("doc_id", F.coalesce("scans", F.lit(0)).alias("scans"), F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce(F.col("covered") / F.col("scans"), F.lit(1.0)).alias("coverage"), F.coalesce("missing", F.array().cast(kind)).alias("missing"))
