"""Records of pages by hand, areas against counted points, scans and their coverage."""

import random

from fathomline.functions.geometry import clipped, union_area
from fathomline.operators import page_quality as op

SCHEMA = f"doc_id long, page int, width double, height double, text string, visible_text string, hidden_text string, text_boxes {op.BOXES}, visible_boxes {op.BOXES}, image_boxes {op.BOXES}, vector_boxes {op.BOXES}, markdown string, ocr_text string, ocr_confidence double"
LONG = "Twenty letters and more of text"


def test_union_area_counts_each_point_once():
    rng = random.Random(5)
    for _ in range(40):
        boxes = [tuple(float(v) for v in (x, y, x + rng.randint(1, 6), y + rng.randint(1, 6))) for x, y in ((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 6)))]
        points = sum(any(b[0] <= x < b[2] and b[1] <= y < b[3] for b in boxes) for x in range(16) for y in range(16))
        assert union_area(boxes) == points
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), v, strict=True))
    assert clipped(box(9.0, 9.0, -1.0, 2.0), 5, 5) == (0.0, 2.0, 5, 5) and clipped(box(6.0, 0.0, 9.0, 1.0), 5, 5) is None and clipped(box(None, 0.0, 1.0, 1.0), 5, 5) is None and clipped(box(float("nan"), 0.0, 1.0, 1.0), 5, 5) is None


def page(n, text=None, visible=None, hidden=None, image=0.0, markdown=None, ocr=None, confidence=None, area=50.0, size=(10.0, 20.0)):
    boxes = lambda a: [(0.0, 0.0, size[0], a / 10.0)] if a else []
    return (1, n, *size, text, text if visible is None else visible, hidden, boxes(area if text else 0), boxes(area if text else 0), boxes(image), None, markdown, ocr, confidence)


def test_records(spark):
    rows = [
        page(1, LONG, markdown=f"# {LONG}"), page(2, LONG), page(3), page(4, image=150.0, markdown="![x](y)", ocr=LONG, confidence=0.9), page(5, image=150.0, hidden=LONG, markdown=LONG, ocr="short"),
        page(6, LONG, visible=LONG, image=150.0, markdown=LONG, area=2.0, ocr=LONG, confidence=0.1), page(7, LONG, markdown=f"{LONG}\n\n<!-- PAGE_FALLBACK:VISION -->\n\n图片说明：a chart"), page(8, LONG, markdown=f"{LONG} {LONG}", size=(20.0, 10.0)),
        page(9, LONG, image=100.0, markdown=LONG, size=(10.0, 10.0)), page(10, LONG, markdown="other", ocr=LONG, confidence=None),
    ]
    found = op.records(spark.createDataFrame(rows, SCHEMA))
    got = {r.page: r for r in found.collect()}
    assert {n: list(r.warnings) for n, r in got.items()} == {
        1: [], 2: ["MARKDOWN_SECTION_MISSING", "TEXT_INSUFFICIENT", "TEXT_RETENTION_LOW", "TEXT_PRECISION_LOW", "OCR_REQUIRED"], 3: ["MARKDOWN_SECTION_MISSING"], 4: ["TEXT_INSUFFICIENT", "IMAGE_ONLY"],
        5: ["IMAGE_ONLY", "HIDDEN_TEXT_LAYER", "OCR_TEXT_INSUFFICIENT", "OCR_CONFIDENCE_MISSING", "OCR_REQUIRED"], 6: ["IMAGE_ONLY", "RASTER_DOMINANT_LOW_VISIBLE_TEXT_AREA", "OCR_LOW_CONFIDENCE"], 7: [],
        8: ["TEXT_INSUFFICIENT", "TEXT_PRECISION_LOW", "OCR_REQUIRED"], 9: [], 10: ["TEXT_INSUFFICIENT", "OCR_CONFIDENCE_MISSING"],
    }
    assert {n for n, r in got.items() if r.content_covered} == {1, 3, 4, 6, 7, 9, 10} and [n for n, r in sorted(got.items()) if r.scanned] == [4, 5, 6]
    assert (got[8].orientation, got[9].orientation, got[1].orientation) == ("landscape", "square", "portrait") and (got[8].retention, got[8].precision) == (1.0, 0.5) and got[3].retention is None
    report = op.scan_reports(found).first()
    assert (report.pages, report.substantive, report.scanned_pages, report.blank_pages, report.is_scan) == (10, 9, [4, 5, 6], [3], False)
    assert op.scan_reports(found, 0.3).first().is_scan and op.records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scan_coverage(spark):
    schema = "doc_id long, page int"
    scans, done = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 5)], schema), spark.createDataFrame([(1, 2), (1, 2), (1, 9), (3, 1)], schema)
    got = {r.doc_id: tuple(r)[1:] for r in op.scan_coverage(scans, done, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], schema)).collect()}
    assert got == {1: (2, 1, 0.5, [1]), 2: (1, 0, 0.0, [5]), 3: (0, 0, 1.0, [])}


def test_a_long_page_is_measured_as_a_short_one(spark):
    rows = [page(n, "ab" * n, markdown="ab" * (n // 2) + "x" + "ab" * (n // 2)) for n in (20, 1000, 2100, 9000)]
    for r in op.records(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r.retention, r.precision, r.content_covered) == (1.0, round(2 * r.page / (2 * r.page + 1), 6), True)
