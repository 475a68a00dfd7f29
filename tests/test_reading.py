"""Heading gate and plans, preview boundaries, parents of folders, recovered pages."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import headings, pages, preview, tree


@pytest.mark.parametrize(
    ("line", "is_one"),
    [("1.2 Scope", True), ("1 Scope", False), ("1.2", False), ("3", False), ("第三章 总则", True), ("第5条 适用", True), ("一、范围", True), ("（二）方法", True), ("3）步骤", False), ("附录 A", True), ("概述", True), ("plain", False), ("", False), ("1.2 " + "x" * 40, False)],
)
def test_clues(spark, line, is_one):
    assert spark.range(1).select(headings.is_clue(F.lit(line))).first()[0] is is_one


def gated(spark, elements, tokens):
    rows = spark.createDataFrame(elements, "doc_id long, kind string, level int, body string")
    return {r.doc_id: (r.reason, r.runs) for r in headings.gate(rows, spark.createDataFrame(tokens, "doc_id long, total_tokens long")).collect()}


def test_gate(spark):
    h = lambda d, n, level: [(d, "heading", level, f"{'#' * level} part")] * n
    elements = [(1, "paragraph", 0, "x"), (2, "paragraph", None, None), *h(3, 5, 1), (3, "paragraph", 0, "a\n 1.2 Scope \nb"), *h(4, 5, 2), *h(5, 4, 1), *h(6, 1, 1), *h(6, 1, 3), *h(7, 1, 1), *h(7, 1, 3)]
    got = gated(spark, elements, [(1, 512), (2, 511), (3, 10), (4, 10), (5, 99999), (6, 3072), (7, 3071), (8, None)])
    assert got == {
        1: ("no_headings", True), 2: ("too_short_without_headings", False), 3: ("flat_heading_levels", True), 4: ("flat_without_hierarchy_clues", False), 5: ("healthy_heading_tree", False),
        6: ("sparse_heading_tree", True), 7: ("healthy_heading_tree", False), 8: ("too_short_without_headings", False),
    }
    assert gated(spark, [], []) == {}


def test_places_and_plans(spark):
    from fathomline.operators import chunking

    docs = spark.createDataFrame([(1, "---\nt: 1\n---\nfirst\n\n```\n# no\n```\nlast"), (2, "only"), (3, None), (4, "")], "doc_id long, text string")
    places = headings.insert_positions(docs, chunking.elements(docs))
    assert sorted((r.doc_id, r.line, r.kind, r.preview) for r in places.collect() if r.doc_id == 1) == [(1, 3, "paragraph", "first"), (1, 5, "code_block", "``` # no ```"), (1, 8, "paragraph", "last"), (1, 9, None, "")]
    assert {(r.doc_id, r.line) for r in places.collect()} == {(1, 3), (1, 5), (1, 8), (1, 9), (2, 0), (2, 1), (4, 0), (4, 1)}
    plan = spark.createDataFrame([(1, 3, 1, " A "), (1, 9, 5, "End"), (2, 0, 1, "ok"), (2, 1, 6, "deep"), (4, 0, 2, "T"), (5, 0, 1, "x")], "doc_id long, line int, level int, text string")
    got = {r.doc_id: (r.text, r.inserted) for r in headings.apply_plan(docs, places, plan).collect()}
    assert got == {1: ("---\nt: 1\n---\n# A\n\nfirst\n\n```\n# no\n```\nlast\n##### End", 2), 2: ("only", 0), 3: (None, 0), 4: ("## T\n\n", 1)}
    bad = spark.createDataFrame([(1, 6, 1, "in code"), (1, 5, 0, "x"), (1, 8, 1, "two\nlines"), (1, 9, 1, None), (2, 0, 1, "a"), (2, 0, 2, "b"), (2, 1, None, "c"), (4, 0, 1, "# mark")], "doc_id long, line int, level int, text string")
    found = {(r.doc_id, r.line): r.problem for r in headings.checked_plan(places, bad).collect()}
    assert found == {(1, 6): "no_such_place", (1, 5): "level", (1, 8): "text", (1, 9): "text", (2, 0): "place_taken", (2, 1): "level", (4, 0): "text"}


def mapped(spark, rows):
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_index int, start_line int, end_line int, role string, strategy string, approximate boolean")
    bounds = [(r.doc_id, r.boundary_index, r.chunk_id) for r in preview.boundaries(chunks).collect()]
    return sorted(bounds), {r.doc_id: tuple(r)[1:] for r in preview.preview_maps(chunks).collect()}


def test_preview_maps(spark):
    s = lambda d, i, a, z, role=None, strategy="s", near=None: (d, f"{d}.{i}", i, a, z, role, strategy, near)
    rows = [
        s(1, 0, 0, 4), s(1, 1, 2, 3, " Derived_Element ", None), s(1, 2, 5, 5), s(2, 0, 0, 4), s(2, 1, 4, 6), s(3, 0, 0, 4), s(3, 1, 4, 6, near=True), s(4, 0, 0, 4), s(4, 1, 2, 3, strategy=" "), s(4, 2, 5, 9), s(4, 3, 9, 12),
        s(5, 0, 0, 4), s(5, 0, 5, 6), s(6, 0, 3, 2), s(7, None, 0, 1, strategy=None), s(8, 0, 0, 1, "derived_element"), s(9, 0, 0, 1), s(9, 1, None, 3),
    ]
    bounds, maps = mapped(spark, rows)
    assert bounds == [(1, 0, "1.0"), (1, 1, "1.2"), (3, 0, "3.0"), (3, 1, "3.1"), (4, 0, "4.0"), (4, 1, "4.2")]
    assert maps == {
        1: ("line", True, False, 2, 1), 2: ("line", False, True, 0, 0), 3: ("approximate_line", False, False, 2, 0), 4: ("legacy_line", False, True, 2, 2), 5: ("line", False, True, 0, 0), 6: ("line", False, True, 0, 0),
        7: ("legacy_line", False, True, 0, 1), 8: ("line", False, True, 0, 1), 9: ("line", False, True, 0, 0),
    }
    assert mapped(spark, []) == ([], {})


def test_parents(spark):
    folders = spark.createDataFrame([(1, 1, 1, None), (1, 1, 2, 1), (1, 1, 3, 2), (1, 1, 4, 99), (1, 1, 5, 4), (2, 1, 6, None), (1, 1, 7, 6), (1, 1, 8, 9), (1, 1, 9, 8)], "dataset int, owner int, folder long, parent long")
    moves = [(1, 1, 1, 3, 1), (2, 1, 1, 1, 3), (3, 1, 1, 2, 2), (4, 1, 1, 2, 6), (5, 2, 1, None, 6), (6, 1, 2, None, 1), (7, 1, 1, None, 5), (8, 1, 1, 2, 7), (9, 1, 1, None, 9), (10, 1, 1, 3, None), (11, 1, 1, 4, 5), (12, 1, 1, None, 50)]
    got = tree.parent_problems(folders, spark.createDataFrame(moves, "move int, dataset int, owner int, folder long, parent long"))
    assert {r.move: r.problem for r in got.collect()} == {
        1: None, 2: "cycle", 3: "self", 4: "not_found", 5: None, 6: "not_found", 7: "dangling", 8: "dangling", 9: "cycle", 10: None, 11: "cycle", 12: "not_found",
    }


def test_recovered_pages(spark):
    own = spark.createDataFrame([(1, 1, " one "), (1, 2, None), (1, 3, "three holds it"), (1, 4, ""), (2, 1, "x"), (3, 1, "a")], "doc_id long, page int, markdown string")
    more = spark.createDataFrame([(1, 1, "ocr", " two\n"), (1, 2, "Vision", "a chart"), (1, 3, "ocr", "holds"), (2, 1, "vision", "图片说明：y"), (3, 1, "ocr", "  "), (9, 1, "ocr", "z")], "doc_id long, page int, method string, text string")
    merged = pages.merge_recovered(own, more)
    got = {(r.doc_id, r.page): (r.markdown, r.added) for r in merged.collect()}
    assert got == {
        (1, 1): ("one\n\n<!-- PAGE_FALLBACK:OCR -->\n\ntwo", True), (1, 2): ("<!-- PAGE_FALLBACK:VISION -->\n\n图片说明：a chart", True), (1, 3): ("three holds it", False), (1, 4): ("", None),
        (2, 1): ("x\n\n<!-- PAGE_FALLBACK:VISION -->\n\n图片说明：y", True), (3, 1): ("a", None),
    }
    text = {r.doc_id: r.text for r in pages.joined_pages(merged).collect()}
    assert text[1] == got[1, 1][0] + "\n\n" + got[1, 2][0] + "\n\nthree holds it" and text[3] == "a"


def test_heading_gate_on_odd_lines(spark, tmp_path):
    """Marks, blanks of other widths, line ends of other kinds and Chinese forms: the query is its SQL on every one of them."""
    duckdb = pytest.importorskip("duckdb")
    from fathomline import catalog

    catalog.load()
    odd = ["# 1.2 a", "1.2 a #", "1.2 a b", "1.2 a\u0085b", "1.2 a\rb", "　1.2 a", "1.2 " + "x" * 36 + " ", "1.2　a", "1．2 a", "第三章 总则", "第一条 a", "第5条 a", "(一) a", "（一）\x0b", "一、 ", "附录 A", "概述", "1.2 　", "\t1.2 a", "1.2 a\t", " ", "3) a", "1.2.3.4.5.6 a"]
    texts = [(d * 4 + k, "\n".join(["plain"] * (d % 3) + [line] + ["plain"] * 20), "en", "src1", 1) for d, line in enumerate(odd) for k in range(4)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(catalog.ORACLES["heading_gate"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["heading_gate"](spark, str(tmp_path)).collect())) == sorted(want)
