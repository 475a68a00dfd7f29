"""Signals of pages and what validation makes of them: small cases by hand, and rows on one side only."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import signals as fn
from fathomline.operators import validation as op


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("<!-- note -->a<script>x</script><img src=y>b", "ab"), ("![i](u)![j][k]\n[k]: http://u\nc", "c"), ("[label](<http://x y>) [other][ref]", "labelother"), ("| a | b |\n|:---|---:|\n| 1 | 2 |", "ab12"),
        ("# T\n> q\n- x\n+ y\n3. z\n* * *\n___\n**w** _v_ a_b", "tqxyzwvab"), ("a &lt; b&nbsp;5 \\times 3 · 2 * 1", "ab5×3×2×1"), ("`code` ~~gone~~ ＡＢ ½ 5％ [视觉]", "codegoneab1⁄25视觉"), ("", ""), (None, ""),
    ],
)
def test_effective_text(text, kept):
    assert fn.effective_text(text) == kept


def test_formula_signatures_tell_content_from_spelling():
    same = fn.formula_signature("E_i=AD_i×EF_i(2)")
    assert same == ["E_i", "=", "AD_i", "×", "EF_i", "(2)"]
    for spelt in (r"E_{i} = AD_i \cdot EF_{i} \tag{2}", r"\left. E_i = AD_i * EF_i \right. （2）", "排放量 E_i=AD_i×EF_i (2) 其中"):
        assert fn.formula_signature(spelt) == same
    for other in (r"E_i=AD_i+EF_i\tag{2}", r"E_i=AD_i\times EF_j\tag{2}", r"e_i=AD_i\times EF_i\tag{2}", r"E=AD_i\times EF_i\tag{2}", r"E_i=AD_i\times EF_i\tag{3}"):
        assert fn.formula_signature(other) != same
    assert fn.formula_signature(None) == fn.formula_signature("") == [] and fn.formula_signature(r"a \le b") == fn.formula_signature(r"a\leq b") == ["a", "≤", "b"]


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (r"$$E=mc^2$$", 1), (r"\[E=mc^2\] and \(x\)", 2), (r"\begin{align*}a&=b\end{align*}", 1), ("<math><mi>x</mi></math>", 1), ("$x_i$ and $y$", 2), ("E = AD * EF", 1), ("x=5", 1),
        ("it costs $5 and $6", 0), ("$12.50$", 0), ("$$ $$", 0), (r"$$E=mc^2", 0), (r"\begin{align}a=b\end{gather}", 0), ("<math>x=1", 0), ('<a href="x=1">', 0), ("```\nx = 1\n```", 0), ("`x = 1`", 0), ("~~~\nx = 1", 0), ("key=value=3", 0), ("[x = 1](u)", 0),
    ],
)
def test_formulas_of_a_page(text, n):
    assert len(fn.signals(text).formulas) == n


def test_tables_of_a_page():
    assert fn.signals("| A | B |\n|---|---|\n| 1 | **2** x |\n\nend").tables == [[["A", "B"], ["1", "**2**x"]]]
    assert fn.signals(r"| A | B |" + "\n|:---:|--- |\n" + r"| a \| b | [c](u) |").tables == [[["A", "B"], [r"a\|b", "c"]]]
    for bad in ("| A | B |\n|---|---|", "| A | B |\n|---|---|\n| 1 |", "| A | B |\n|---|---|\n| - | |", "```\n| A | B |\n|---|---|\n| 1 | 2 |\n```", "|---|---|\n| 1 | 2 |"):
        assert fn.signals(bad).tables == []
    assert fn.signals("<table><tr><th colspan=2>h</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table>").tables == [[["h", ""], ["1", "2"], ["", "3"]]]
    assert fn.signals("<table><tr><th>a</th></tr></table><table><tr><td>1</td></tr><tr><td>1</td><td>2</td></tr></table>").tables == []


def test_images_and_descriptions():
    assert fn.signals("![a](u) ![b]() ![c]( < > ) ![d][known] ![known][] ![e][none]\n[Known]: http://x\n<img src='p'><img alt=q><img src=''>").images == 4
    said = "[视觉描述|src=a.png: 八个字以上的图片说明]\n图片说明：折线图显示排放下降\n> [图片] short\n<figcaption><b>A chart</b> of it</figcaption>"
    assert fn.signals(said).descriptions == 3 and fn.signals(None) == fn.Signals([], 0, 0, [])


def issues(spark, source, output, **kw):
    schema = "doc_id long, page int, tables int, images int, formulas int, hinted int, image_share double, matrices array<array<array<string>>>, signatures array<array<string>>"
    found = op.page_issues(spark.createDataFrame(source, schema), spark.createDataFrame(output, "doc_id long, page int, markdown string"), **kw)
    return sorted((r.doc_id, r.page, r.code, r.severity) for r in found.collect()), found


def test_page_issues(spark):
    table, formula = "| a |b\n|---|---|\n| 1 | 2 |", "$$x=1$$"
    matrix, sign = [["a", "b"], ["1", "2"]], ["x", "=", "1"]
    source = [
        (1, 1, 1, 0, 0, 0, 0.0, [matrix], []), (1, 2, 2, 0, 0, 0, 0.0, [matrix, matrix], []), (1, 3, 2, 0, 0, 0, None, [matrix, matrix], None), (1, 4, 1, 0, 1, 0, 0.0, [matrix], [sign]),
        (2, 1, 0, 3, 0, 0, 0.1, None, None), (2, 2, 0, 60, 0, 0, 0.9, None, None), (2, 3, 0, 0, 0, 0, 0.6, None, None), (2, 4, 0, 2, 0, 0, 0.1, None, None),
        (3, 1, 0, 0, 2, 0, 0.0, None, [sign, sign]), (3, 2, None, None, None, 1, None, None, None), (3, 3, 0, 0, 2, 0, 0.0, None, [sign, sign]), (4, 1, 0, 0, 0, 0, 0.0, [], []), (5, 1, 0, 0, 0, 0, 0.0, [], []),
    ]
    output = [
        (1, 1, "1 2"), (1, 2, table), (1, 3, table + "\n\n" + table.replace("2", "3")), (1, 4, table + "\n\n" + formula), (2, 1, "![a](u)"), (2, 2, "![a](u)"), (2, 3, None), (2, 4, "图片说明：折线图显示排放下降\n![a](u)"),
        (3, 1, formula), (3, 2, "none"), (3, 3, formula + formula.replace("1", "2")), (4, 1, None), (6, 1, "more"),
    ]
    got, rows = issues(spark, source, output)
    assert got == [
        (1, 1, "TABLE_OUTPUT_MISSING", "BLOCKING"), (1, 2, "TABLE_OUTPUT_COUNT_SHORTFALL", "BLOCKING"), (1, 3, "TABLE_CONTENT_MISMATCH", "BLOCKING"), (2, 1, "IMAGE_OUTPUT_COUNT_SHORTFALL", "WARNING"),
        (2, 3, "HIGH_IMAGE_COVERAGE_OUTPUT_MISSING", "BLOCKING"), (3, 1, "FORMULA_OUTPUT_COUNT_SHORTFALL", "BLOCKING"), (3, 2, "HINTED_FORMULA_OUTPUT_MISSING", "WARNING"), (3, 3, "FORMULA_TOKEN_MISMATCH", "BLOCKING"),
        (5, 1, "PAGE_MISSING", "BLOCKING"), (6, 1, "PAGE_UNEXPECTED", "BLOCKING"),
    ]
    schema = "doc_id long, page int"
    verdicts = {r.doc_id: r for r in op.document_verdicts(spark.createDataFrame([x[:2] for x in source], schema), rows).collect()}
    assert {d for d, r in verdicts.items() if r.passed} == {4} and verdicts[1].table_pages == [1, 2, 3] and (verdicts[2].blocking, verdicts[2].warnings, verdicts[2].image_pages) == (1, 1, [1, 3]) and verdicts[6].pages == 0
    softer, _ = issues(spark, source[:1], output[:1], severities={"table": "WARNING"})
    assert softer == [(1, 1, "TABLE_OUTPUT_MISSING", "WARNING")]
    assert issues(spark, [], [])[0] == []


def test_exactness_is_of_multisets(spark):
    schema = "doc_id long, v string"
    got = op.exactness(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (3, "x")], schema), spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, None)], schema), ["doc_id"], ["v"])
    assert {r.doc_id: (r.matched, r.wanted, r.given, r.exactness) for r in got.collect()} == {1: (2, 3, 4, 0.5), 2: (1, 1, 1, 1.0), 3: (0, 1, 0, 0.0)}


def test_critical_tokens(spark):
    gold = [(1, "year", "2024", 1), (1, "year", "2024", 1), (1, "value", "12.5", None), (1, "unit", "tCO2", None), (1, "odd", "a\\E+", None), (1, "none", "", None), (2, "name", "café", None), (3, "x", None, 1)]
    pages = [(1, 1, "2024年 12024 ![2024](2024.png) 2024"), (1, 2, "12.5 and 12.50 and 2024 tCO2e"), (1, 3, "12.5 a\\E+ <img alt=tCO2>"), (2, 1, "café"), (4, 1, "2024")]
    found = op.critical_tokens(spark.createDataFrame(gold, "doc_id long, category string, value string, page int"), spark.createDataFrame(pages, "doc_id long, page int, text string"))
    got = {(r.doc_id, r.category): (r.matched, r.wanted, r.given) for r in found.collect()}
    assert got == {(1, "year"): (2, 2, 2), (1, "value"): (1, 1, 2), (1, "unit"): (0, 1, 0), (1, "odd"): (1, 1, 1), (1, "none"): (0, 1, 0), (2, "name"): (1, 1, 1), (3, "x"): (0, 1, 0)}


def test_described_images(spark):
    rows = [(1, "a", None, "![x](y)"), (1, "b", "a chart of it", None), (1, "c", "暂无图片说明暂无图片说明", "   s h o r t"), (1, "d", None, "<img src=x> eight chars"), (2, "e", "", "")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, alt_text string, text string")
    got = {r.doc_id: (r.images, r.undescribed) for r in op.undescribed_images(chunks, ["alt_text", "text"]).collect()}
    assert got == {1: (4, ["a", "c"]), 2: (1, ["e"])}
    assert op.undescribed_images(chunks.where(F.lit(False)), ["text"]).count() == 0
