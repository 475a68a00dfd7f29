"""Tables of cells: golden texts of merged headers, and shapes of nested tables."""

import pytest

from fathomline.operators import grid


def texts(spark, *sources):
    pages = spark.createDataFrame(list(enumerate(sources)), "doc_id long, text string")
    return {(r.doc_id, r.table_id): r for r in grid.retrieval_texts(grid.html_cells(pages)).collect()}


def test_plain_and_merged_headers(spark):
    plain = "<table><tr><td>字段</td><td>说明</td></tr><tr><td>name</td><td>名称</td></tr></table>"
    merged = '<table><thead><tr><th rowspan="2">部门</th><th colspan="2">预算</th></tr><tr><th>人力</th><th>设备</th></tr></thead><tbody><tr><td>研发部</td><td>100 万</td><td>30 万</td></tr></tbody></table>'
    got = texts(spark, plain, merged)
    assert not got[0, "table-001"].complex and got[0, "table-001"].text == "表头：\n- 字段\n- 说明\n数据：\n- 行1：字段：name | 说明：名称"
    r = got[1, "table-001"]
    assert r.reasons == ["colspan", "multi_header", "rowspan"] and r.header_rows == 2
    assert r.text == "表头：\n- 部门\n- 预算：人力、设备\n数据：\n- 行1：部门：研发部 | 人力：100 万 | 设备：30 万"


def test_nested_tables_links_and_images(spark):
    got = texts(spark, "<table><tr><td>类型</td><td>内容</td></tr><tr><td>组合</td><td>see <a href='u'>it</a><img src='i.png'><table><tr><td>子项</td></tr></table></td></tr></table><table><tr><td>b</td></tr></table>")
    assert sorted(got) == [(0, "table-001"), (0, "table-001-001"), (0, "table-002")]
    assert got[0, "table-001"].reasons == ["image_cell", "link_cell", "nested_table"]
    assert got[0, "table-001"].text.endswith("- 行1：类型：组合 | 内容：see it；![表格图片1](i.png)；链接：[it](u)；嵌套表格：table-001-001")
    assert got[0, "table-001-001"].text == "表头：\n- 子项\n内容：子项"


def test_names_are_the_shortest_ends_that_differ(spark):
    head = "<tr><th colspan=4>Report</th></tr><tr><th colspan=2>2023</th><th colspan=2>2024</th></tr><tr><th>in</th><th>out</th><th>in</th><th>x</th></tr>"
    got = texts(spark, f"<table>{head}<tr><td>1</td><td>2</td><td rowspan=2>3</td><td>a | b</td></tr><tr><td colspan=2>5</td><td></td></tr></table>")[0, "table-001"]
    assert got.title == "Report"
    assert got.text == "表格：Report\n表头：\n- 2023：in、out\n- 2024：in、x\n数据：\n- 行1：2023/in：1 | out：2 | 2024/in：3 | x：a \\| b\n- 行2：2024/in：3 | 2023/in、out：5"
    twice = texts(spark, "<table><tr><th>a</th><th>a</th><th></th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>")[0, "table-001"]
    assert twice.text.endswith("- 行1：a：1 | a(列2)：2 | 列3：3")


def test_awkward_tables(spark):
    assert texts(spark, None, "", "<p>no table</p>", "<table></table>") == {}
    ragged = texts(spark, "<table><tr><td rowspan=3>a</td><td>b</td></tr><tr><td>c<td>d</table>")[0, "table-001"]
    assert (ragged.rows, ragged.columns) == (3, 3)


@pytest.mark.parametrize(("rows", "want"), [
    ([["a <b>b</b>", "![x](u)"], ["１ ％", "&amp;"]], [["ab", "x"], ["1%", "&"]]), ([["a"], ["b", "c"]], None), ([["", " "]], None), ([], None), (None, None),
])
def test_canonical_matrix(spark, rows, want):
    df = spark.createDataFrame([(rows,)], "m array<array<string>>")
    assert df.select(grid.canonical_matrix(df.m).alias("c")).first().c == want
