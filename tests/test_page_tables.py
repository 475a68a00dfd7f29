"""Printed page numbers and tables that go on over pages: golden documents, and tables folded one by one."""

import random
import re

import pytest

from fathomline.operators import pages

LINES = "doc_id long, page int, line int, content string"


def removed(spark, text):
    rows, page = [], None
    for k, line in enumerate(text.split("\n")):
        if m := re.fullmatch(r"<!-- PAGE:(\d+) -->", line):
            page = int(m[1])
        elif page is not None:
            rows.append((1, page, k, line))
    got = pages.page_numbers(spark.createDataFrame(rows, LINES)).where("removed").orderBy("line").collect()
    kept = pages.without_page_numbers(spark.createDataFrame(rows, LINES))
    assert kept.count() == len(rows) and kept.where("content = ''").count() == len(got) + sum(not r[3] for r in rows)
    return [r.content for r in got]


def test_full_forms_and_equal_numbers(spark):
    text = "<!-- PAGE:1 -->\n2024\nbody\n| 页数 | 3 |\n第 1 页 共 3 页\n1\n<!-- PAGE:2 -->\n- 2 -\nbody of two\nmore\n<!-- PAGE:3 -->\nbody\nPage 3 of 3\n"
    assert removed(spark, text) == ["第 1 页 共 3 页", "1", "- 2 -", "Page 3 of 3"]


def test_a_stable_offset_at_the_edge_only(spark):
    assert removed(spark, "<!-- PAGE:1 -->\nfirst page.\n10\n<!-- PAGE:2 -->\nsecond page.\n11\n<!-- PAGE:3 -->\nin the middle\n99\ngoes on\nlast line\n") == ["10", "11"]
    assert removed(spark, "<!-- PAGE:1 -->\nfirst page.\n10\n<!-- PAGE:2 -->\nsecond.\n45\n") == []  # no common offset
    assert removed(spark, "<!-- PAGE:1 -->\nt\n```\n1\n```\n<!-- PAGE:2 -->\n12 Results\nx\ny\nz\n") == []  # code, and a heading with a number


TABLES = "doc_id long, table_id string, place int, first_page int, last_page int, columns int, header array<array<string>>, header_rows int, rows int, title string"


def folded(rows):
    """Chains by the definition: each table against the merged one before it."""

    def plain(t):
        return re.sub(r"\s+", "", t or "").lower()

    def norm(t):
        return re.sub(r"[\W_]+", "", re.sub(r"(?:\(续\)|（续）|续表|表续)$", "", plain(t)))

    out, chain, left = {}, 0, None
    for r in rows:
        doc, _, place, first, last, columns, header, header_rows, n, title = r
        head = [[plain(x) for x in levels] for levels in header]
        tight = re.sub(r"\s+", "", title or "")
        marked = "续表" in tight or "（续）" in tight or tight.endswith("(续)")
        merges = left is not None and left["last"] is not None and first == left["last"] + 1 and columns == left["columns"] != 0 and head == left["head"] and any(any(x) for x in head)
        merges = merges and (marked or bool(norm(title)) and norm(title) == norm(left["title"]))
        if merges:
            out[place] = (chain, left["rows"])
            left.update(last=last, rows=left["rows"] + n - min(n, header_rows), title=left["title"] or title)
        else:
            chain += 1
            out[place] = (chain, 0)
            left = {"last": last, "columns": columns, "head": head, "title": title, "rows": n}
    return out


def test_chains_against_a_fold(spark):
    rng = random.Random(6)
    rows = []
    for doc in range(150):
        page = 1
        for place in range(rng.randint(1, 9)):
            page += rng.choice([1, 1, 1, 1, 0, 2])
            title = rng.choice(["T 1", "T 1", "T1（续）", "续表", None, "", "T 2", "t 1 (续)", "***"])
            header = rng.choice([[["a"], ["b"]]] * 6 + [[["A "], ["b"]], [[""], [""]], [["a", "c"], ["b"]]])
            rows.append((doc, f"t{place}", place, rng.choice([page] * 12 + [None]), page, rng.choice([2] * 9 + [3, 0]), header, 1, rng.randint(0, 5), title))
    got = pages.table_chains(spark.createDataFrame(rows, TABLES)).collect()
    for doc in range(150):
        assert {r.place: (r.chain, r.row_offset) for r in got if r.doc_id == doc} == folded([r for r in rows if r[0] == doc])


@pytest.mark.parametrize(("left", "right", "merged"), [
    (("表 2 企业能源消费量", [["年份"], ["消费量"]]), ("表 2 企业能源消费量（续）", [["年份"], ["消费量"]]), True),
    (("排放因子", [["类型"], ["因子"]]), ("组织信息", [["部门"], ["负责人"]]), False),
    (("表 3 排放因子", [["类型"], ["数值"]]), ("表 4 能源价格", [["类型"], ["数值"]]), False),
    (("排放数据", [["年份"], ["排放量"]]), ("排放数据", [["范围"], ["单位"]]), False),
])
def test_golden_pairs(spark, left, right, merged):
    rows = [(1, f"table-{k}", k, k, k, 2, t[1], 1, 2, t[0]) for k, t in enumerate((left, right), 1)]
    got = pages.merged_tables(pages.table_chains(spark.createDataFrame(rows, TABLES))).orderBy("chain").collect()
    assert [r.parts for r in got] == ([["table-1", "table-2"]] if merged else [["table-1"], ["table-2"]])
    if merged:
        assert (got[0].first_page, got[0].last_page, got[0].rows, got[0].title) == (1, 2, 3, left[0])
