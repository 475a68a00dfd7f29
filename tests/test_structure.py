"""Boundaries that hold over a whole document, heading paths and coarse chunks, on golden documents and naive forms."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import markdown as md
from fathomline.operators import chunking, structure

SCHEMA = "doc_id long, position long, kind string, first_line long, last_line long, level long, body string"


def elements(spark, *texts):
    rows = [(d, k, e.kind, e.start, e.end, e.level, e.text) for d, t in enumerate(texts) for k, e in enumerate(md.elements(t))]
    return spark.createDataFrame(rows, SCHEMA)


def chunked(spark, text, soft_min):
    found = structure.gathered(structure.coarse_chunks(elements(spark, text), F.length("body"), soft_min))
    return [(r.content, r.trail) for r in found.orderBy("chunk").collect()]


def bounds(spark, text):
    return {r.position: (r.boundary.kind, r.boundary.heading) for r in structure.boundaries(elements(spark, text)).where("boundary is not null").collect()}


def test_chapters_always_close(spark):
    got = chunked(spark, "# 碳排放权登记管理规则（试行）\n\n第一章 总 则\n\n第一条 为了规范登记管理。\n\n第二章 账户管理\n\n第二条 登记主体应当开立账户。", 128)
    assert [c.split("\n")[0] for c, _ in got] == ["# 碳排放权登记管理规则（试行）", "第二章 账户管理"]
    assert [t for _, t in got] == [["碳排放权登记管理规则（试行）", "第一章 总 则"], ["碳排放权登记管理规则（试行）", "第二章 账户管理"]]


def test_articles_wait_for_the_soft_minimum(spark):
    got = chunked(spark, "第一章 总则\n\n第一条 短条款。\n\n第二条 继续聚合到达软下限。\n\n第三条 达到下限后从本条前切分。", 20)
    assert len(got) == 2 and "第二条" in got[0][0] and got[1][0].startswith("第三条")


def test_decimal_sections_of_a_standard(spark):
    got = chunked(spark, "1 范围\n\n本文件规定了核算要求。\n\n2 规范性引用文件\n\n下列文件必不可少。\n\n3 术语和定义\n\n3.1\n温室气体\n\n术语正文。\n\n3.2 报告主体\n\n术语正文。\n\n4 基本原则\n\n原则正文。", 20)
    assert [c.split("\n")[0] for c, _ in got] == ["1 范围", "2 规范性引用文件", "3 术语和定义", "3.2 报告主体", "4 基本原则"]
    assert got[2][1] == ["3 术语和定义", "3.1 温室气体"] and got[3][1] == ["3 术语和定义", "3.2 报告主体"]


def test_numbers_that_are_no_structure(spark):
    assert len(chunked(spark, "说明\n\n2024 年排放量数据\n\n结束", 10)) == 1
    assert bounds(spark, "前言\n\n1\n\n第一页正文。\n\n2\n\n第二页正文。\n\n3\n\n第三页正文。") == {}
    for mark in ("{} ", "{}. ", "{}、", "{}) "):
        steps = "".join(f"\n\n{mark.format(k)}第{w}步操作\n\n输入数据。" for k, w in ((1, "一"), (2, "二"), (3, "三")))
        assert bounds(spark, "操作说明" + steps) == {}


def test_title_in_the_next_paragraph(spark):
    text = "1 范围\n\n正文。\n\n2 规范性引用文件\n\n正文。\n\n3 术语和定义\n\n3.1\n\n温室气体\n\n术语正文。\n\n3.2\n\n报告主体\n\n术语正文。\n\n4 基本原则\n\n正文。"
    trails = [t for _, t in chunked(spark, text, 10)]
    assert any("3.1 温室气体" in t for t in trails) and any("3.2 报告主体" in t for t in trails)


def test_outlines_need_two_of_a_kind(spark):
    got = chunked(spark, "一、总体要求\n\n（一）指导思想\n\n指导思想正文很长很长。\n\n（二）工作原则\n\n工作原则正文很长很长。\n\n二、主要目标\n\n（一）阶段目标\n\n阶段目标正文。", 20)
    assert got[0][1] == ["一、总体要求", "（一）指导思想"] and any(c.startswith("二、主要目标") for c, _ in got)
    assert bounds(spark, "一、总体要求\n\n正文。\n\n（一）指导思想") == {}


def test_runs_count_under_one_parent_only(spark):
    assert bounds(spark, "1 a\n\n1.1 b\n\n2.2 c\n\n2 d") == {}  # 1.1 and 2.2 are no run
    assert sorted(bounds(spark, "1 a\n\n1.1 b\n\n1.2 c\n\n2.7 d")) == [0, 1, 2]  # 2.7 stands alone


def test_headings_that_leave_their_level_close(spark):
    """Siblings on the deepest level stay together below the soft minimum; others don't."""
    assert [c.split("\n")[0] for c, _ in chunked(spark, "# a\n\nx\n\n## b\n\ny\n\n## c\n\nz\n\n# d\n\nw", 1000)] == ["# a", "# d"]
    assert [c.split("\n")[0] for c, _ in chunked(spark, "# a\n\nx\n\n## b\n\ny\n\n## c\n\nz\n\n### e\n\nv", 1000)] == ["# a", "## c"]
    assert [c for c, _ in chunked(spark, "# a\n\nx\n\n# b", 1000)] == ["# a\n\nx\n\n# b"]  # a tail of headings joins


def test_noise_and_front_matter(spark):
    got = chunked(spark, "---\nt: 1\n---\n\n# a\n\nx\n\n***\n\ny", 1000)
    assert [c for c, _ in got] == ["---\nt: 1\n---", "# a\n\nx\n\ny"]
    flagged = elements(spark, "# a\n\nx\n\nrunning head\n\ny").withColumn("suppressed", F.col("body") == "running head")
    assert [r.content for r in structure.gathered(structure.coarse_chunks(flagged, F.length("body"))).collect()] == ["# a\n\nx\n\ny"]


def naive_trail(found):
    stack, out = [], []
    for e in found:
        if e.kind == "heading" and e.level <= 5:
            stack = [s for s in stack if s[0] < e.level] + [(e.level, e.text.lstrip("#").strip())]
        out.append([t for _, t in stack])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_of_any_depth_against_a_stack(spark, seed):
    rng = random.Random(seed)
    texts = ["\n\n".join(rng.choice([f"{'#' * rng.randint(1, 6)} t{k}", f"p{k}"]) for k in range(rng.randint(1, 40))) for _ in range(20)]
    got = {(r.doc_id, r.position): r.trail for r in structure.with_paths(elements(spark, *texts)).collect()}
    assert got == {(d, k): t for d, text in enumerate(texts) for k, t in enumerate(naive_trail(md.elements(text)))}


def test_every_element_is_in_one_chunk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.regexp_replace("text", "\n", "\n\n## x\n\n").alias("text"))
    found = chunking.elements(docs)
    numbered = structure.coarse_chunks(found, F.length("body"))
    assert numbered.count() == found.count() == numbered.select("doc_id", "position").distinct().count()
    assert structure.coarse_chunks(found.limit(0), F.length("body")).count() == 0
