"""Exact tokens against a public encoder, neighbours and cuts against their definition, planted violations."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions.bpe import BytePairs, read_ranks
from fathomline.operators import assembly
from fathomline.operators.tokens import Vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
FINAL = "doc_id long, chunk int, place int, content string, tokens int, kinds array<string>, truncated boolean, contained array<string>, first_line int, last_line int"


@pytest.fixture(scope="module")
def pairs():
    with open(PATH, "rb") as lines:
        return BytePairs(read_ranks(lines), PATTERN)


@pytest.fixture(scope="module")
def encoding(pairs):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(spark):
    return Vocabulary(spark, PATH, PATTERN)


def texts(spark):
    rng = random.Random(4)
    made = ["", " ", "\n\n\t x", "x" * 5000, "汉字和 words 🎈 mixed é" * 40, "aaaa" * 700] + ["".join(rng.choice("ab \n字🎈é1.") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    return made + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_tokens_are_the_encoders(spark, pairs, encoding, vocabulary):
    every = texts(spark)
    for t in every:
        assert pairs.encode(t) == encoding.decode_tokens_bytes(encoding.encode_ordinary(t))
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*every, None])], "k int, t string")
    got = {r.k: r.n for r in df.select("k", vocabulary.count(F.col("t")).alias("n")).collect()}
    assert got == {k: len(encoding.encode_ordinary(t or "")) for k, t in enumerate([*every, None])}


def test_cuts_keep_characters_whole(spark, pairs):
    for t in texts(spark)[:206]:
        tokens = pairs.encode(t)
        for most in (0, 1, 2, 7, 64):
            kept, removed = pairs.first(t, most)
            n = len(tokens) - removed
            assert t.startswith(kept) and b"".join(tokens[:n]) == kept.encode() and n <= most or kept == t
            if kept != t and n < min(most, len(tokens)):  # a longer one would split a character
                with pytest.raises(UnicodeDecodeError):
                    b"".join(tokens[:most]).decode()
            end = pairs.last(t, most)
            assert t.strip().endswith(end) and pairs.count(end) <= most


def test_the_body_is_never_cut(spark, pairs, vocabulary):
    rng = random.Random(8)
    sides = ["", "short one", "long " * 90, "汉字" * 60]
    rows = [(k, rng.choice([*sides, None]), rng.choice(sides[1:]), rng.choice([*sides, None])) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, b string, t string, a string")
    for most in (None, 60, 130):
        for r in df.select("*", vocabulary.with_neighbours(F.col("b"), F.col("t"), F.col("a"), 32, most).alias("f")).collect():
            assert r.t.strip() in r.f.content and r.f.before_tokens <= 32 and r.f.after_tokens <= 32
            if most is not None and pairs.count(r.t) >= most:
                assert r.f.content == r.t and r.f.before_tokens == r.f.after_tokens == 0
            elif most is not None:
                assert pairs.count(r.f.content) <= most
            elif r.b and r.b.strip():
                assert r.f.before_tokens == pairs.count(pairs.last(r.b, 32)) > 0


def test_flags_of_long_chunks(spark, vocabulary, pairs):
    rows = [(1, "word " * 30, ["paragraph"], 3), (2, "word " * 30, ["table"], 1), (3, "word \n" * 60, ["code_block"], 1), (4, "word " * 60, ["paragraph", "table"], 2), (5, "few", ["table"], 1), (6, "x" * 4000, ["image"], 1)]
    df = spark.createDataFrame(rows, "k int, content string, kinds array<string>, elements int")
    got = {r.k: r for r in assembly.final_chunks(df, vocabulary, most=20, hard_max=40).collect()}
    assert {k: (r.truncated, r.oversized, r.reason) for k, r in got.items()} == {
        1: (False, True, "token_safe_residual"), 2: (False, True, "single_protected_entity"), 3: (True, False, "code_block_over_hard_max"),
        4: (False, True, "protected_with_context"), 5: (False, False, None), 6: (True, False, "image_over_hard_max"),
    }
    assert got[3].content.endswith("\n") and got[3].tokens <= 40 < pairs.count((got[3].content + "word \n").strip())
    assert got[4].content == "word " * 60 and 0 < got[6].tokens <= 40


def test_planted_violations(spark):
    coarse = spark.createDataFrame([(1, 0, "abcdef"), (1, 1, "ghi"), (2, 0, "abcabc")], "doc_id long, chunk int, content string")

    def final(doc, chunk, place, content, tokens=1, kinds=("paragraph",), truncated=False, contained=("e",), first=0, last=9):
        return doc, chunk, place, content, tokens, list(kinds), truncated, list(contained), first, last

    good = [final(1, 0, 0, "abc"), final(1, 0, 1, "def"), final(1, 1, 0, "ghi"), final(2, 0, 0, "abc"), final(2, 0, 1, "abc")]

    def found(rows, derived=(), ranges=()):
        d = spark.createDataFrame(list(derived), "doc_id long, element_id string")
        r = spark.createDataFrame(list(ranges), "doc_id long, element_id string, first_line int, last_line int")
        return sorted((x.doc_id, x.rule, x.subject) for x in assembly.violations(coarse, spark.createDataFrame(rows, FINAL), 5, d, r).collect())

    assert found(good, [(1, "e")], [(1, "p", 0, 9)]) == []
    assert found(good[1:]) == [(1, "lossless", "0")]  # a gap in front
    assert found([good[0], *good[2:]]) == [(1, "lossless", "0")]  # not to the end
    assert found([*good, final(1, 1, 1, "i")]) == [(1, "lossless", "1")]  # an overlap
    assert found([final(1, 0, 0, "def"), final(1, 0, 1, "abc"), *good[2:]]) == [(1, "lossless", "0")]  # out of order
    assert found([final(1, 0, 0, "bc", truncated=True), final(1, 0, 1, "f"), *good[2:]]) == []  # slices in order suffice
    assert found([final(1, 0, 0, "f", truncated=True), final(1, 0, 1, "bc"), *good[2:]]) == [(1, "lossless", "0")]
    assert found([*good, final(1, 7, 0, "x")]) == [(1, "source", "7:0")]
    assert found([final(1, 1, 0, "ghi", tokens=6), *good[:2], *good[3:]]) == [(1, "hard_max", "1:0")]
    assert found([final(1, 1, 0, "ghi", tokens=6, kinds=["front_matter"]), *good[:2], *good[3:]]) == []
    assert found(good, [(2, "missing")]) == [(2, "anchor", "missing")]
    assert found([final(*r[:4], contained=()) for r in good], [(2, "missing")]) == []  # nothing says what it contains
    assert found([final(*r[:4], first=2 * k, last=2 * k + 1) for k, r in enumerate(good)], (), [(1, "cut", 1, 2), (1, "whole", 2, 3)]) == [(1, "protected", "cut")]


def test_derived_chunk_of_a_table(spark, vocabulary):
    rows = [(1, 0, "heading", "# h", ["h"], False), (1, 1, "front_matter", "---", ["h"], False), (1, 2, "table", "| a | b |\n| --- | --- |\n| 1 | 2 |", ["h", "s"], False), (1, 3, "horizontal_rule", "***", ["h"], False),
            (1, 4, "paragraph", "after it", ["h"], False), (1, 5, "image", "![ an alt ](x.png)\nmore", ["h"], False), (1, 6, "paragraph", "hidden", ["h"], True), (1, 7, "image", "![](y.png)", [], False)]
    df = spark.createDataFrame(rows, "doc_id long, position int, kind string, body string, trail array<string>, suppressed boolean")
    got = assembly.derived_chunks(df, vocabulary).orderBy("position").collect()
    assert [r.element_id for r in got] == ["table_001", "image_001", "image_002"] and [r.inline for r in got] == [True, False, False]
    assert got[0].content == "类型：表格\n表格ID：table_001\n标题路径：h / s\n表格总结：未提供表格总结。\n相邻上下文：# h；after it\n原始表格：\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert got[1].content == "类型：图片\n图片ID：image_001\n标题路径：h\n图片说明：an alt\n相邻上下文：after it\n原始引用：![ an alt ](x.png)"
    assert got[2].content == "类型：图片\n图片ID：image_002\n标题路径：\n图片说明：未提供图片说明。\n原始引用：![](y.png)"
