"""Final chunks: derived table and image chunks, neighbours, oversized and truncated flags, and what a chunk set violates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.tokens import Vocabulary

SIDE, MOST, HARD_MAX = 64, 512, 1024
PROTECTED = ("code_block", "math_block", "table", "image")
WITHOUT_CONTEXT = ("front_matter", "horizontal_rule")
# Labels of derived chunks, defaults, reasons, and the sizes up to which a table stays in its chunk.
NO_DESCRIPTION, NO_SUMMARY = "未提供图片说明。", "未提供表格总结。"
INLINE_TOKENS, INLINE_ROWS, INLINE_COLUMNS = 256, 12, 5
OVERSIZED = {"single": "single_protected_entity", "some": "protected_with_context", "none": "token_safe_residual"}


def derived_elements(rows: DataFrame) -> DataFrame:
    """Tables and images of ``rows`` (doc_id, position, kind, body, trail, maybe suppressed), each with an id that counts its
    kind in the document, and with the bodies and positions of its neighbours.

    Front matter and rules are no neighbours and are passed over; a suppressed neighbour leaves its side empty. Suppressed
    tables and images give nothing.
    """
    hidden = F.coalesce("suppressed", F.lit(False)) if "suppressed" in rows.columns else F.lit(False)
    around = Window.partitionBy("doc_id").orderBy("position")
    near = rows.where(~F.col("kind").isin(*WITHOUT_CONTEXT)).withColumn("_shown", ~hidden)
    side = F.struct("position", "body", "_shown")
    near = near.withColumns({"_before": F.lag(side).over(around), "_after": F.lead(side).over(around)})
    found = near.where(F.col("kind").isin("table", "image") & F.col("_shown"))
    number = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("position"))
    name = F.concat(F.col("kind"), F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    sides = [F.when(F.col(f"_{s}._shown"), F.col(f"_{s}.{c}")).alias(f"{s}_{c}") for s in ("before", "after") for c in ("position", "body")]
    return found.select("doc_id", "position", "kind", "trail", "body", name.alias("element_id"), *sides)


def derived_chunks(rows: DataFrame, vocabulary: Vocabulary, side: int = SIDE) -> DataFrame:
    """A chunk of its own for every table and image: what it is, its heading path, ``side`` tokens of each neighbour, and itself.

    ``inline``: whether the table is small enough to stand in its source chunk as well; images never are.
    """
    found = derived_elements(rows)
    before = vocabulary.with_neighbours(F.col("before_body"), F.lit(""), F.lit(None).cast("string"), side)
    after = vocabulary.with_neighbours(F.lit(None).cast("string"), F.lit(""), F.col("after_body"), side)
    found = found.withColumns({"_b": before, "_a": after, "tokens": vocabulary.count(F.col("body"), strip=True)})
    image = F.col("kind") == "image"
    alt = F.trim(F.regexp_extract("body", "!\\[([^\\]]*)\\]", 1))
    described = F.when(image, F.when(alt != "", alt).otherwise(NO_DESCRIPTION)).otherwise(NO_SUMMARY)
    context = F.array_join(F.filter(F.array("_b.content", "_a.content"), lambda x: x != ""), "；")
    lines = F.split(F.trim("body"), "\n")
    columns = F.size(F.split(F.regexp_replace(F.trim(lines[0]), "^\\||\\|$", ""), "\\|"))

    def labelled(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    content = F.concat_ws(
        "\n", F.when(image, "类型：图片").otherwise("类型：表格"), F.concat(F.when(image, "图片ID：").otherwise("表格ID："), "element_id"), labelled("标题路径：", F.array_join("trail", " / ")),
        F.concat(F.when(image, "图片说明：").otherwise("表格总结："), described), F.when(context != "", labelled("相邻上下文：", context)),
        F.when(image, labelled("原始引用：", lines[0])).otherwise(labelled("原始表格：\n", F.col("body"))),
    )
    small = (F.col("tokens") <= INLINE_TOKENS) & (F.size(lines) - 1 <= INLINE_ROWS) & (columns <= INLINE_COLUMNS)
    return found.select("doc_id", "position", "kind", "element_id", "trail", content.alias("content"), F.col("_b.before_tokens").alias("before_tokens"), F.col("_a.after_tokens").alias("after_tokens"), (~image & small).alias("inline"))


def with_overlap(chunks: DataFrame, keys: list[str], order: str, vocabulary: Vocabulary, side: int = SIDE, most: int | None = HARD_MAX) -> DataFrame:
    """``chunks`` with ``framed``: content with up to ``side`` tokens of both neighbours, at most ``most`` tokens in all unless the body alone has more."""
    w = Window.partitionBy(*keys).orderBy(order)
    both = chunks.withColumns({"_before": F.lag("content").over(w), "_after": F.lead("content").over(w)})
    return both.withColumn("framed", vocabulary.with_neighbours(F.col("_before"), F.col("content"), F.col("_after"), side, most)).drop("_before", "_after")


def final_chunks(chunks: DataFrame, vocabulary: Vocabulary, most: int = MOST, hard_max: int = HARD_MAX) -> DataFrame:
    """``chunks`` (content, kinds, elements) with tokens, truncated, oversized and reason.

    A single protected element over ``hard_max`` is cut to its whole lines that fit (to tokens, if not even the first does)
    and keeps its count in original_tokens; whatever else is over ``most`` stays whole and is flagged.
    """
    protected = F.array(*map(F.lit, PROTECTED))
    counted = chunks.withColumn("original_tokens", vocabulary.count(F.col("content"), strip=True))
    single = (F.col("elements") == 1) & F.arrays_overlap("kinds", protected)
    counted = counted.withColumns({"truncated": single & (F.col("original_tokens") > hard_max)})
    counted = counted.withColumn("oversized", ~F.col("truncated") & (F.col("original_tokens") > most))
    why = F.when(F.col("truncated"), F.concat(F.col("kinds")[0], F.lit("_over_hard_max"))).when(
        F.col("oversized"), F.when(single, OVERSIZED["single"]).when(F.arrays_overlap("kinds", protected), OVERSIZED["some"]).otherwise(OVERSIZED["none"]),
    )
    cut = vocabulary.whole_lines(F.when(F.col("truncated"), F.col("content")), hard_max)  # functions see every row: only what is cut is handed to them
    counted = counted.withColumns({"reason": why, "_cut": cut})
    left = vocabulary.count(F.when(F.col("truncated"), F.col("_cut")), strip=True)
    counted = counted.withColumns({"content": F.when(F.col("truncated"), F.col("_cut")).otherwise(F.col("content")), "_left": left})
    return counted.withColumn("tokens", F.when(F.col("truncated"), F.col("_left")).otherwise(F.col("original_tokens"))).drop("_cut", "_left")


def violations(coarse: DataFrame, finals: DataFrame, hard_max: int, derived: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """What a set of final chunks violates: rows (doc_id, rule, subject).

    ``coarse``: doc_id, chunk, content. ``finals``: doc_id, chunk (their source), place, content, tokens, kinds, truncated,
    contained (ids of elements inside), and first_line and last_line where ``ranges`` are given. Rules:

    * source: a final's coarse chunk doesn't exist;
    * lossless: the finals of a chunk, in order, aren't its consecutive slices to the end; where one is truncated, slices in order suffice;
    * hard_max: a final has more tokens, front matter alone excepted;
    * anchor: no final of the document contains a derived chunk's element_id (``derived``: doc_id, element_id), where any names what it contains;
    * protected: an element of ``ranges`` (doc_id, element_id, first_line, last_line) isn't inside one final.
    """
    name = F.concat_ws(":", "chunk", "place")
    lost = finals.join(coarse, ["doc_id", "chunk"], "left_anti").select("doc_id", F.lit("source").alias("rule"), name.alias("subject"))
    listed = finals.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "content"))).alias("parts"), F.bool_or("truncated").alias("loose"))  # the parts of one chunk

    def step(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part["content"], F.col("content"), at + 1) - 1
        return F.when((at < 0) | (found < 0) | (~F.col("loose") & (found != at)), -1).otherwise(found + F.length(part["content"]))

    end = F.aggregate("parts", F.lit(0), step)
    broken = listed.join(coarse, ["doc_id", "chunk"]).withColumn("_end", end).where((F.col("_end") < 0) | (~F.col("loose") & (F.col("_end") != F.length("content"))))
    found = lost.unionByName(broken.select("doc_id", F.lit("lossless").alias("rule"), F.col("chunk").cast("string").alias("subject")))
    front = F.coalesce(F.col("kinds") == F.array(F.lit("front_matter")), F.lit(False))
    found = found.unionByName(finals.where((F.col("tokens") > hard_max) & ~front).select("doc_id", F.lit("hard_max").alias("rule"), name.alias("subject")))
    if derived is not None:
        held = finals.select("doc_id", F.explode("contained").alias("element_id")).distinct()
        loose = derived.join(held, ["doc_id", "element_id"], "left_anti").join(held.select("doc_id").distinct(), "doc_id", "left_semi")
        found = found.unionByName(loose.select("doc_id", F.lit("anchor").alias("rule"), F.col("element_id").alias("subject")))
    if ranges is not None:
        spans = finals.select(F.col("doc_id").alias("_doc"), F.col("first_line").alias("_first"), F.col("last_line").alias("_last"))
        whole = ranges.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("_first") <= F.col("first_line")) & (F.col("_last") >= F.col("last_line")), "left_anti")
        found = found.unionByName(whole.select("doc_id", F.lit("protected").alias("rule"), F.col("element_id").alias("subject")))
    return found
