"""Whether a document needs headings, where they may go, and what a plan of headings makes of it.

The plan itself comes from outside (a model or a person); the gate in front of it and the checks behind it are columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.structure import DEEPEST, clue

# When a document is long without headings, flat or sparse; the longest clue and preview; titles that sections commonly have.
NO_HEADING_TOKENS, FLAT_HEADINGS, SPARSE_TOKENS, CLUE_CHARS, PREVIEW_CHARS = 512, 5, 1536, 40, 120
COMMON_TITLES = ("概述", "背景", "目标", "流程", "配置", "注意事项", "示例", "常见问题", "安装", "部署", "参数说明")


def is_clue(line: Column) -> Column:
    """Whether a trimmed line is short and looks numbered: chapters, articles, outlines, titled numbers of two parts or more, or a common title."""
    found = clue(line)
    decimal = found["title"].isNotNull() & (F.size(found["label"]) > 1)
    numbered = F.when(found["kind"] == "decimal", decimal).otherwise(found["kind"].isNotNull() & (found["kind"] != "digit_parenthesized"))
    return F.coalesce((F.length(line) > 0) & (F.length(line) <= CLUE_CHARS) & (line.isin(*COMMON_TITLES) | numbered), F.lit(False))


def gate(elements: DataFrame, tokens: DataFrame, no_heading: int = NO_HEADING_TOKENS, flat: int = FLAT_HEADINGS, sparse: int = SPARSE_TOKENS, hint: Callable[[Column], Column] = is_clue) -> DataFrame:
    """doc_id, total_tokens, headings, levels, clues, reason and runs (whether headings should be made) of every document of ``tokens`` (doc_id, total_tokens).

    ``elements`` are rows (doc_id, kind, level, body), maybe with the headings' title; else it is the body without Markdown's marks.
    ``hint`` tells of a trimmed line whether it hints at a hierarchy. A document without headings runs if it is long; one whose headings share a
    level if there are enough of them and lines hint at a hierarchy; one with several levels if they are far apart.
    """
    heading = F.col("kind") == "heading"
    title = F.col("title") if "title" in elements.columns else F.regexp_replace(F.regexp_replace("body", "^#+\\s*", ""), "\\s*#*\\s*$", "")
    lines = F.when(heading, F.array(F.trim(title))).otherwise(F.transform(F.split("body", "\n"), lambda x: F.trim(x)))
    level = F.when(heading, F.when(F.coalesce("level", F.lit(0)) == 0, 1).otherwise(F.col("level")))
    seen = elements.groupBy("doc_id").agg(F.count_if(heading).alias("headings"), F.sort_array(F.collect_set(level.cast("int"))).alias("levels"), F.sum(F.size(F.filter(lines, hint))).alias("clues"))
    every = tokens.select("doc_id", "total_tokens").join(seen, "doc_id", "left")
    none = F.array().cast("array<int>")
    every = every.select("doc_id", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("levels", none).alias("levels"), F.coalesce("clues", F.lit(0)).alias("clues"))
    reason = (
        F.when((F.col("headings") == 0) & (F.col("total_tokens") >= no_heading), "no_headings")
        .when(F.col("headings") == 0, "too_short_without_headings")
        .when((F.col("headings") >= flat) & (F.size("levels") == 1) & (F.col("clues") > 0), "flat_heading_levels")
        .when((F.col("headings") >= flat) & (F.size("levels") == 1), "flat_without_hierarchy_clues")
        .when((F.size("levels") >= 2) & (F.col("total_tokens") >= F.col("headings") * sparse), "sparse_heading_tree")
        .otherwise("healthy_heading_tree")
    )
    return every.withColumn("reason", reason).withColumn("runs", F.col("reason").isin("no_headings", "flat_heading_levels", "sparse_heading_tree"))


def insert_positions(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, line, kind and preview of the places where a heading may be put: before ``line``, counted from 0.

    These are the first lines of elements (``first_line`` counts from 1), the document's first line and its end; front matter
    keeps its place, and the line behind it counts. Null texts have no places.
    """
    clean = F.array_join(F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    short = F.when(F.length(clean) <= PREVIEW_CHARS, clean).otherwise(F.concat(F.rtrim(F.left(clean, F.lit(PREVIEW_CHARS - 3))), F.lit("...")))
    front = F.col("kind") == "front_matter"
    line = F.when(front, F.col("last_line")).otherwise(F.col("first_line") - 1).cast("int")
    no_kind = F.lit(None).cast("string")
    begun = elements.select("doc_id", line.alias("line"), F.when(~front, F.col("kind")).alias("kind"), F.when(front, "").otherwise(short).alias("preview"), F.when(front, 0).otherwise(1).alias("_rank"))
    framed = documents.where("text is not null").join(elements.where(front).select("doc_id").distinct().withColumn("_f", F.lit(True)), "doc_id", "left")
    ends = F.when(F.col("_f"), F.array(F.size(F.split("text", "\n")))).otherwise(F.array(F.lit(0), F.size(F.split("text", "\n"))))
    ends = framed.select("doc_id", F.explode(ends).alias("line")).select("doc_id", "line", no_kind.alias("kind"), F.lit("").alias("preview"), F.lit(2).alias("_rank"))
    # an edge comes before an element that begins there, and that before the line behind front matter
    return begun.unionByName(ends).groupBy("doc_id", "line").agg(F.max_by(F.struct("kind", "preview"), "_rank").alias("p")).select("doc_id", "line", "p.kind", "p.preview")


def checked_plan(positions: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` (doc_id, line, level, text) with ``problem``: null for headings that may be put in.

    A heading needs a place of ``positions`` that no other heading of the plan asks for, a level from 1 to 5 and a text of one
    line without marks of headings or code.
    """
    text = F.trim("text")
    known = positions.select("doc_id", "line", F.lit(True).alias("_place"))
    asked = plan.groupBy("doc_id", "line").agg(F.collect_list(F.struct("level", "text")).alias("_all"))  # what a plan asks for at one place
    rows = asked.join(known, ["doc_id", "line"], "left").select("doc_id", "line", (F.size("_all") > 1).alias("_again"), "_place", F.explode("_all").alias("h")).select("doc_id", "line", "h.level", "h.text", "_again", "_place")
    problem = (
        F.when(F.col("_place").isNull(), "no_such_place").when(F.coalesce(~F.col("level").between(1, DEEPEST), F.lit(True)), "level").when(F.coalesce(text == "", F.lit(True)) | text.rlike("[\\r\\n#]|```|~~~"), "text").when(F.col("_again"), "place_taken")
    )
    return rows.withColumn("problem", problem).drop("_again", "_place")


def apply_plan(documents: DataFrame, positions: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, text and inserted (headings put in): the text with a plan's headings before their lines, an empty line after each.

    A plan with a heading that can't be put in changes nothing in its document. Lines stay as they are, so that taking the
    headings out gives the text again. A document is one row of ``documents``.
    """
    checked = checked_plan(positions, plan)
    sound = checked.groupBy("doc_id").agg(F.bool_and(F.col("problem").isNull()).alias("sound"), F.map_from_entries(F.collect_list(F.when(F.col("problem").isNull(), F.struct("line", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.trim("text")))))).alias("at"))
    both = documents.select("doc_id", "text").join(sound, "doc_id", "left").withColumn("at", F.when(F.col("sound"), F.col("at")))
    lines = F.split("text", "\n")
    put = F.flatten(F.transform(lines, lambda x, i: F.when(F.col("at")[i].isNotNull(), F.array(F.col("at")[i], F.lit(""), x)).otherwise(F.array(x))))
    last = F.when(F.col("at")[F.size(lines)].isNotNull(), F.array(F.col("at")[F.size(lines)])).otherwise(F.array().cast("array<string>"))
    changed = F.array_join(F.concat(put, last), "\n")
    return both.select("doc_id", F.when(F.col("at").isNull(), F.col("text")).otherwise(changed).alias("text"), F.coalesce(F.cardinality(F.col("at")), F.lit(0)).alias("inserted"))
