"""Structure of documents: numbered and legal headings that hold over a whole document, heading paths, coarse chunks.

Elements are rows (doc_id, position, kind, first_line, last_line, level, body). Consistency is checked by windows over
a document's rows: a numbering counts only where some n and n + 1 both stand under the same parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.scan import in_order
from fathomline.sources.shared import stored

# Forms of numbered lines (which may hold other line ends than \n), longest headings and titles, levels.
NUMBER = "[零〇○一二三四五六七八九十百千万亿两0-9]+"
DIVISION = f"(?s)^第{NUMBER}([编篇章节])(?:[\\s\\u3000]+.*)?$"
ARTICLE = f"^第{NUMBER}条"
APPENDIX = "(?s)^附录\\s*[A-Z一二三四五六七八九十0-9]+(?:[\\s\\u3000]+.*)?$"
DECIMAL = "(?s)^([0-9]{1,3}(?:\\.[0-9]{1,3}){0,4})(?:[\\s\\u3000]+(\\S.*))?$"
ROOT = "(?s)^([0-9]{1,3})[.、]\\s*(\\S.*)$"
OUTLINE = "(?s)^[一二三四五六七八九十]+、\\s*(\\S.*)$"
SUBSECTION = "(?s)^[（(][一二三四五六七八九十]+[）)]\\s*(\\S.*)$"
DIGIT_PAREN = "(?s)^[0-9]{1,3}[）)]\\s*(\\S.*)$"
HEADING_CHARS, TITLE_CHARS, SENTENCE_ENDS = 120, 60, "[。！？；;]$"
SOFT_MIN, DEEPEST = 128, 5
NOISE = ("horizontal_rule",)


def clue(line: Column) -> Column:
    """What one trimmed line looks like: kind, level, label (numbers) and title; null for plain text."""
    t = F.regexp_replace(line, "\\s*．\\s*", ".")
    unit = F.regexp_extract(t, DIVISION, 1)
    text = lambda s: F.lit(s).cast("string")
    no_label, no_title = F.lit(None).cast("array<int>"), F.lit(None).cast("string")

    def said(kind: Column, level: Column, label: Column = no_label, title: Column = no_title) -> Column:
        return F.struct(kind.alias("kind"), level.cast("int").alias("level"), label.alias("label"), title.alias("title"))

    decimal = F.split(F.regexp_extract(t, DECIMAL, 1), "\\.").try_cast("array<int>")
    return (
        F.when(t.rlike(DIVISION), said(F.concat(F.lit("legal_"), unit), F.when(unit == "节", 3).otherwise(2)))
        .when(t.rlike(ARTICLE), said(text("legal_article"), F.lit(3)))
        .when(t.rlike(APPENDIX), said(text("appendix"), F.lit(2)))
        .when(t.rlike(DECIMAL), said(text("decimal"), F.least(F.lit(DEEPEST), F.size(decimal) + 1), decimal, F.nullif(F.regexp_extract(t, DECIMAL, 2), F.lit(""))))
        .when(t.rlike(ROOT), said(text("decimal"), F.lit(2), F.array(F.regexp_extract(t, ROOT, 1).try_cast("int")), F.regexp_extract(t, ROOT, 2)))
        .when(t.rlike(OUTLINE), said(text("chinese_outline"), F.lit(2)))
        .when(t.rlike(SUBSECTION), said(text("chinese_subsection"), F.lit(3)))
        .when(t.rlike(DIGIT_PAREN), said(text("digit_parenthesized"), F.lit(4)))
    )


def boundaries(elements: DataFrame) -> DataFrame:
    """``elements`` with ``boundary``: kind, level, hard and heading of the structure that a paragraph opens, null for none.

    Chapters, appendices and first-level sections are hard, articles and deeper numbers only candidates. A number
    without a title takes the next line or a short paragraph behind it. Numbers count under parents with a run n, n + 1,
    and on the first level only where some deeper run stands; outlines count from two of their kind.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("position")
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.regexp_replace(lines[0], "．", ".")
    paragraph = F.col("kind") == "paragraph"
    rows = elements.withColumns({"_lines": lines, "_head": F.when(paragraph & (F.size(lines) > 0) & (F.length(head) <= HEADING_CHARS), head)})
    rows = rows.withColumn("_clue", clue(F.col("_head")))
    fits = (F.size("_lines") == 1) & F.col("_clue").isNull() & (F.length("_head") <= TITLE_CHARS) & ~F.col("_head").rlike(SENTENCE_ENDS)
    follows = F.lead(F.when(fits, F.col("_head"))).over(by_doc)
    deep = F.size("_clue.label") > 1
    added = F.when(deep & F.col("_clue.title").isNull(), F.when(F.size("_lines") > 1, F.col("_lines")[1]).otherwise(follows))
    numbered = (F.col("_clue.kind") == "decimal") & F.coalesce("_clue.title", added).isNotNull()
    rows = rows.withColumns({
        "_heading": F.when(added.isNotNull(), F.left(F.concat_ws(" ", "_head", added), F.lit(HEADING_CHARS))).otherwise(F.col("_head")),
        "_parent": F.when(numbered, F.slice("_clue.label", 1, F.size("_clue.label") - 1)),
        "_number": F.when(numbered, F.element_at("_clue.label", -1)),
    })
    siblings = Window.partitionBy("doc_id", "_parent")
    after = F.max("_number").over(siblings.orderBy("_number").rangeBetween(1, 1))
    rows = rows.withColumn("_runs", F.max(F.when(F.col("_number").isNotNull(), after.isNotNull())).over(siblings))
    nested = F.max(F.coalesce(F.col("_runs"), F.lit(False)) & (F.size("_parent") > 0)).over(Window.partitionBy("doc_id"))
    alike = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "_clue.kind"))
    rows = rows.withColumns({"_nested": nested, "_alike": alike})
    kind, root = F.col("_clue.kind"), F.size("_parent") == 0

    def found(name: Column, hard: Column) -> Column:
        return F.struct(name.alias("kind"), F.col("_clue.level").alias("level"), hard.alias("hard"), F.col("_heading").alias("heading"))

    boundary = (
        F.when(kind == "legal_article", found(kind, F.lit(False)))
        .when(kind.startswith("legal_") | (kind == "appendix"), found(kind, F.lit(True)))
        .when(F.col("_number").isNotNull() & F.when(root, F.col("_nested")).otherwise(F.col("_runs")), found(F.lit("decimal_section"), root))
        .when(kind.isin("chinese_outline", "chinese_subsection") & (F.col("_alike") >= 2), found(kind, kind == "chinese_outline"))
    )
    return rows.select(*elements.columns, boundary.alias("boundary"))


def heading_paths(rows: DataFrame, title: Column, level: Column, name: str = "trail", deepest: int = DEEPEST) -> DataFrame:
    """``rows`` with the titles of the headings above each, outermost first; a heading's own path ends with itself.

    ``title`` and ``level`` are null but on headings. A level's last title counts until a heading of its level or above
    comes: one running window keeps the last heading of every level, and those behind the last of all levels above stay.
    """
    so_far = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(level == k, F.struct("position", title.alias("title")))).over(so_far).alias(f"_at{k}") for k in range(1, deepest + 1)]
    kept, newest = [], F.lit(-1).cast("long")
    for k in range(1, deepest + 1):
        at = F.col(f"_at{k}.position").cast("long")
        kept.append(F.when(at > newest, F.col(f"_at{k}.title")))
        newest = F.greatest(newest, F.coalesce(at, F.lit(-1)))
    return rows.select("*", *last).withColumn(name, F.array_compact(F.array(*kept))).drop(*(f"_at{k}" for k in range(1, deepest + 1)))


def with_paths(elements: DataFrame) -> DataFrame:
    """``boundaries`` of ``elements``, with ``trail``: Markdown headings and structural ones, articles apart."""
    found = boundaries(elements)
    structural = F.col("boundary").isNotNull() & (F.col("boundary.kind") != "legal_article")
    own = F.regexp_replace(F.regexp_replace("body", "^#+\\s*", ""), "\\s*#*\\s*$", "")
    title = F.when(structural, F.col("boundary.heading")).when(F.col("kind") == "heading", own)
    return heading_paths(found, title, F.when(structural, F.col("boundary.level")).when(F.col("kind") == "heading", F.col("level")))


def _chunker(soft_min: int):
    """The step that numbers a document's chunks: what is held, its tokens, and the rule when to close it."""

    def start():
        held: list[dict] = []
        state = {"chunk": 0, "tokens": 0, "before": None}

        def close() -> list[tuple]:
            out = [(r["doc_id"], r["position"], state["chunk"]) for r in held]
            state.update(chunk=state["chunk"] + bool(held), tokens=0, before={r["kind"] for r in held} or state["before"])
            held.clear()
            return out

        def closes(row: dict) -> bool:
            if not held or not (row["kind"] == "heading" or row["opens"]) or all(r["kind"] == "heading" or r["titled"] for r in held):
                return False
            if row["hard"] or state["tokens"] >= soft_min:
                return True
            if row["opens"] or row["level"] is None:  # candidates wait for the soft minimum
                return False
            last = next((r["level"] for r in reversed(held) if r["level"] is not None), None)
            # a heading that doesn't go deeper closes, but for siblings on the document's deepest level
            return last is not None and row["level"] <= last and not row["level"] == last == row["deepest"]

        def step(row: dict | None) -> list[tuple]:
            if row is None:
                if {r["kind"] for r in held} == {"heading"} and state["chunk"] and state["before"] != {"front_matter"}:
                    state["chunk"] -= 1  # a tail of headings joins the chunk before
                return close()
            if row["kind"] == "front_matter":
                out = close()
                held.append(row)
                return out + close()
            out = close() if closes(row) else []
            held.append(row)
            state["tokens"] += row["tokens"]
            return out

        return step

    return start


def coarse_chunks(elements: DataFrame, tokens: Column, soft_min: int = SOFT_MIN) -> DataFrame:
    """doc_id, position, chunk, trail and boundary of every element that is shown: noise and suppressed ones are dropped.

    A chunk closes before a heading or boundary once it has ``soft_min`` tokens (``tokens`` of each element), before every
    hard boundary, and before a heading that leaves its level, unless both are leaves of the document's deepest level;
    headings alone never close, and at the end join the chunk before. Front matter stands alone.
    """
    shown = with_paths(elements).where(~F.col("kind").isin(*NOISE))
    if "suppressed" in elements.columns:
        shown = shown.where(~F.coalesce("suppressed", F.lit(False)))
    shown = stored(shown, "elements")  # read twice, and dear: elements, boundaries and paths
    level = F.when((F.col("kind") == "heading") & F.col("level").between(1, DEEPEST), F.col("level").cast("int"))
    slim = shown.select(
        "doc_id", "position", "kind", level.alias("level"), tokens.cast("long").alias("tokens"), F.col("boundary").isNotNull().alias("opens"), F.coalesce("boundary.hard", F.lit(False)).alias("hard"),
        F.coalesce(F.col("boundary.kind") != "legal_article", F.lit(False)).alias("titled"), F.max(level).over(Window.partitionBy("doc_id")).alias("deepest"),
    )
    numbered = in_order(slim, "doc_id", ["position"], "doc_id long, position long, chunk int", _chunker(soft_min))
    return shown.join(numbered, ["doc_id", "position"])


def gathered(numbered: DataFrame) -> DataFrame:
    """Chunks of ``coarse_chunks``: doc_id, chunk, first_line, last_line, kinds, trail (of the last element), elements and content."""
    part = F.struct("position", "body")
    listed = numbered.groupBy("doc_id", "chunk").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.max_by("trail", "position").alias("trail"),
        F.count(F.lit(1)).alias("elements"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["body"]), "\n\n").alias("content"),
    )
    return listed
