"""Boundaries of a document's chunks for reading it as a whole, and how far they can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.scan import in_order
from fathomline.sources.shared import stored

DERIVED = "derived_element"


def _monotone():
    """Keeps a chunk that begins behind the last kept one."""

    def start():
        last = [None]

        def step(row: dict | None) -> list[tuple]:
            if row is None or last[0] is not None and row["start_line"] <= last[0]:
                return []
            last[0] = row["end_line"]
            return [(row["doc_id"], row["chunk_id"], row["chunk_index"], row["start_line"], row["end_line"])]

        return step

    return start


def _judged(chunks: DataFrame) -> DataFrame:
    """Source chunks with what their document allows: legacy, approximate, broken and overlapping."""
    by_doc, order = Window.partitionBy("doc_id"), ["chunk_index", "start_line", "chunk_id"]
    before = by_doc.orderBy(*order)
    derived = F.coalesce(F.lower(F.trim("role")) == DERIVED, F.lit(False))
    rows = chunks.where(~derived)
    bad = F.coalesce((F.col("chunk_index") < 0) | (F.col("start_line") < 0) | (F.col("end_line") < F.col("start_line")), F.lit(True)) | F.coalesce(F.col("chunk_index") <= F.lag("chunk_index").over(before), F.lit(False))
    over = F.coalesce(F.col("start_line") <= F.lag("end_line").over(before), F.lit(False))
    rows = rows.withColumns({"_bad": bad, "_over": over})
    every = lambda c: F.bool_or(c).over(by_doc)
    legacy = F.trim(F.coalesce("strategy", F.lit(""))) == ""
    return rows.withColumns({"legacy": every(legacy), "approximate": every(F.coalesce("approximate", F.lit(False))), "broken": every(F.col("_bad")), "overlapping": every(F.col("_over"))}).drop("_bad", "_over")


def boundaries(chunks: DataFrame) -> DataFrame:
    """doc_id, boundary_index, chunk_id, chunk_index, start_line and end_line of the chunks that bound a document's parts.

    ``chunks`` has doc_id, chunk_id, chunk_index, start_line, end_line, role, strategy and approximate. Chunks derived from an element
    bound nothing. Where every chunk names its strategy, all of them bound, if their lines don't overlap (they may where lines are
    approximate); where one doesn't, those that begin behind the last kept one. A document in which a number is missing,
    negative or repeated has no boundaries.
    """
    return _bounding(_judged(chunks))


def _bounding(judged: DataFrame) -> DataFrame:
    sound = judged.where(~F.col("broken"))
    columns = ["doc_id", "chunk_id", "chunk_index", "start_line", "end_line"]
    whole = sound.where(~F.col("legacy") & (F.col("approximate") | ~F.col("overlapping"))).select(columns)
    kinds = dict(sound.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    kept = in_order(sound.where("legacy").select(columns), "doc_id", ["chunk_index", "start_line", "chunk_id"], schema, _monotone())
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    return whole.unionByName(kept).select("doc_id", place.alias("boundary_index"), "chunk_id", "chunk_index", "start_line", "end_line")


def preview_maps(chunks: DataFrame) -> DataFrame:
    """doc_id, boundary_precision, map_reliable, reparse_required, source_chunk_count (boundaries) and derived_chunk_count of every document.

    In documents with chunks of unknown strategy the ones that bound nothing count as derived, and no map is reliable.
    """
    judged = stored(_judged(chunks), "judged")  # read for the boundaries and for the counts
    bounds = _bounding(judged).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    derived = F.coalesce(F.lower(F.trim("role")) == DERIVED, F.lit(False))
    every = chunks.groupBy("doc_id").agg(F.count_if(derived).alias("derived"), F.count_if(~derived).alias("sources"))
    states = judged.groupBy("doc_id").agg(*(F.bool_or(c).alias(c) for c in ("legacy", "approximate", "broken", "overlapping")))
    both = every.join(states, "doc_id", "left").join(bounds, "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    legacy, found = no("legacy"), F.coalesce("n", F.lit(0))
    held = (F.col("sources") > 0) & ~no("broken") & (no("approximate") | ~no("overlapping"))
    precision: Column = F.when(legacy, "legacy_line").when(no("approximate"), "approximate_line").otherwise("line")
    return both.select(
        "doc_id", precision.alias("boundary_precision"), (~legacy & ~no("approximate") & held).alias("map_reliable"), (legacy | ~held).alias("reparse_required"),
        found.alias("source_chunk_count"), (F.col("derived") + F.when(legacy, F.col("sources") - found).otherwise(0)).alias("derived_chunk_count"),
    )
