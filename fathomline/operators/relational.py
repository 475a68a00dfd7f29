"""Relational operators that several queries share: first of a group, neighbours, accuracy, counts, shares, dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; what a NOT EXISTS over earlier siblings finds, without its inequality join."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def neighbours(chunks: DataFrame, evidence: DataFrame, before: int, after: int) -> DataFrame:
    """Chunks around each piece of evidence (evidence_id, doc_id, at), with their relation.

    The band is short, so each evidence row names its neighbours' indices and the join is on equality.
    """
    named = evidence.withColumn("chunk_index", F.explode(F.sequence(F.col("at") - before, F.col("at") + after)))
    relation = F.when(F.col("chunk_index") < F.col("at"), "before").when(F.col("chunk_index") == F.col("at"), "current").otherwise("after")
    return chunks.join(named, ["doc_id", "chunk_index"]).select("evidence_id", "chunk_id", relation.alias("relation"))


def cell_accuracy(gold: DataFrame, said: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Share of cells that agree, over cells that either side has."""
    both = gold.join(said, keys, "full_outer").withColumn("same", F.col("gold").eqNullSafe(F.col("said")))
    good = F.count_if(F.col("same"))
    return both.groupBy(by).agg(F.count(F.lit(1)).alias("cells"), good.alias("right_cells"), F.round(good / F.count(F.lit(1)), 6).alias("accuracy"))


def counts_with_zeros(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of the given values, 0 for those that don't occur."""
    named = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return named.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").na.fill({"n": 0})


def verdict(metrics: DataFrame, threshold: float) -> DataFrame:
    """``value`` rounded and PASS, FAIL or (null) NOT_EVALUABLE."""
    word = F.when(F.col("value").isNull(), "NOT_EVALUABLE").when(F.col("value") >= threshold, "PASS").otherwise("FAIL")
    return metrics.withColumn("verdict", word).withColumn("value", F.round("value", 6))


def shares(rows: DataFrame, value: str) -> DataFrame:
    """Percent of the total (null if any value is negative or the total isn't positive) and of the largest absolute value.

    The totals are one row, joined to the rows, instead of a window that would bring all rows into one task.
    """
    totals = rows.agg(F.sum(value).alias("_sum"), F.min(value).alias("_min"), F.max(F.abs(value)).alias("_most"))
    both = rows.crossJoin(F.broadcast(totals))  # one row
    share = F.when((F.col("_min") < 0) | (F.col("_sum") <= 0), None).otherwise(F.round(100 * F.col(value) / F.col("_sum"), 6))
    return both.withColumns({"share": share, "bar": F.round(100 * F.abs(value) / F.nullif(F.col("_most"), F.lit(0.0)), 6)}).drop("_sum", "_min", "_most")


def repeated_edges(lines: DataFrame, scope: str, page: str, text: str, share: float) -> DataFrame:
    """Texts on at least ``max(2, ceil(share * pages))`` distinct pages of their scope."""
    pages = lines.select(scope, page).distinct().groupBy(scope).agg(F.count(F.lit(1)).alias("_every"))
    found = lines.select(scope, page, text).distinct().groupBy(scope, text).agg(F.count(F.lit(1)).alias("pages"))
    return found.join(pages, scope).where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(share * F.col("_every")))).drop("_every")


def classify(rows: DataFrame, key: str, text: str, words: list[tuple[str, str, int]]) -> DataFrame:
    """Class with the highest sum of word weights, and its lead over the next. The dictionary is a literal, a column for each class."""
    classes = sorted({c for _, c, _ in words})
    score = {c: F.sum(sum((F.col(text).contains(w).cast("int") * n for w, k, n in words if k == c), F.lit(0))) for c in classes}
    summed = rows.groupBy(key).agg(*(s.alias(c) for c, s in score.items()))
    listed = F.filter(F.array(*(F.struct((-F.col(c)).alias("minus"), F.lit(c).alias("class")) for c in classes)), lambda x: x["minus"] < 0)
    ordered = summed.select(key, F.array_sort(listed).alias("o")).where("size(o) > 0")
    second = F.coalesce(-F.try_element_at("o", F.lit(2))["minus"], F.lit(0))
    return ordered.select(key, F.col("o")[0]["class"].alias("class"), (-F.col("o")[0]["minus"]).alias("score"), (-F.col("o")[0]["minus"] - second).alias("margin"))


def semantic_neighbours(rows: DataFrame, id_: str, counts: Column, keys: list[str], order: list[str]) -> DataFrame:
    """The nearest rows before and after that count."""
    own = F.when(counts, F.col(id_))
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.select(id_, before.alias("before_id"), after.alias("after_id"))


def intersect_or_all(asked: DataFrame, available: DataFrame) -> DataFrame:
    """What both sides hold; everything available if that is nothing."""
    both = asked.intersect(available)
    nothing = both.agg((F.count(F.lit(1)) == 0).alias("_nothing"))
    rest = available.distinct().crossJoin(F.broadcast(nothing)).where("_nothing").drop("_nothing")  # one row
    return both.unionByName(rest)


#: Characters of a gram, and grams of a run whose least hash stands for it.
GRAM_CHARS, RUN_GRAMS = 12, 16


def run_hashes(text: str | None, gram: int, run: int, first: bool = False) -> np.ndarray:
    """The least gram hash of every run of ``run`` grams of ``text``, each once, or of the first run only; none if it has fewer grams."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if first:
        codes = codes[: gram + run - 1]
    n = len(codes) - gram + 1
    if n < run:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    h ^= h >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, run).min(axis=1)).view(np.int64)


def _run_seeds(rows: DataFrame, key: str, text: str, gram: int, run: int, first: bool) -> DataFrame:
    """key and seed: the run hashes of every text, in Arrow batches."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [run_hashes(t, gram, run, first) for t in b.column(1).to_pylist()]
            keys = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], [key, "seed"])

    return rows.select(key, text).mapInArrow(seeds, f"{key} {rows.schema[key].dataType.simpleString()}, seed long")


def containing(documents: DataFrame, excerpts: DataFrame) -> DataFrame:
    """item_id and doc_id wherever ``s`` of a document (doc_id, s) holds the whole ``excerpt`` of an item (item_id, excerpt).

    An excerpt's first run of grams lies whole in every text that holds it, so that its least hash is among the text's.
    These join by equality, so that no excerpt meets every document; then the whole texts decide. The shortest excerpt sets
    the lengths. Null or empty excerpts are held by nothing.
    """
    asked = excerpts.where("excerpt <> ''")
    least = asked.agg(F.min(F.length("excerpt"))).first()[0] or 1
    gram = min(GRAM_CHARS, least)
    run = min(RUN_GRAMS, least - gram + 1)
    named = _run_seeds(asked, "item_id", "excerpt", gram, run, first=True)
    pairs = _run_seeds(documents, "doc_id", "s", gram, run, first=False).join(named, "seed").select("item_id", "doc_id").distinct()
    whole = pairs.join(asked, "item_id").join(documents, "doc_id")
    return whole.where(F.contains("s", "excerpt")).select("item_id", "doc_id").distinct()
