"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

The edges stay distributed; each step is a grouped minimum (combined before the shuffle) and a join. Where a node has more than
HOT_EDGES edges, as the centre of a large component comes to have, its edges are dealt into parts in these joins. Before a round is
written, each task turns every TASK_EDGES of its edges into the stars of their own components, which leaves fewer edges and rounds.
Rounds go on until nothing changes: no step raises a node's least neighbour or adds edges, and where the stars are not final the
star steps lower one of the two. Every round is checkpointed in the shared folder, so that a lost executor repeats one round at
most; the few edges of a small graph are handled by few tasks throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import bounded_batches, materialise
from fathomline.operators.skew import attach

#: Edges of one node beyond which they are dealt into parts, and edges that a task holds at once (and reads, where there are as many).
HOT_EDGES, TASK_EDGES = 50_000, 20_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (u, v) but the least of its component, and that least node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
    root = np.asarray(parent, np.int64)
    while not (root[root] == root).all():
        root = root[root]
    own = np.flatnonzero(root != np.arange(len(root)))
    return nodes[own], nodes[root[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) as stars, within each task and TASK_EDGES edges at a time: the same nodes, connected as before."""
    bounded_batches(edges.sparkSession)
    most = TASK_EDGES

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays(list(map(pa.array, stars(t.column("u").to_numpy(), t.column("v").to_numpy()))), ["u", "v"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > most:
                yield star(held)
                held = []
            held.append(batch)
        if held:
            yield star(held)

    return edges.mapInArrow(rows, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (u, v: long, u != v)."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = now.count(), None
    if before[0]:
        now = materialise(contracted(now.coalesce(before[0] // TASK_EDGES + 1)))
        before = _state(now)
    while before[0]:
        tasks = before[0] // TASK_EDGES + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        hot = before[0] > HOT_EDGES and not both.groupBy("u").count().where(F.col("count") > HOT_EDGES).isEmpty()

        def least_of(rows: DataFrame, least: DataFrame, hot: bool = hot) -> DataFrame:
            return attach(rows, least, ["u"], "v") if hot else rows.join(least, "u")

        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = least_of(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = least_of(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks).distinct()
        now = materialise(contracted(pairs.coalesce(tasks)))
        after = _state(now)
        if after == before:
            break
        before = after
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
