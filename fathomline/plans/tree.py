"""Queries of trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import tree as op
from fathomline.plans.chunking import coarse_chunks, md_elements
from fathomline.sources.tables import table


@query("folder_cycle", "WITH RECURSIVE t AS (SELECT c_custkey AS node, c_custkey // 3 AS up, 1 AS n FROM customer WHERE c_custkey > 0 UNION ALL SELECT node, up // 3, n + 1 FROM t WHERE up > 0) SELECT node, CAST(max(n) AS INTEGER) AS depth, false AS cyclic FROM t GROUP BY node")
def folder_cycle(spark, sf):
    """Folders numbered so that the parent of n is n // 3; no node is its own ancestor."""
    nodes = table(spark, sf, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("node"), F.expr("nullif(c_custkey div 3, 0)").alias("parent"))
    return op.paths(nodes).select("node", F.size("path").alias("depth"), "cyclic")


@query("heading_tree")
def heading_tree(spark, sf):
    e = md_elements(spark, sf).where("kind = 'heading'")
    below = Window.partitionBy("doc_id").orderBy("position")
    headings = e.withColumn("last_line", F.coalesce(F.lead("first_line").over(below) - 1, F.lit(1 << 30)))
    chunks = coarse_chunks(spark, sf).select("doc_id", "chunk", F.col("first_line").alias("chunk_first"), F.col("last_line").alias("chunk_last"))
    return op.attach(headings.select("doc_id", F.col("position").alias("heading"), "first_line", "last_line"), chunks)
