"""Queries of report records."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import reports as op
from fathomline.sources.tables import table


@query(
    "field_validate",
    "SELECT o_orderkey, list_filter([CASE WHEN o_totalprice BETWEEN 1000 AND 200000 THEN NULL ELSE 'range' END, CASE WHEN regexp_matches(o_orderpriority, '^[1-3]-') THEN NULL ELSE 'pattern' END, CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE 'choice' END, CASE WHEN o_orderdate <= TIMESTAMP '1999-12-31' THEN NULL ELSE 'date' END], lambda x: x IS NOT NULL) AS errors FROM orders",
)
def field_validate(spark, sf):
    rules = {"range": F.col("o_totalprice").between(1000, 200000), "pattern": F.col("o_orderpriority").rlike("^[1-3]-"), "choice": F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") <= F.lit("1999-12-31").cast("timestamp")}
    return table(spark, sf, "orders").select("o_orderkey", op.errors(rules).alias("errors"))


@query(
    "keyed_patch",
    "SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(b.v, a.v) AS value, a.event_id IS NULL AS appended, coalesce(a.event_id, b.event_id) AS place FROM (SELECT event_id, value AS v FROM events WHERE event_type <> 'view') a FULL JOIN (SELECT event_id, value + 1 AS v, event_type = 'error' AS removed FROM events WHERE value > 50) b ON a.event_id = b.event_id WHERE NOT coalesce(b.removed, false)",
)
def keyed_patch(spark, sf):
    e = table(spark, sf, "events").withColumn("place", F.col("event_id"))
    changes = e.where("value > 50").select("event_id", "place", (F.col("value") + 1).alias("value"), (F.col("event_type") == "error").alias("removed"))
    return op.patch(e.where("event_type <> 'view'"), changes, "event_id", "place", "value")


@query("block_series", "SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) AS label, unnest(list(o_totalprice ORDER BY o_orderkey)) AS point FROM orders GROUP BY o_custkey")
def block_series(spark, sf):
    """Series blocks held as two parallel arrays, taken apart again."""
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))  # the orders of one customer
    blocks = table(spark, sf, "orders").groupBy("o_custkey").agg(pairs.alias("p")).select("o_custkey", F.col("p.o_orderkey").alias("labels"), F.col("p.o_totalprice").alias("points"))
    return blocks.select("o_custkey", F.inline(F.arrays_zip("labels", "points")).alias("label", "point"))


@query("ir_validate")
def ir_validate(spark, sf):
    """Ledger rows against their evidence: the citation exists, the value parses, and the formula's total agrees."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    ledger = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rules = {"no_evidence": F.col("n").isNotNull(), "no_value": F.col("o_totalprice").isNotNull(), "formula": F.abs(F.col("o_totalprice") - F.col("total")) < 1.0}
    return ledger.select("o_orderkey", op.errors(rules).alias("issues"))
