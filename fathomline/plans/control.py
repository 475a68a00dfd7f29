"""Queries of the control plane, over ``events`` as messages; streams read the same table with the available-now trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.sources.shared import shared_folder
from fathomline.sources.tables import table
from fathomline.streaming import control as op

MESSAGES = "SELECT event_id AS seq, user_id AS doc_id, CAST(event_id % 7 AS INTEGER) AS attempt, event_type <> 'error' AS ok, value > 80 AS terminal, event_id % 4 AS version FROM events"


def messages(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).cast("int").alias("attempt"), (F.col("event_type") != "error").alias("ok"), (F.col("value") > 80).alias("terminal"), (F.col("event_id") % 4).alias("version"), "ts")


@query("dlq_split", f"SELECT seq, CASE WHEN ok THEN 'DONE' WHEN terminal OR attempt >= 5 THEN 'DEAD' ELSE 'RETRY' END AS route FROM ({MESSAGES})")
def dlq_split(spark, sf):
    return op.route(messages(spark, sf)).select("seq", "route")


@query("retry_delay", f"SELECT seq, CAST([30, 120, 600, 1800][greatest(least(attempt, 4), 1)] AS INTEGER) AS delay FROM ({MESSAGES})")
def retry_delay(spark, sf):
    return messages(spark, sf).select("seq", op.retry_delay(F.col("attempt")).alias("delay"))


@query("stale_drop", f"SELECT seq, m.doc_id FROM ({MESSAGES}) m JOIN customer ON c_custkey = m.doc_id WHERE m.version = c_custkey % 4 AND c_mktsegment NOT IN ('BUILDING')")
def stale_drop(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 4).alias("version"), F.when(F.col("c_mktsegment") == "BUILDING", "READY").otherwise("QUEUED").alias("status"))
    return op.fresh(messages(spark, sf), docs).select("seq", "doc_id")


OUTBOX = "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CLAIMED' ELSE 'SENT' END AS state, ts AS available_at, ts + INTERVAL 60 MINUTE AS lease_until, 'w' || event_id % 5 AS token FROM events"
NOW = "2024-01-12 00:00:00"


def outbox(spark, sf):
    n = F.col("event_id") % 3
    state = F.when(n == 0, "PENDING").when(n == 1, "CLAIMED").otherwise("SENT")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("available_at"), (F.col("ts") + F.expr("interval 60 minutes")).alias("lease_until"), F.concat(F.lit("w"), F.col("event_id") % 5).alias("token"))


@query("outbox_due", f"SELECT id, state FROM ({OUTBOX}) WHERE (state = 'PENDING' AND available_at <= TIMESTAMP '{NOW}') OR (state = 'CLAIMED' AND lease_until <= TIMESTAMP '{NOW}') ORDER BY available_at, id LIMIT 100")
def outbox_due(spark, sf):
    return op.due(outbox(spark, sf), F.lit(NOW).cast("timestamp"), 100).select("id", "state")


@query("lease_fence", f"SELECT id, token = 'w' || id % 4 AND lease_until > TIMESTAMP '{NOW}' AS renewed FROM ({OUTBOX}) WHERE state = 'CLAIMED'")
def lease_fence(spark, sf):
    held = outbox(spark, sf).where("state = 'CLAIMED'")
    asked = held.select("id", F.concat(F.lit("w"), F.col("id") % 4).alias("token"))
    return op.renew(held, asked, F.lit(NOW).cast("timestamp"), 60).select("id", "renewed")


@query("status_transition", f"SELECT id, CASE WHEN state = 'PENDING' THEN 'CLAIMED' WHEN state = 'CLAIMED' AND id % 2 = 0 THEN 'SENT' ELSE state END AS status FROM ({OUTBOX})")
def status_transition(spark, sf):
    rows = outbox(spark, sf).withColumnRenamed("state", "status")
    to = F.when(F.col("status") == "PENDING", "CLAIMED").when(F.col("id") % 2 == 0, "SENT").otherwise("PENDING")
    return op.transition(rows, {"CLAIMED": ("PENDING",), "SENT": ("CLAIMED",)}, to).select("id", "status")


@query("stale_index", f"SELECT id FROM ({OUTBOX}) WHERE state = 'CLAIMED' AND available_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE ORDER BY available_at, id LIMIT 50")
def stale_index(spark, sf):
    old = F.lit(NOW).cast("timestamp") - F.expr("interval 30 minutes")
    return outbox(spark, sf).where((F.col("state") == "CLAIMED") & (F.col("available_at") < old)).orderBy("available_at", "id").limit(50).select("id")


@query("resume_plan", "SELECT l_linenumber AS stage, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'RERUN' ELSE 'SKIP' END AS action FROM lineitem GROUP BY 1")
def resume_plan(spark, sf):
    failed = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("stage")).agg(failed.alias("failed"), F.when(failed > 0, "RERUN").otherwise("SKIP").alias("action"))


def _stream(spark, sf):
    stored = spark.read.parquet(f"{sf}/events.parquet")
    return spark.readStream.schema(stored.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


@query("claim_state")
def claim_state(spark, sf):
    """The claim stream over all messages, drained into a table and read back."""
    base = f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}"
    rows = _stream(spark, sf).where("value is not null").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 4).alias("version"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    op.claim_stream(rows).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, seq long, taken boolean, attempts int").parquet(f"{base}/out")


@query("stream_upsert", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def stream_upsert(spark, sf):
    base = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows = _stream(spark, sf).select("user_id", "event_type", "event_id", "value")
    op.upsert_stream(rows, ["user_id", "event_type"], "event_id", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return op.newest_version(spark, f"{base}/table")
