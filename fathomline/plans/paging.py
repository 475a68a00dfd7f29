"""Queries of pagination and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import paging as op
from fathomline.sources.tables import CHUNKS_SQL, chunks, table


@query("chunk_page", f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id, chunk_index, (SELECT count(*) FROM chunks WHERE dataset_id = 2) AS total FROM chunks WHERE dataset_id = 2 ORDER BY doc_id, chunk_index LIMIT 25 OFFSET 50")
def chunk_page(spark, sf):
    rows = chunks(spark, sf).where("dataset_id = 2").select("chunk_id", "doc_id", "chunk_index")
    return op.page(rows, [F.col("doc_id"), F.col("chunk_index")], 50, 25)


@query("page_has_more", "SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') > 30 AS has_more FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20 OFFSET 10")
def page_has_more(spark, sf):
    return op.has_more(table(spark, sf, "events").where("event_type = 'error'").select("event_id", "user_id"), [F.col("event_id")], 10, 20)


@query("keyset_page", "SELECT o_custkey, o_totalprice, o_orderkey FROM orders WHERE o_custkey > 500 OR (o_custkey = 500 AND (o_totalprice > 1000.0 OR (o_totalprice = 1000.0 AND o_orderkey > 7))) ORDER BY o_custkey, o_totalprice, o_orderkey LIMIT 40")
def keyset_page(spark, sf):
    keys = ["o_custkey", "o_totalprice", "o_orderkey"]
    return table(spark, sf, "orders").where(op.after(keys, [500, 1000.0, 7])).select(*keys).orderBy(*keys).limit(40)


@query("reconcile_page", "SELECT event_id, event_type FROM events WHERE event_id > 321 ORDER BY event_id LIMIT 100")
def reconcile_page(spark, sf):
    return table(spark, sf, "events").where("event_id > 321").select("event_id", "event_type").orderBy("event_id").limit(100)


@query("submission_page", "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, n_name FROM pages JOIN nation ON page_id % 25 = n_nationkey WHERE contains(url, '/en/') ORDER BY page_id DESC LIMIT 15 OFFSET 5")
def submission_page(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf, "pages").where(F.col("url").contains("/en/")).join(nation, F.col("page_id") % 25 == F.col("n_nationkey"))
    return rows.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), "n_name").orderBy(F.desc("page_id")).offset(5).limit(15)


@query(
    "report_runs",
    "WITH r AS (SELECT o_orderkey, o_orderdate, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30), a AS (SELECT l_orderkey, count(*) AS artifacts FROM lineitem GROUP BY 1) SELECT o_orderkey, c_name, coalesce(artifacts, 0) AS artifacts FROM r LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN a ON l_orderkey = o_orderkey",
)
def report_runs(spark, sf):
    runs = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30)
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    own = table(spark, sf, "lineitem").join(F.broadcast(runs.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")  # thirty runs
    artifacts = own.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("artifacts"))
    return runs.join(names, "o_custkey", "left").join(artifacts, "o_orderkey", "left").select("o_orderkey", "c_name", F.coalesce("artifacts", F.lit(0)).alias("artifacts"))
