"""Queries of predicates, joins, aggregates, windows and set operations over the stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import relational as op
from fathomline.sources.tables import CHUNKS_SQL, chunks, dataset_of, table

# predicates and projections


@query("heading_prefix", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE starts_with(content, 'The ')")
def heading_prefix(spark, sf):
    return chunks(spark, sf).where(F.col("content").startswith("The ")).select("chunk_id")


@query("chunk_search", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE contains(content, '%%%') OR contains(chunk_id, '77:')")
def chunk_search(spark, sf):
    return chunks(spark, sf).where(F.col("content").contains("%%%") | F.col("chunk_id").contains("77:")).select("chunk_id")


@query("doc_listing", "SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('de', 'fr') ORDER BY n_chars DESC, doc_id LIMIT 50")
def doc_listing(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("tuple_in", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'P')")
def tuple_in(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("l_linenumber"))
    return table(spark, sf, "lineitem").join(wanted, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("chunk_listing", f"WITH {CHUNKS_SQL} SELECT dataset_id, chunk_id, doc_id, chunk_index, length(content) AS n_chars, substring(content, 1, 20) AS preview FROM chunks")
def chunk_listing(spark, sf):
    return chunks(spark, sf).select("dataset_id", "chunk_id", "doc_id", "chunk_index", F.length("content").alias("n_chars"), F.substring("content", 1, 20).alias("preview"))


# joins


@query("chunk_sources", f"WITH {CHUNKS_SQL} SELECT c.chunk_id, d.lang, d.source, d.n_chars FROM chunks c JOIN documents d ON c.doc_id = d.doc_id AND c.dataset_id = CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INTEGER)")
def chunk_sources(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", dataset_of("source").alias("dataset_id"), "lang", "source", "n_chars")
    return chunks(spark, sf).join(docs, ["doc_id", "dataset_id"]).select("chunk_id", "lang", "source", "n_chars")


@query("first_ref_anti", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND (b.l_quantity < a.l_quantity OR (b.l_quantity = a.l_quantity AND (b.l_linenumber, b.l_partkey) < (a.l_linenumber, a.l_partkey))))")
def first_ref_anti(spark, sf):
    """No earlier sibling exists: the anti join with an inequality is a row number."""
    return op.first_of(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("heading_preview", "SELECT l_orderkey, l_linenumber, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place = 1")
def heading_preview(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    return op.first_of(table(spark, sf, "lineitem").withColumn("n", n), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "n")


@query(
    "neighbor_expand",
    f"WITH {CHUNKS_SQL}, e AS (SELECT chunk_id AS evidence_id, doc_id, chunk_index AS at FROM chunks WHERE regexp_matches(content, '[0-9]')) "
    "SELECT e.evidence_id, c.chunk_id, CASE WHEN c.chunk_index < e.at THEN 'before' WHEN c.chunk_index = e.at THEN 'current' ELSE 'after' END AS relation FROM e JOIN chunks c ON c.doc_id = e.doc_id AND c.chunk_index BETWEEN e.at - 2 AND e.at + 1",
)
def neighbor_expand(spark, sf):
    every = chunks(spark, sf)
    evidence = every.where("content rlike '[0-9]'").select(F.col("chunk_id").alias("evidence_id"), "doc_id", F.col("chunk_index").alias("at"))
    return op.neighbours(every, evidence, 2, 1)


@query(
    "interval_overlap",
    "SELECT a.event_id AS a_id, b.event_id AS b_id FROM (SELECT event_id, user_id, event_id AS s, event_id + CAST(value AS BIGINT) % 40 AS e FROM events WHERE event_type = 'error') a JOIN (SELECT event_id, user_id, event_id AS s, event_id + 30 AS e FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.s <= b.e AND a.e >= b.s",
)
def interval_overlap(spark, sf):
    e = table(spark, sf, "events")
    width = F.round("value").cast("long") % 40
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("a_id"), "user_id", F.col("event_id").alias("s1"), (F.col("event_id") + width).alias("e1"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b_id"), "user_id", F.col("event_id").alias("s2"), (F.col("event_id") + 30).alias("e2"))
    return a.join(b, "user_id").where("s1 <= e2 and e1 >= s2").select("a_id", "b_id")


@query(
    "evidence_check",
    f"WITH {CHUNKS_SQL}, e AS (SELECT event_id, user_id || ':' || event_id % 12 AS chunk_id, sha256(CAST(event_id % 3 AS VARCHAR)) AS said FROM events) "
    "SELECT event_id, c.chunk_id IS NOT NULL AS found, coalesce(length(c.content) > 100, false) AS long_enough FROM e LEFT JOIN chunks c USING (chunk_id)",
)
def evidence_check(spark, sf):
    said = table(spark, sf, "events").select("event_id", F.concat_ws(":", "user_id", F.col("event_id") % 12).alias("chunk_id"))
    frozen = chunks(spark, sf).select("chunk_id", F.length("content").alias("n"))
    return said.join(frozen, "chunk_id", "left").select("event_id", F.col("n").isNotNull().alias("found"), F.coalesce(F.col("n") > 100, F.lit(False)).alias("long_enough"))


@query(
    "cell_accuracy",
    "WITH g AS (SELECT l_orderkey % 50 AS t, l_linenumber AS r, l_partkey % 7 AS c, max(l_quantity) AS v FROM lineitem WHERE l_tax > 0.01 GROUP BY ALL), p AS (SELECT l_orderkey % 50 AS t, l_linenumber AS r, l_partkey % 7 AS c, max(l_quantity) AS v FROM lineitem WHERE l_discount > 0.01 GROUP BY ALL) "
    "SELECT t, count(*) AS cells, count(*) FILTER (WHERE g.v IS NOT DISTINCT FROM p.v) AS right_cells, round(count(*) FILTER (WHERE g.v IS NOT DISTINCT FROM p.v) / count(*), 6) AS accuracy FROM g FULL JOIN p USING (t, r, c) GROUP BY t",
)
def cell_accuracy(spark, sf):
    item = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("t"), F.col("l_linenumber").alias("r"), (F.col("l_partkey") % 7).alias("c"), "l_tax", "l_discount", "l_quantity")
    gold = item.where("l_tax > 0.01").groupBy("t", "r", "c").agg(F.max("l_quantity").alias("gold"))
    said = item.where("l_discount > 0.01").groupBy("t", "r", "c").agg(F.max("l_quantity").alias("said"))
    return op.cell_accuracy(gold, said, ["t", "r", "c"], "t")


# aggregates


@query("queue_counts", "SELECT s AS status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['error', 'purchase', 'view', 'DEAD']) AS s) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON s = event_type")
def queue_counts(spark, sf):
    return op.counts_with_zeros(table(spark, sf, "events"), "event_type", ["error", "purchase", "view", "DEAD"]).withColumnRenamed("event_type", "status")


READY = "SELECT d.dataset_id, count(l.doc_id) AS ready FROM (SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS dataset_id FROM documents) d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) l USING (doc_id) GROUP BY d.dataset_id"


@query("dataset_ready", READY)
def dataset_ready(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1 and toxic = 0").select("doc_id", F.lit(1).alias("good"))
    docs = table(spark, sf, "documents").select("doc_id", dataset_of("source").alias("dataset_id"))
    return docs.join(good, "doc_id", "left").groupBy("dataset_id").agg(F.count("good").alias("ready"))


@query("active_leases", "SELECT user_id, count(*) FILTER (WHERE value > 50 AND ts > TIMESTAMP '2024-01-15 00:00:00') AS active, count(*) AS every FROM events GROUP BY user_id")
def active_leases(spark, sf):
    live = (F.col("value") > 50) & (F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(live).alias("active"), F.count(F.lit(1)).alias("every"))


@query("doc_payload", "SELECT source, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY source")
def doc_payload(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@query("budget_fit", "SELECT doc_id, CAST(length(text) // 4 + 200 AS INTEGER) AS tokens, length(text) // 4 + 200 <= 800 AS fits FROM documents WHERE text IS NOT NULL")
def budget_fit(spark, sf):
    tokens = F.expr("cast(length(text) div 4 + 200 as int)")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", tokens.alias("tokens"), (tokens <= 800).alias("fits"))


@query("usage_summary", "SELECT event_type, count(*) AS calls, round(sum(value), 2) AS total, round(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 2) AS k_total FROM events GROUP BY event_type")
def usage_summary(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("total"), F.sum(k).cast("double").alias("k_total"))


@query("usage_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY 1 DESC")
def usage_daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("total")).orderBy(F.desc("day"))


@query("next_turn", "SELECT conv_id, coalesce(max(turn), 0) + 1 AS next_turn FROM conversations GROUP BY conv_id")
def next_turn(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_turn"))


@query("conv_counts", "SELECT c.conv_id, count(t.turn) AS turns FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN conversations t ON c.conv_id = t.conv_id AND t.role = 'user' GROUP BY c.conv_id")
def conv_counts(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"))


@query("metric_verdict", "SELECT event_type, round(avg(value), 6) AS value, CASE WHEN count(*) = 0 THEN 'NOT_EVALUABLE' WHEN avg(value) >= 50 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events GROUP BY event_type")
def metric_verdict(spark, sf):
    return op.verdict(table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("value")), 50.0)


@query("multiset_diff", "SELECT l_partkey % 100 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey % 100, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
def multiset_diff(spark, sf):
    rows = table(spark, sf, "lineitem")
    kept = lambda flag: rows.where(F.col("l_returnflag") == flag).select((F.col("l_partkey") % 100).alias("k"), F.col("l_linenumber").alias("n"))
    return kept("R").exceptAll(kept("A"))


@query("latency_pct", "SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(value, 0.99) AS DOUBLE) AS p99 FROM events GROUP BY event_type")
def latency_pct(spark, sf):
    p = [F.expr(f"percentile_disc({q}) within group (order by value)").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return table(spark, sf, "events").groupBy("event_type").agg(*p)


@query("share_total", "SELECT n_nationkey, CASE WHEN min(v) OVER () < 0 OR sum(v) OVER () <= 0 THEN NULL ELSE round(100 * v / sum(v) OVER (), 6) END AS share, round(100 * abs(v) / max(abs(v)) OVER (), 6) AS bar FROM (SELECT c_nationkey AS n_nationkey, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1)")
def share_total(spark, sf):
    v = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    return op.shares(v, "v").select("n_nationkey", "share", "bar")


EDGE = f"WITH {CHUNKS_SQL}, e AS (SELECT dataset_id, content, count(DISTINCT doc_id) AS pages FROM chunks GROUP BY ALL), t AS (SELECT dataset_id, count(DISTINCT doc_id) AS every FROM chunks GROUP BY 1) SELECT dataset_id, content, pages FROM e JOIN t USING (dataset_id) WHERE pages >= greatest(2, ceil(0.03 * every))"


@query("edge_noise", EDGE)
def edge_noise(spark, sf):
    return op.repeated_edges(chunks(spark, sf), "dataset_id", "doc_id", "content", 0.03)


@query("classify_text", f"WITH {CHUNKS_SQL}, k AS (SELECT * FROM (VALUES ('the', 'report', 2), ('of', 'report', 1), ('der', 'notice', 3), ('les', 'letter', 2)) AS v(word, class, weight)), s AS (SELECT doc_id, class, sum(weight) AS score FROM chunks JOIN k ON contains(content, word) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS place, score - lead(score, 1, 0) OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS margin FROM s) SELECT doc_id, class, CAST(score AS BIGINT) AS score, CAST(margin AS BIGINT) AS margin FROM r WHERE place = 1")
def classify_text(spark, sf):
    return op.classify(chunks(spark, sf), "doc_id", "content", [("the", "report", 2), ("of", "report", 1), ("der", "notice", 3), ("les", "letter", 2)])


@query("report_likeness", f"WITH {CHUNKS_SQL}, s AS (SELECT doc_id, sum(CAST(contains(content, 'the') AS INT) * 2 + CAST(contains(content, 'of') AS INT)) AS score FROM chunks GROUP BY doc_id) SELECT doc_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def report_likeness(spark, sf):
    score = F.sum(F.col("content").contains("the").cast("int") * 2 + F.col("content").contains("of").cast("int"))
    return chunks(spark, sf).groupBy("doc_id").agg(score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query("table_ab", "SELECT a.l_returnflag AS kind, a.n AS n_a, b.n AS n_b, round(b.v - a.v, 4) + 0 AS diff FROM (SELECT l_returnflag, count(*) AS n, avg(l_tax) AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) a JOIN (SELECT l_returnflag, count(*) AS n, avg(l_tax) AS v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) b USING (l_returnflag)")
def table_ab(spark, sf):
    even = F.col("l_linenumber") % 2 == 0
    both = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count_if(even).alias("n_a"), F.count_if(~even).alias("n_b"), (F.round(F.avg(F.when(~even, F.col("l_tax"))) - F.avg(F.when(even, F.col("l_tax"))), 4) + 0.0).alias("diff"))
    return both.where("n_a > 0 and n_b > 0")


@query("manifest_hash", f"WITH {CHUNKS_SQL} SELECT doc_id, sha256('[' || string_agg('{{\"chunk_index\":' || chunk_index || ',\"hash\":\"' || sha256(content) || '\"}}', ',' ORDER BY chunk_index) || ']') AS manifest FROM chunks GROUP BY doc_id")
def manifest_hash(spark, sf):
    listed = F.sort_array(F.collect_list(F.struct("chunk_index", F.sha2("content", 256).alias("hash"))))  # the chunks of one document
    return chunks(spark, sf).groupBy("doc_id").agg(F.sha2(F.to_json(listed), 256).alias("manifest"))


# windows


@query("chunk_positions", "SELECT l_partkey, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3")
def chunk_positions(spark, sf):
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, sf, "lineitem").withColumn("place", place).where("place <= 3").select("l_partkey", "l_orderkey", "l_linenumber", "place")


@query("heading_occ", f"WITH {CHUNKS_SQL} SELECT chunk_id, row_number() OVER (PARTITION BY doc_id, content ORDER BY chunk_index) - 1 AS occurrence, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS sibling FROM chunks")
def heading_occ(spark, sf):
    same, parent = Window.partitionBy("doc_id", "content").orderBy("chunk_index"), Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks(spark, sf).select("chunk_id", (F.row_number().over(same) - 1).alias("occurrence"), (F.row_number().over(parent) - 1).alias("sibling"))


@query("strict_bounds", "SELECT o_custkey, bool_and(coalesce(o_orderkey > prev, true)) AS strict FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) GROUP BY o_custkey")
def strict_bounds(spark, sf):
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").withColumn("prev", before).groupBy("o_custkey").agg(F.bool_and(F.coalesce(F.col("o_orderkey") > F.col("prev"), F.lit(True))).alias("strict"))


@query(
    "neighbor_elem",
    "SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id, first_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_id FROM events",
)
def neighbor_elem(spark, sf):
    return op.semantic_neighbours(table(spark, sf, "events"), "event_id", F.col("event_type") != "view", ["user_id"], ["ts", "event_id"])


@query("short_history", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def short_history(spark, sf):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").withColumn("place", place).where("place <= 4").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("seq_prefix", "WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT a.l_orderkey, a.l_linenumber FROM n a WHERE EXISTS (SELECT 1 FROM n b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)")
def seq_prefix(spark, sf):
    n = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    after = F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return n.withColumn("after", after).where("after = l_linenumber + 1").select("l_orderkey", "l_linenumber")


# sets


@query("stale_ids", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE length(content) > 20 EXCEPT SELECT chunk_id FROM chunks WHERE length(content) > 200")
def stale_ids(spark, sf):
    every = chunks(spark, sf)
    return every.where(F.length("content") > 20).select("chunk_id").join(every.where(F.length("content") > 200).select("chunk_id"), "chunk_id", "left_anti")


@query("sources_intersect", "SELECT DISTINCT source FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'es'")
def sources_intersect(spark, sf):
    docs = table(spark, sf, "documents")
    return op.intersect_or_all(docs.where("lang = 'de'").select("source"), docs.where("lang = 'es'").select("source"))


@query("ordered_unique", "SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY ALL")
def ordered_unique(spark, sf):
    return op.first_of(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_event"))


@query("subset_check", "SELECT o_custkey, len(list_filter(list_distinct(list(o_orderstatus)), lambda x: NOT list_contains(['F', 'O'], x))) = 0 AS subset FROM orders GROUP BY o_custkey")
def subset_check(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).select("o_custkey", (F.size(F.array_except("s", F.array(F.lit("F"), F.lit("O")))) == 0).alias("subset"))


@query("purge_anti", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def purge_anti(spark, sf):
    return chunks(spark, sf).join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("chunk_id")
