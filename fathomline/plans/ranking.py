"""Queries of learning-to-rank features, baselines and reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import ranking as op
from fathomline.plans import recall
from fathomline.sources.tables import CHUNKS_SQL, chunks, table

POOL_SQL = f"""
{recall.ROUTES_SQL}, pool AS (
  SELECT query_id, chunk_id, doc_id, max(score) FILTER (WHERE source = 'dense') AS dense, max(score) FILTER (WHERE source = 'sparse') AS sparse, max(score) FILTER (WHERE source = 'bm25') AS bm25
  FROM routes GROUP BY ALL
)
"""


def pool(spark, sf):
    """The candidate pool: raw score of each route, null where it lacks the chunk."""
    return recall.route_hits(spark, sf).groupBy("query_id", "chunk_id", "doc_id").pivot("source", ["dense", "sparse", "bm25"]).agg(F.max("score"))


def pool_with_text(spark, sf):
    asked = recall.questions(spark, sf)
    return pool(spark, sf).join(chunks(spark, sf).select("chunk_id", "content"), "chunk_id").join(asked, "query_id")


@query(
    "ltr_rank_feats",
    f"WITH {POOL_SQL} SELECT query_id, chunk_id, "
    + ", ".join(f"round(CASE WHEN {r} IS NULL THEN 0 ELSE 1e0 / row_number() OVER (PARTITION BY query_id ORDER BY {r} DESC NULLS LAST, chunk_id) END, 9) AS {r}_rr, CAST({r} IS NULL AS INTEGER) AS {r}_missing" for r in op.ROUTES)
    + ", CAST(dense IS NOT NULL AS INTEGER) + CAST(sparse IS NOT NULL AS INTEGER) + CAST(bm25 IS NOT NULL AS INTEGER) AS route_count FROM pool",
)
def ltr_rank_feats(spark, sf):
    out = op.route_features(pool(spark, sf))
    return out.select("query_id", "chunk_id", *(c for r in op.ROUTES for c in (F.round(f"{r}_rr", 9).alias(f"{r}_rr"), f"{r}_missing")), "route_count")


@query(
    "top12_margin",
    f"WITH {recall.ROUTES_SQL}, p AS (SELECT query_id, source, CASE WHEN source = 'dense' THEN score ELSE ln(1 + greatest(score, 0)) END AS s, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS place FROM routes) "
    "SELECT query_id, source, round(coalesce(greatest(max(s) FILTER (WHERE place = 1) - max(s) FILTER (WHERE place = 2), 0) / greatest(abs(max(s) FILTER (WHERE place = 1)), 1e-9), 0), 6) AS margin FROM p GROUP BY query_id, source",
)
def top12_margin(spark, sf):
    out = op.route_features(pool(spark, sf))
    each = out.groupBy("query_id").agg(*(F.max(f"{r}_top12_margin").alias(r) for r in op.ROUTES))
    found = recall.route_hits(spark, sf).select("query_id", "source").distinct()
    return each.unpivot(["query_id"], list(op.ROUTES), "source", "margin").join(found, ["query_id", "source"], "left_semi").withColumn("margin", F.round("margin", 6))


def _baseline_sql() -> str:
    def moved(r: str) -> str:
        return f"CASE WHEN {r} >= {op.THRESHOLDS[r]} THEN {r if r == 'dense' else f'ln(1 + greatest({r}, 0))'} END"

    norms = ", ".join(f"CASE WHEN {r}_m IS NULL THEN 0 WHEN max({r}_m) OVER w = min({r}_m) OVER w THEN 1 ELSE ({r}_m - min({r}_m) OVER w) / (max({r}_m) OVER w - min({r}_m) OVER w) END AS {r}_n, CASE WHEN max({r}_m) OVER w IS NULL THEN 0 ELSE {op.BASE_WEIGHTS[r]} END AS {r}_w" for r in op.ROUTES)
    return (
        f"WITH {POOL_SQL}, m AS (SELECT query_id, chunk_id, " + ", ".join(f"{moved(r)} AS {r}_m" for r in op.ROUTES) + f" FROM pool), n AS (SELECT query_id, chunk_id, {norms} FROM m WINDOW w AS (PARTITION BY query_id)), "
        "s AS (SELECT query_id, chunk_id, round(round(coalesce((" + " + ".join(f"{r}_n * {op.BASE_WEIGHTS[r]}" for r in op.ROUTES) + ") / nullif(" + " + ".join(f"{r}_w" for r in op.ROUTES) + ", 0), 0)::DOUBLE, 9), 6) AS baseline_score FROM n) SELECT * FROM s"
    )


@query("ltr_baseline", _baseline_sql())
def ltr_baseline(spark, sf):
    return op.baseline(pool(spark, sf)).select("query_id", "chunk_id", F.round("baseline_score", 6).alias("baseline_score"))


@query("ltr_rank")
def ltr_rank(spark, sf):
    """Model order by a scorer over the features. No model file is public, so that the scorer is the baseline, which is the fallback too."""
    return op.rank_by(op.features(pool_with_text(spark, sf)), op.baseline_scorer).select("query_id", "chunk_id", F.round("model_score", 6).alias("model_score"), "rank")


@query("ltr_features")
def ltr_features(spark, sf):
    return op.features(pool_with_text(spark, sf)).drop("features")


GRAMS_SQL = "lower(regexp_replace({t}, '[^0-9a-zA-Z一-鿿]', '', 'g'))"


def _grams(t: str, n: int) -> str:
    return f"list_distinct(list_transform(generate_series(1, greatest(length({t}) - {n - 1}, 0)), lambda i: substring({t}, i, {n})))"


TEXT_POOL = f"{POOL_SQL}, texts AS (SELECT p.query_id, p.chunk_id, p.doc_id, {GRAMS_SQL.format(t='b.text')} AS q, {GRAMS_SQL.format(t='c.content')} AS c, b.text AS query, c.content FROM pool p JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = p.query_id)"


@query(
    "ngram_overlap",
    f"WITH {TEXT_POOL}, g AS (SELECT query_id, chunk_id, {_grams('q', 2)} AS q2, {_grams('c', 2)} AS c2, {_grams('q', 3)} AS q3, {_grams('c', 3)} AS c3 FROM texts) "
    "SELECT query_id, chunk_id, round(CASE WHEN len(q2) = 0 THEN 0 ELSE len(list_intersect(q2, c2)) / len(q2) END::DOUBLE, 6) AS bigram_coverage, round(CASE WHEN len(q3) = 0 THEN 0 ELSE len(list_intersect(q3, c3)) / len(q3) END::DOUBLE, 6) AS trigram_coverage FROM g",
)
def ngram_overlap(spark, sf):
    out = op.grams(pool_with_text(spark, sf).select("query_id", "query", "chunk_id", "content"), ["query_bigram_coverage", "query_trigram_coverage"])
    return out.select("query_id", "chunk_id", F.round("query_bigram_coverage", 6).alias("bigram_coverage"), F.round("query_trigram_coverage", 6).alias("trigram_coverage"))


@query("norm_text", f"WITH {CHUNKS_SQL} SELECT chunk_id, {GRAMS_SQL.format(t='content')} AS norm FROM chunks")
def norm_text(spark, sf):
    return chunks(spark, sf).select("chunk_id", op.normal_text(F.col("content")).alias("norm"))


@query("char_ngrams", f"WITH t AS (SELECT item_id, {GRAMS_SQL.format(t='text')} AS x FROM benchmark) SELECT item_id, unnest({_grams('x', 3)}) AS gram FROM t")
def char_ngrams(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(op.char_ngrams(op.normal_text(F.col("text")), 3)).alias("gram"))


@query("needle_cov", f"WITH {TEXT_POOL}, n AS (SELECT query_id, chunk_id, list_distinct(list_filter(string_split(query, ' '), lambda w: length(w) > 4)) AS needles, content FROM texts) SELECT query_id, chunk_id, round(CASE WHEN len(needles) = 0 THEN 0 ELSE len(list_filter(needles, lambda w: contains(content, w))) / len(needles) END::DOUBLE, 6) AS covered FROM n")
def needle_cov(spark, sf):
    needles = F.array_distinct(F.filter(F.split("query", " "), lambda w: F.length(w) > 4))
    return pool_with_text(spark, sf).select("query_id", "chunk_id", F.round(op.contained(needles, F.col("content")), 6).alias("covered"))


@query(
    "cond_cov",
    f"WITH {TEXT_POOL}, p AS (SELECT query_id, chunk_id, {_grams('c', 2)} AS c2, list_filter(list_transform(regexp_split_to_array(query, '[，,。；;？?！!]'), lambda x: trim(x)), lambda x: length(x) >= 2) AS clauses FROM texts), "
    f"m AS (SELECT query_id, chunk_id, clauses, list_filter(list_transform(list_transform(clauses, lambda x: {GRAMS_SQL.format(t='x')}), lambda y: {_grams('y', 2).replace('lambda i', 'lambda j').replace('(y, i,', '(y, j,')}), lambda g: len(g) > 0 AND len(list_intersect(g, c2)) / len(g) >= 0.5) AS met FROM p) "
    "SELECT query_id, chunk_id, round(CASE WHEN len(clauses) <= 1 THEN 0 ELSE len(met) / len(clauses) END::DOUBLE, 6) AS condition_coverage FROM m",
)
def cond_cov(spark, sf):
    return op.grams(pool_with_text(spark, sf).select("query_id", "query", "chunk_id", "content"), ["condition_coverage"]).select("query_id", "chunk_id", F.round("condition_coverage", 6).alias("condition_coverage"))


def bigram_frequencies(pool):
    """In how many chunks of a query's pool each bigram occurs."""
    grams = op.grams(pool.select("query_id", "chunk_id", "content"), ["content_bigram_texts"]).select("query_id", "chunk_id", F.explode("content_bigram_texts").alias("gram"))
    return grams.groupBy("query_id", "gram").agg(F.countDistinct("chunk_id").alias("df"))


@query("bigram_df", f"WITH {TEXT_POOL}, g AS (SELECT DISTINCT query_id, chunk_id, unnest({_grams('c', 2)}) AS gram FROM texts) SELECT query_id, gram, count(*) AS df FROM g GROUP BY ALL")
def bigram_df(spark, sf):
    return bigram_frequencies(pool_with_text(spark, sf))


@query(
    "same_doc_jaccard",
    f"WITH {TEXT_POOL}, g AS (SELECT query_id, chunk_id, doc_id, {_grams('c', 2)} AS c2 FROM texts), p AS (SELECT a.query_id, a.chunk_id, CASE WHEN len(a.c2) + len(b.c2) = 0 THEN 0 ELSE len(list_intersect(a.c2, b.c2)) / (len(a.c2) + len(b.c2) - len(list_intersect(a.c2, b.c2))) END AS j FROM g a JOIN g b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.chunk_id <> b.chunk_id) "
    "SELECT g.query_id, g.chunk_id, CAST(count(p.j) AS INTEGER) AS same_document_count, round(coalesce(max(p.j), 0)::DOUBLE, 6) AS same_document_similarity FROM g LEFT JOIN p USING (query_id, chunk_id) GROUP BY ALL",
)
def same_doc_jaccard(spark, sf):
    held = op.grams(pool_with_text(spark, sf).select("query_id", "doc_id", "chunk_id", "content"), ["content_bigrams"])
    return op.same_document(held).select("query_id", "chunk_id", F.col("same_doc_candidate_count").alias("same_document_count"), F.round("same_doc_max_bigram_similarity", 6).alias("same_document_similarity"))


@query("regex_all", "SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?'), lambda x: x))) AS numbers FROM documents WHERE text IS NOT NULL")
def regex_all(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.][0-9]+)?"), 0))).alias("numbers"))


CLASS_SQL = (
    "SELECT event_id, CASE WHEN regexp_matches(q, '(?i)(v(ersion)?\\s*\\d+(\\.\\d+)*|\\d{4}[-/.年]\\d{1,2}|[A-Za-z]{2,}[-_]?[0-9]{2,}|(^|\\D)\\d{5,})') THEN 'exact_identifier' "
    "WHEN regexp_matches(q, '(\\d+(\\.\\d+)?|[一二三四五六七八九十百]+)\\s*(分钟|小时|天|日|个月|年|次|%|％)') THEN 'number_time' WHEN length(regexp_replace(q, '[\\s，。？！、；：,.?!;:]+', '', 'g')) <= 15 THEN 'short_keyword' "
    "WHEN length(regexp_replace(q, '[\\s，。？！、；：,.?!;:]+', '', 'g')) > 35 THEN 'long_multi' ELSE 'natural_default' END AS class "
    "FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || ' v' || user_id WHEN 1 THEN '查询 ' || user_id || ' 天' WHEN 2 THEN event_type WHEN 3 THEN repeat(event_type || ' ', 8) ELSE repeat(event_type || ' ', 2) || ' of it all' END AS q FROM events)"
)


@query("query_class", CLASS_SQL)
def query_class(spark, sf):
    n, kind, user = F.col("event_id") % 5, F.col("event_type"), F.col("user_id").cast("string")
    q = F.when(n == 0, F.concat(kind, F.lit(" v"), user)).when(n == 1, F.concat(F.lit("查询 "), user, F.lit(" 天"))).when(n == 2, kind).when(n == 3, F.repeat(F.concat(kind, F.lit(" ")), F.lit(8))).otherwise(F.concat(F.repeat(F.concat(kind, F.lit(" ")), F.lit(2)), F.lit(" of it all")))
    return table(spark, sf, "events").select("event_id", op.query_class(q).alias("class"))


@query(
    "slot_rerank",
    f"WITH {recall.FUSED_SQL}, f AS (SELECT query_id, chunk_id, dataset_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS fused_rank, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST((doc_id * 7919) % 1009 AS DOUBLE) END AS rerank_score FROM fused), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY query_id, dataset_id ORDER BY fused_rank) AS slot, row_number() OVER (PARTITION BY query_id, dataset_id ORDER BY rerank_score DESC NULLS LAST, fused_rank) AS fresh FROM f) "
    "SELECT a.query_id, a.chunk_id, a.dataset_id, a.rerank_score, b.fused_rank AS place FROM s a JOIN s b ON a.query_id = b.query_id AND a.dataset_id = b.dataset_id AND a.fresh = b.slot WHERE b.fused_rank <= 12",
)
def slot_rerank(spark, sf):
    from fathomline.operators import recall as rc

    fused = rc.ranked(rc.fuse(recall.route_hits(spark, sf)), ["query_id"]).withColumnRenamed("rank", "fused_rank")
    score = F.when(F.col("doc_id") % 6 == 0, None).otherwise(((F.col("doc_id") * 7919) % 1009).cast("double"))
    return op.slot_rerank(fused.select("query_id", "dataset_id", "chunk_id", "fused_rank", score.alias("rerank_score")), 12)


QUOTA_SQL = f"""
WITH {recall.BM25_SQL}, prefix AS (
  SELECT b.item_id AS query_id, c.chunk_id, row_number() OVER (PARTITION BY b.item_id ORDER BY c.chunk_id) AS place
  FROM benchmark b JOIN chunks c ON starts_with(c.content, substring(b.text, 1, 3)) QUALIFY place <= 12
), scored AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place
  FROM bm25 ANTI JOIN prefix USING (query_id, chunk_id) QUALIFY place <= 12
), n AS (
  SELECT item_id AS query_id, (SELECT count(*) FROM prefix p WHERE p.query_id = item_id) AS np, (SELECT count(*) FROM scored s WHERE s.query_id = item_id) AS ns FROM benchmark
), quota AS (
  SELECT query_id, least(np, greatest(4, 12 - ns)) AS take_p, least(ns, greatest(8, 12 - np)) AS take_s FROM n
)
SELECT query_id, chunk_id, 'prefix' AS origin FROM prefix JOIN quota USING (query_id) WHERE place <= take_p
UNION ALL SELECT query_id, chunk_id, 'bm25' FROM scored JOIN quota USING (query_id) WHERE place <= take_s
"""


@query("quota_merge", QUOTA_SQL)
def quota_merge(spark, sf):
    """A third of twelve places for prefix hits and two thirds for BM25 hits; what one side can't fill goes to the other."""
    asked = recall.questions(spark, sf).select("query_id", F.substring("query", 1, 3).alias("start"))
    lines = chunks(spark, sf).select("chunk_id", F.substring("content", 1, 3).alias("start")).join(asked.select("start").distinct(), "start", "left_semi")
    by_chunk = Window.partitionBy("start").orderBy("chunk_id")  # questions that begin alike have the same hits
    prefix = lines.withColumn("place", F.row_number().over(by_chunk)).where("place <= 12").join(asked, "start").select("query_id", "chunk_id", "place")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = recall.bm25_hits(spark, sf, 24).join(prefix, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", F.row_number().over(by_score).alias("place")).where("place <= 12")
    both = prefix.withColumn("origin", F.lit("prefix")).unionByName(scored.withColumn("origin", F.lit("bm25")))
    every = Window.partitionBy("query_id")
    np_, ns = F.count_if(F.col("origin") == "prefix").over(every), F.count_if(F.col("origin") == "bm25").over(every)
    limit = F.when(F.col("origin") == "prefix", F.least(np_, F.greatest(F.lit(4), 12 - ns))).otherwise(F.least(ns, F.greatest(F.lit(8), 12 - np_)))
    return both.withColumn("limit", limit).where("place <= limit").select("query_id", "chunk_id", "origin")


@query("wiki_page", QUOTA_SQL.replace("SELECT query_id, chunk_id, 'prefix' AS origin", "SELECT query_id, count(*) AS n, count(*) FILTER (WHERE origin = 'prefix') AS n_prefix, min(chunk_id) AS first_chunk FROM (SELECT query_id, chunk_id, 'prefix' AS origin") + ") GROUP BY query_id")
def wiki_page(spark, sf):
    return quota_merge(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == "prefix").alias("n_prefix"), F.min("chunk_id").alias("first_chunk"))
