"""Queries of the recall side. Query vectors follow one stated rule: benchmark item i asks with vector i, and vector v
stands for the first line of document v. Nothing else ties vectors to texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import recall as op
from fathomline.sources.shared import kept
from fathomline.sources.shared import stored as written
from fathomline.sources.tables import CHUNKS_SQL, chunks, ready_documents, table

INDEX_SQL = f"""
{CHUNKS_SQL}, split AS (
  SELECT chunk_id, doc_id, dataset_id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '') AS w FROM chunks
), postings AS (
  SELECT chunk_id, doc_id, dataset_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, doc_id, dataset_id, len(w) AS dl, unnest(w) AS term FROM split) GROUP BY ALL
), stats AS (
  SELECT dataset_id, count(*) AS n_chunks, avg(dl) AS avgdl FROM (SELECT DISTINCT dataset_id, chunk_id, dl FROM postings) GROUP BY dataset_id
), asked AS (
  SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '')) AS term FROM benchmark
)
"""
BM25_SQL = f"""
{INDEX_SQL}, freq AS (
  SELECT dataset_id, term, count(*) AS n_t FROM postings GROUP BY ALL
), bm25 AS (
  SELECT query_id, chunk_id, doc_id, dataset_id,
         round(1000e0 * sum(ln(n_chunks / n_t) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM postings JOIN asked USING (term) JOIN freq USING (dataset_id, term) JOIN stats USING (dataset_id) GROUP BY ALL
)
"""
SPARSE_SQL = """
sparse AS (
  SELECT query_id, chunk_id, doc_id, dataset_id, round(CAST(sum(CAST(weight AS DECIMAL(18,9))) AS DOUBLE), 6) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, term) AS place FROM (SELECT *, round(1 + ln(tf), 9) AS weight FROM postings)) JOIN asked USING (term)
  WHERE place <= 256 GROUP BY ALL
)
"""
DENSE_SQL = """
cosines AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(e.label AS BIGINT) AS dataset_id, q.label AS asked_set,
         round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) + 0 AS score
  FROM embeddings q, embeddings e WHERE {queries}
)
"""
ROUTES_SQL = f"""
{BM25_SQL}, {SPARSE_SQL}, {DENSE_SQL.format(queries="q.vec_id IN (SELECT item_id FROM benchmark)")}, dense AS (
  SELECT query_id, c.vec_id || ':0' AS chunk_id, c.vec_id AS doc_id, d.dataset_id, c.score
  FROM cosines c JOIN chunks d ON d.chunk_id = c.vec_id || ':0' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d.chunk_id) <= 50
), routes AS (
  SELECT 'bm25' AS source, * FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 50
  UNION ALL SELECT 'sparse', * FROM sparse QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 50
  UNION ALL SELECT 'dense', * FROM dense
)
"""
FUSED_SQL = f"""
{ROUTES_SQL}, moved AS (
  SELECT *, CASE WHEN source = 'dense' THEN score ELSE ln(1 + score) END AS moved FROM routes
), normed AS (
  SELECT *, CASE WHEN max(moved) OVER w = min(moved) OVER w THEN 1e0 ELSE (moved - min(moved) OVER w) / nullif(max(moved) OVER w - min(moved) OVER w, 0) END AS norm,
         CASE source WHEN 'dense' THEN 0.7e0 ELSE 0.15e0 END AS weight FROM moved WINDOW w AS (PARTITION BY query_id, source)
), active AS (
  SELECT query_id, sum(weight) AS active FROM (SELECT DISTINCT query_id, source, weight FROM normed) GROUP BY query_id
), fused AS (
  SELECT query_id, chunk_id, doc_id, dataset_id, round(sum(weight * norm) / any_value(active), 6) AS score, list_sort(list(DISTINCT source)) AS sources
  FROM normed JOIN active USING (query_id) GROUP BY query_id, chunk_id, doc_id, dataset_id
)
"""


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index(spark, sf):
    """The inverted index, as far as vocabulary and statistics need it."""
    return op.postings(chunks(spark, sf))


def stored(spark, sf):
    """The index that the lexical routes search, built once for each application and state of the documents' files."""
    return kept(spark, f"index of {sf}", [f"{sf}/documents.parquet"], lambda: op.stored_index(chunks(spark, sf)))


def bm25_hits(spark, sf, k, **how):
    return op.lexical(stored(spark, sf), questions(spark, sf), k, **how)


def sparse_hits(spark, sf, k):
    return op.lexical(stored(spark, sf), questions(spark, sf), k, "sparse")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("dataset_id"), "embedding")


def dense_hits(spark, sf, k=50):
    """Dense hits as chunks: the vectors that have a first line, then the k best of each query."""
    every = chunks(spark, sf)
    lines = every.where("chunk_index = 0").select("doc_id", "chunk_id", F.col("dataset_id").alias("line_set"))
    have = vectors(spark, sf).join(lines, F.col("vec_id") == F.col("doc_id"), "left_semi")
    asked = vectors(spark, sf).join(questions(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    found = op.dense(have, asked, k).join(lines, F.col("vec_id") == F.col("doc_id"))
    return op.ranked(found.select("query_id", "chunk_id", "doc_id", F.col("line_set").alias("dataset_id"), "score"), ["query_id"], k).drop("rank")


def route_hits(spark, sf):
    """The three routes' best 50 of each query, with their source. Each route is stored: its hits are few and dear, and readers
    take them several times."""
    out = None
    for source, hits in (("bm25", bm25_hits(spark, sf, 50)), ("sparse", sparse_hits(spark, sf, 50)), ("dense", dense_hits(spark, sf))):
        rows = hits.select("query_id", F.lit(source).alias("source"), "chunk_id", "doc_id", "dataset_id", "score")
        rows = written(rows, "route")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("tokenize", f"WITH {INDEX_SQL} SELECT term, count(*) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY term")
def tokenize(spark, sf):
    return index(spark, sf).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n"))


LEXICON_WORDS = 100_000


@query("segment_runs")
def segment_runs(spark, sf):
    """Every line with its spaces and marks taken out, cut into words again by the corpus's own dictionary: the words, and how many of
    the line's own word ends were found. It stands for languages that are written without spaces, which the tables lack."""
    from fathomline.operators import segmentation

    own = chunks(spark, sf).select("chunk_id", op.words(F.col("content")).alias("w"))
    segmenter = segmentation.Segmenter(segmentation.word_counts(own.select(F.explode_outer("w").alias("word")).where("word IS NOT NULL"), LEXICON_WORDS))
    found = own.withColumn("found", segmenter.recut(F.col("w")))
    return found.select("chunk_id", "found.words", F.size("w").alias("n_words"), "found.n_found")


@query("bm25_stats", f"WITH {INDEX_SQL} SELECT dataset_id, n_chunks, round(avgdl, 6) AS avgdl FROM stats")
def bm25_stats(spark, sf):
    return op.corpus_stats(index(spark, sf)).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_topk", f"WITH {BM25_SQL} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 20")
def bm25_topk(spark, sf):
    return op.ranked(bm25_hits(spark, sf, 20), ["query_id"], 20)


@query(
    "bm25_merge",
    f"WITH {BM25_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY query_id, dataset_id ORDER BY score DESC, chunk_id) AS dataset_rank FROM bm25 QUALIFY dataset_rank <= 10), "
    "relative AS (SELECT query_id, chunk_id, doc_id, dataset_id, (count(*) OVER w - dataset_rank + 1) / count(*) OVER w AS score, dataset_rank FROM first WINDOW w AS (PARTITION BY query_id, dataset_id)) "
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dataset_id, dataset_rank) AS rank FROM relative QUALIFY rank <= 64",
)
def bm25_merge(spark, sf):
    return op.merge_datasets(bm25_hits(spark, sf, 10, by_dataset=True), 10, 64)


@query(
    "bm25_by_dataset",
    f"WITH {BM25_SQL}, once AS (SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id, dataset_id, doc_id ORDER BY score DESC, chunk_id) = 1) "
    "SELECT *, row_number() OVER (PARTITION BY query_id, dataset_id ORDER BY score DESC, chunk_id) AS rank FROM once QUALIFY rank <= 5",
)
def bm25_by_dataset(spark, sf):
    return op.ranked(bm25_hits(spark, sf, 5, by_dataset=True, per_document=True), ["query_id", "dataset_id"], 5)


TYPE_SQL = "CASE WHEN contains(chunk_id, ':0') THEN 'front_matter' WHEN doc_id % 5 = 0 THEN 'table' WHEN doc_id % 5 = 1 THEN 'code_block' ELSE 'text' END"


@query(
    "bm25_typed",
    f"WITH {BM25_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS first_rank FROM bm25 QUALIFY first_rank <= 200), "
    f"typed AS (SELECT query_id, chunk_id, doc_id, dataset_id, first_rank, round(score * CASE {TYPE_SQL} WHEN 'front_matter' THEN 0.7e0 WHEN 'table' THEN 1.2e0 WHEN 'code_block' THEN 1.15e0 ELSE 1e0 END, 6) AS score FROM first) "
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM typed QUALIFY rank <= 20",
)
def bm25_typed(spark, sf):
    kind = F.when(F.col("chunk_id").contains(":0"), "front_matter").when(F.col("doc_id") % 5 == 0, "table").when(F.col("doc_id") % 5 == 1, "code_block").otherwise("text")
    return op.typed(bm25_hits(spark, sf, 200), kind, 20)


@query("sparse_topk", f"WITH {INDEX_SQL}, {SPARSE_SQL} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse QUALIFY rank <= 20")
def sparse_topk(spark, sf):
    return op.ranked(sparse_hits(spark, sf, 20), ["query_id"], 20)


@query(
    "sparse_clean",
    "WITH w AS (SELECT user_id AS chunk_id, CAST(event_id % 97 AS INTEGER) AS idx, max(value - 20) AS weight FROM events WHERE value - 20 > 0 AND value - 20 >= 5 GROUP BY ALL), "
    "top AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, idx) <= 16) SELECT chunk_id, list(idx ORDER BY idx) AS indices, list(weight ORDER BY idx) AS weights FROM top GROUP BY chunk_id",
)
def sparse_clean(spark, sf):
    weights = table(spark, sf, "events").select(F.col("user_id").alias("chunk_id"), (F.col("event_id") % 97).cast("int").alias("idx"), (F.col("value") - 20).alias("weight"))
    return op.clean_weights(weights, 5.0, 16)


def _asked(spark, sf):
    return vectors(spark, sf).where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


DENSE = DENSE_SQL.format(queries="q.vec_id % 50 = 0")
DENSE_TOP = "SELECT query_id, vec_id, dataset_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cosines"


@query("dense_topk", f"WITH {DENSE} {DENSE_TOP} QUALIFY rank <= 10")
def dense_topk(spark, sf):
    return op.dense(vectors(spark, sf), _asked(spark, sf), 10)


@query("dense_filtered", f"WITH {DENSE} {DENSE_TOP} WHERE dataset_id = asked_set QUALIFY rank <= 10")
def dense_filtered(spark, sf):
    return op.dense(vectors(spark, sf), _asked(spark, sf), 10, same_dataset=True)


@query("dense_threshold", f"WITH {DENSE} {DENSE_TOP} WHERE score >= 0.3 QUALIFY rank <= 10")
def dense_threshold(spark, sf):
    return op.dense(vectors(spark, sf), _asked(spark, sf), 10, threshold=0.3)


@query("minmax_norm", f"WITH {FUSED_SQL} SELECT query_id, source, chunk_id, round(norm, 6) AS norm FROM normed")
def minmax_norm(spark, sf):
    return op.normalised(route_hits(spark, sf)).select("query_id", "source", "chunk_id", F.round("norm", 6).alias("norm"))


@query("fuse_weighted", f"WITH {FUSED_SQL} SELECT * FROM fused")
def fuse_weighted(spark, sf):
    return op.fuse(route_hits(spark, sf))


@query("candidate_union", f"WITH {ROUTES_SQL} SELECT DISTINCT query_id, chunk_id, doc_id FROM routes")
def candidate_union(spark, sf):
    return route_hits(spark, sf).select("query_id", "chunk_id", "doc_id").distinct()


@query("gate_semi", f"WITH {FUSED_SQL} SELECT query_id, chunk_id, score FROM fused WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gate_semi(spark, sf):
    return op.gate(op.fuse(route_hits(spark, sf)), ready_documents(spark, sf), ["doc_id"]).select("query_id", "chunk_id", "score")


@query(
    "recall_e2e",
    f"WITH {FUSED_SQL} SELECT query_id, chunk_id, doc_id, dataset_id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank "
    "FROM fused WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY rank <= 64",
)
def recall_e2e(spark, sf):
    """Three routes, fusion, the gate and only then the final cut."""
    return op.ranked(op.gate(op.fuse(route_hits(spark, sf)), ready_documents(spark, sf), ["doc_id"]), ["query_id"], op.TOP_K)


def diagnosed(hits, asked):
    """Hits of each route and the mode of every query of ``asked``."""
    counts = hits.groupBy("query_id").pivot("source", ["bm25", "dense", "sparse"]).count()
    return op.diagnosis(asked.select("query_id").join(counts, "query_id", "left").na.fill(0))


@query(
    "recall_diag",
    f"WITH {ROUTES_SQL}, n AS (SELECT item_id AS query_id, count(*) FILTER (WHERE source = 'bm25') AS bm25, count(*) FILTER (WHERE source = 'dense') AS dense, count(*) FILTER (WHERE source = 'sparse') AS sparse "
    "FROM benchmark LEFT JOIN routes ON item_id = query_id GROUP BY item_id) "
    "SELECT *, CASE WHEN dense > 0 AND (bm25 > 0 OR sparse > 0) THEN 'hybrid' WHEN bm25 > 0 THEN 'lexical_only' WHEN dense > 0 THEN 'dense_only' WHEN sparse > 0 THEN 'sparse_only' END AS mode FROM n",
)
def recall_diag(spark, sf):
    return diagnosed(route_hits(spark, sf), questions(spark, sf))


STATES = "CASE WHEN event_type = 'error' THEN CASE WHEN value > 90 THEN 'FATAL' ELSE 'FAILED' END ELSE 'OK' END"


@query(
    "route_failures",
    f"WITH s AS (SELECT user_id AS query_id, {STATES} AS state, user_id % 4 = 0 AS strict FROM events), g AS (SELECT query_id, max(CAST(state = 'FATAL' AS INT)) AS fatal, count(*) FILTER (WHERE state <> 'OK') AS failed, count(*) AS routes, max(CAST(strict AS INT)) AS strict FROM s GROUP BY query_id) "
    "SELECT query_id, CAST(failed AS INTEGER) AS failed, CASE WHEN fatal = 1 THEN 'FATAL' WHEN strict = 1 AND failed > 0 THEN 'STRICT_ERROR' WHEN failed = routes THEN 'ALL_FAILED' WHEN failed > 0 THEN 'DEGRADED' ELSE 'OK' END AS outcome FROM g",
)
def route_failures(spark, sf):
    return op.failure_policy(table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.expr(STATES).alias("state"), (F.col("user_id") % 4 == 0).alias("strict")))


@query(
    "readiness_gate",
    f"WITH {CHUNKS_SQL}, d AS (SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS dataset_id, quality, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'docx' END AS file_type, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '{{\"status\": \"failed\"}}' ELSE '{{\"status\": \"passed\"}}' END AS parse_quality FROM documents JOIN labels USING (doc_id)) "
    "SELECT c.chunk_id, c.doc_id, c.dataset_id FROM chunks c JOIN d USING (doc_id) WHERE quality = 1 AND c.dataset_id % 4 <> 0 AND (file_type = 'html' OR upper(json_extract_string(parse_quality, '$.status')) = 'PASSED')",
)
def readiness_gate(spark, sf):
    from fathomline.sources.tables import dataset_of

    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "pdf").when(F.col("doc_id") % 3 == 1, "html").otherwise("docx")
    verdict = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, '{"status": "failed"}').otherwise('{"status": "passed"}')
    docs = docs.select("doc_id", dataset_of("source").alias("dataset_id"), F.when(F.col("quality") == 1, "READY").otherwise("FAILED").alias("status"), F.lit(1).alias("user_id"), kind.alias("file_type"), F.lit("PASSED").alias("parse_quality_status"), verdict.alias("parse_quality"))
    sets = docs.select("dataset_id").distinct().select("dataset_id", F.when(F.col("dataset_id") % 4 == 0, "DISABLED").otherwise("ACTIVE").alias("dataset_status"), F.lit(1).alias("owner_id"))
    return op.ready(chunks(spark, sf), docs, sets, 1)


@query(
    "context_pack",
    f"""WITH RECURSIVE {BM25_SQL}, best AS (
  SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm25 QUALIFY rank <= 12
), blocks AS (
  SELECT query_id, rank, chunk_id, CASE WHEN trim(content) = '' THEN -1 ELSE greatest(1, CAST(floor(2 * (length(content) - length(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'))) + 0.25e0 * length(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'))) AS INTEGER)) END AS cost FROM best JOIN chunks USING (chunk_id)
), packed AS (
  SELECT DISTINCT query_id, 0 AS rank, CAST(NULL AS VARCHAR) AS chunk_id, false AS kept, 0 AS n, 0 AS used FROM blocks
  UNION ALL SELECT b.query_id, b.rank, b.chunk_id, b.cost >= 0 AND (p.n = 0 OR p.used + b.cost <= 400), p.n + CAST(b.cost >= 0 AND (p.n = 0 OR p.used + b.cost <= 400) AS INTEGER), p.used + CASE WHEN b.cost >= 0 AND (p.n = 0 OR p.used + b.cost <= 400) THEN b.cost ELSE 0 END
  FROM packed p JOIN blocks b ON b.query_id = p.query_id AND b.rank = p.rank + 1
) SELECT query_id, rank, chunk_id, kept, CASE WHEN kept THEN n END AS number FROM packed WHERE rank > 0""",
)
def context_pack(spark, sf):
    best = op.ranked(bm25_hits(spark, sf, 12), ["query_id"], 12)
    return op.pack_context(best.join(chunks(spark, sf).select("chunk_id", "content"), "chunk_id"), 400)


@query("token_est", f"WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, CAST(floor(2 * (length(content) - length(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'))) + 0.25e0 * length(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'))) AS INTEGER)) END AS tokens FROM chunks")
def token_est(spark, sf):
    return chunks(spark, sf).select("chunk_id", op.token_estimate(F.col("content")).alias("tokens"))


@query(
    "hit_payload",
    f"WITH {BM25_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 8), p AS (SELECT *, CAST(doc_id % 9 + 1 AS INTEGER) AS start_page, CAST(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 + 1 + doc_id % 2 END AS INTEGER) AS end_page FROM top) "
    "SELECT query_id, rank, chunk_id, CAST(rank AS INTEGER) AS citation, CASE WHEN start_page = end_page THEN start_page END AS page, CASE WHEN end_page IS NOT NULL AND start_page <> end_page THEN start_page || '-' || end_page END AS page_range FROM p",
)
def hit_payload(spark, sf):
    top = op.ranked(bm25_hits(spark, sf, 8), ["query_id"], 8)
    first = (F.col("doc_id") % 9 + 1).cast("int")
    last = F.when(F.col("doc_id") % 4 == 0, None).otherwise((F.col("doc_id") % 9 + 1 + F.col("doc_id") % 2).cast("int"))
    paged = top.withColumns({"start_page": first, "end_page": last})
    page = F.when(F.col("start_page") == F.col("end_page"), F.col("start_page"))
    span = F.when(F.col("end_page").isNotNull() & (F.col("start_page") != F.col("end_page")), F.concat_ws("-", F.col("start_page").cast("string"), F.col("end_page").cast("string")))
    return paged.select("query_id", "rank", "chunk_id", F.col("rank").cast("int").alias("citation"), page.alias("page"), span.alias("page_range"))


@query("hash_sample", "SELECT event_id FROM events WHERE CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295e0 < 0.1")
def hash_sample(spark, sf):
    share = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return table(spark, sf, "events").where(share < 0.1).select("event_id")


@query("top5_noise", f"WITH {BM25_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 5) SELECT query_id, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS noisy FROM top GROUP BY query_id")
def top5_noise(spark, sf):
    poor = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(1).alias("poor"))
    top = op.ranked(bm25_hits(spark, sf, 5), ["query_id"], 5).join(poor, "doc_id", "left")
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("poor").alias("noisy"))


@query("owner_check", "SELECT o_custkey % 100 AS scope, count(DISTINCT o_orderstatus) AS owners, count(DISTINCT o_orderstatus) <= 2 AS sound FROM orders GROUP BY 1")
def owner_check(spark, sf):
    owners = F.countDistinct("o_orderstatus")
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("scope")).agg(owners.alias("owners"), (owners <= 2).alias("sound"))


@query("bm25_upsert", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def bm25_upsert(spark, sf):
    from fathomline.sources.sinks import latest

    rows = table(spark, sf, "events").withColumn("sequence", F.struct("ts", "event_id"))
    return latest(rows, ["user_id", "event_type"], "sequence").select("user_id", "event_id", "event_type", "value")


@query("batch_split")
def batch_split(spark, sf):
    from fathomline.sources.sinks import batches

    return batches(chunks(spark, sf).withColumn("size", F.octet_length("content")), "dataset_id", "chunk_id", "size", 100, 20_000)


@query(
    "round_robin",
    f"WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, dataset_id ORDER BY score DESC, chunk_id) AS dataset_rank FROM bm25 QUALIFY dataset_rank <= 3) SELECT query_id, dataset_id, chunk_id, dataset_rank, row_number() OVER (PARTITION BY query_id ORDER BY dataset_rank, dataset_id) AS place FROM r",
)
def round_robin(spark, sf):
    first = op.ranked(bm25_hits(spark, sf, 3, by_dataset=True), ["query_id", "dataset_id"], 3).withColumnRenamed("rank", "dataset_rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("dataset_rank", "dataset_id"))
    return first.select("query_id", "dataset_id", "chunk_id", "dataset_rank", place.alias("place"))


@query(
    "vector_upsert",
    """SELECT 'v' || vec_id AS chunk_id, CAST(label AS INTEGER) AS dataset_id, CAST(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version,
       round(CAST(CASE WHEN vec_id % 3 = 0 THEN embedding[-1] ELSE embedding[1] END AS DOUBLE), 6) + 0 AS first, len(embedding) AS dims FROM embeddings WHERE vec_id % 7 <> 0""",
)
def vector_upsert(spark, sf):
    """A store that gets every vector, newer, stale, replayed and deleted versions of some, and is compacted in between; its dense points."""
    from fathomline.sources.shared import new_path
    from fathomline.sources.vectors import VectorStore

    store = VectorStore(spark, new_path(spark, "vectors"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("v"), "vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("label").alias("dataset_id"), F.lit(1).alias("version"), "embedding")
    newer = rows.where("vec_id % 3 = 0").withColumns({"version": F.lit(2), "embedding": F.reverse("embedding")})
    store.upsert_dense(newer)
    store.upsert_dense(rows)
    store.compact()
    store.upsert_dense(rows.where("vec_id % 5 = 0").withColumns({"version": F.lit(0), "embedding": F.transform("embedding", lambda x: x * 0)}))
    store.upsert_dense(newer)
    store.delete(rows.where("vec_id % 7 = 0").withColumn("version", F.lit(3)), "dense")
    store.upsert_sparse(rows.withColumns({"indices": F.transform("embedding", lambda _, i: i), "weights": F.col("embedding")}))
    return store.points("dense").select("chunk_id", "dataset_id", "version", (F.round(F.col("embedding")[0].cast("double"), 6) + 0.0).alias("first"), F.size("embedding").cast("long").alias("dims"))
