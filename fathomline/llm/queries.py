"""The registered queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import byte_network, fill_middle, main_text, mixing, ogg_media, packing, quality_trees, secret_ledger, sharding, simhash_dedup, suffix_dedup, threshold_search, url_filter
from fathomline.llm.common import read_table
from fathomline.sources.shared import new_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARDS = 40
Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, counts=url_filter.corpus_counts(pages))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.media_report(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return quality_trees.verdicts(documents, quality_trees.train(documents, read_table(spark, sf_dir, "labels")))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.scan_stored(read_table(spark, sf_dir, "documents"), new_path(spark, "ledger"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS).drop("h")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return byte_network.identify(documents, byte_network.train(documents))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_url_filters, op3_simhash_dedup, op4_media_columns, op5_quality_rules, op6_secret_scans, op7_sharding, op8_best_fit_packing, op9_suffix_dedup, op10_source_mixing,
        op11_ranked_search, op12_language_id, op13_fill_in_middle,
    )
}

#: Ranked search, Poisson mixing and fill-in-middle can be put in SQL; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op10_source_mixing": f"""
WITH sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes FROM documents GROUP BY source
), weighed AS (
  SELECT source, bytes, pow(bytes, {mixing.TEMPERATURE}) AS weight FROM sizes
), totals AS (
  SELECT sum(bytes) AS all_bytes, sum(CASE WHEN bytes > 0 THEN weight ELSE 0 END) AS all_weight FROM weighed
), rates AS (
  SELECT source, CASE WHEN all_bytes = 0 THEN 1e0 WHEN bytes = 0 OR all_weight = 0 THEN 0e0
         ELSE weight / all_weight * all_bytes / bytes END AS rate
  FROM weighed, totals
), terms AS (
  SELECT source, rate, k, CASE WHEN rate = 0 THEN CASE WHEN k = 0 THEN 1e0 ELSE 0e0 END
         ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END AS p
  FROM (SELECT source, rate, unnest(generate_series(0, CAST(floor(rate + 12 * sqrt(rate)) AS BIGINT) + 39)) AS k FROM rates)
), steps AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms
), drawn AS (
  SELECT doc_id, text, lang, source, n_chars,
         ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0 AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(count(s.k) AS INTEGER) AS n_copies
  FROM drawn d LEFT JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND d.u >= s.cdf
  GROUP BY d.doc_id, d.text, d.lang, d.source, d.n_chars
)
SELECT doc_id, text, lang, source, n_chars, CAST(replica AS INTEGER) AS replica, n_copies,
       md5('{mixing.SEED}-order:' || doc_id || ':' || replica) AS shuffle_key
FROM (SELECT *, unnest(generate_series(0, n_copies - 1)) AS replica FROM counted WHERE n_copies > 0)
""",
    "op11_ranked_search": r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), docs AS (
  SELECT doc_id, t, len(t) AS n FROM found WHERE len(t) > 0
), totals AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs
), asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), counted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counted, totals GROUP BY term
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))) AS impact FROM counted JOIN weights USING (term), totals
), scored AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
""",
    "op13_fill_in_middle": f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{fill_middle.SEED}' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units
), cut AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fill_middle.CUT} THEN 'plain'
              WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
""",
}
