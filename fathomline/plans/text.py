"""Queries of the text and scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.functions import signals
from fathomline.functions import text as fn
from fathomline.functions import vectors
from fathomline.operators import relational as op
from fathomline.sources.tables import CHUNKS_SQL, chunks, table


@query("flatten_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL")
def flatten_text(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", fn.flatten(F.col("text")).alias("flat"))


@query("to_number", "SELECT event_id, CASE WHEN isfinite(TRY_CAST(x AS DOUBLE)) THEN TRY_CAST(x AS DOUBLE) END AS number FROM (SELECT event_id, trim(CASE event_id % 4 WHEN 0 THEN ' ' || value || ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN 'x' || value ELSE '1e3' END) AS x FROM events)")
def to_number(spark, sf):
    n, v = F.col("event_id") % 4, F.col("value").cast("string")
    x = F.when(n == 0, F.concat(F.lit(" "), v, F.lit(" "))).when(n == 1, "NaN").when(n == 2, F.concat(F.lit("x"), v)).otherwise("1e3")
    return table(spark, sf, "events").select("event_id", fn.to_number(x).alias("number"))


@query("content_hash", f"WITH {CHUNKS_SQL} SELECT chunk_id, sha256(content) AS hash FROM chunks")
def content_hash(spark, sf):
    return chunks(spark, sf).select("chunk_id", F.sha2("content", 256).alias("hash"))


@query("excerpt_in", "SELECT b.item_id, d.doc_id FROM (SELECT item_id, lower(regexp_replace(text, '[^\\p{L}\\p{Nd}]+', '', 'g')) AS s FROM benchmark) b JOIN (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{Nd}]+', '', 'g')) AS s FROM documents) d ON contains(d.s, b.s)")
def excerpt_in(spark, sf):
    """Documents that hold a whole excerpt: its first words name candidates by equality, and the whole text decides."""
    asked = table(spark, sf, "benchmark").select("item_id", fn.skeleton(F.col("text")).alias("excerpt"))
    docs = table(spark, sf, "documents").select("doc_id", fn.skeleton(F.col("text")).alias("s"))
    return op.containing(docs, asked)


@query("url_valid", "SELECT page_id, regexp_matches(url, '^https?://[^/?#\\s]+') AS valid FROM pages")
def url_valid(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.valid_url(F.col("url")).alias("valid"))


@query("json_merge", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS kind FROM events")
def json_merge(spark, sf):
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), "event_type"))
    return table(spark, sf, "events").withColumn("m", merged).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"))


@query("crawler_intake", "SELECT page_id, lower(split_part(url, '://', 1)) AS scheme, split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1) AS host, coalesce(nullif(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '([^/]+)$', 1), ''), 'index') AS filename, CASE WHEN length(html) > 2000 THEN 'PENDING_REVIEW' ELSE 'QUEUED' END AS state FROM pages")
def crawler_intake(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    name = F.coalesce(F.nullif(F.regexp_extract(path, "([^/]+)$", 1), F.lit("")), F.lit("index"))
    state = F.when(F.length("html") > 2000, "PENDING_REVIEW").otherwise("QUEUED")
    return table(spark, sf, "pages").select("page_id", F.lower(F.parse_url("url", F.lit("PROTOCOL"))).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"), name.alias("filename"), state.alias("state"))


@query("year_extract", "SELECT doc_id, CAST(nullif(regexp_extract(text, '(?:^|[^0-9])(20[0-9]{2})(?:[^0-9]|$)', 1), '') AS INTEGER) AS year FROM documents")
def year_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.nullif(F.regexp_extract("text", "(?<!\\d)(20\\d{2})(?!\\d)", 1), F.lit("")).try_cast("int").alias("year"))


@query("cosine_pairs", "SELECT a.vec_id, round(coalesce(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 0), 6) + 0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", (F.round(vectors.cosine(F.col("embedding"), F.col("b")), 6) + 0.0).alias("cosine"))


@query("mean_vector", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT label, i, round(avg(v), 6) + 0 AS v FROM x GROUP BY ALL) SELECT label, list(v ORDER BY i) AS mean FROM m GROUP BY label")
def mean_vector(spark, sf):
    return vectors.mean(table(spark, sf, "embeddings"), "label", "embedding", 6)


@query("claim_regex", f"WITH {CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE regexp_matches(content, '(?i)licensed under|rights reserved|guarante')")
def claim_regex(spark, sf):
    return chunks(spark, sf).where(F.col("content").rlike("(?i)licensed under|rights reserved|guarante")).select("chunk_id")


@query("page_split", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS page FROM l) SELECT doc_id, page, trim(body) AS body FROM p WHERE trim(body) <> ''")
def page_split(spark, sf):
    """Documents whose lines are joined by page markers, and split again at the markers."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.format_string("<!-- ODL_PAGE:%d -->", i + 1), x)), "")
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", marked.alias("m"))
    bodies, pages = F.split("m", "<!-- ODL_PAGE:[0-9]+ -->"), F.regexp_extract_all("m", F.lit("<!-- ODL_PAGE:([0-9]+) -->"), 1)
    zipped = F.arrays_zip(pages.alias("page"), F.slice(bodies, 2, F.size(bodies) - 1).alias("body"))
    return docs.select("doc_id", F.inline(zipped)).select("doc_id", F.col("page").cast("bigint").alias("page"), F.trim("body").alias("body")).where("body <> ''")


@query("edit_distance")
def edit_distance(spark, sf):
    """Every line against the next of its document."""
    after = F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    pairs = chunks(spark, sf).select("chunk_id", F.col("content").alias("a"), after.alias("b")).where("b is not null")
    return pairs.select("chunk_id", fn.edits()("a", "b").alias("distance"))


@query("char_accuracy", f"WITH {CHUNKS_SQL} SELECT dataset_id, round(1 - sum(length(content) - length(replace(content, 'e', '')))::DOUBLE / sum(length(content)), 6) AS accuracy FROM chunks GROUP BY dataset_id")
def char_accuracy(spark, sf):
    lines = chunks(spark, sf).select("dataset_id", F.col("content").alias("a"))
    edits = fn.edits()("a", F.regexp_replace("a", "e", ""))
    lines = lines.withColumn("edits", edits)
    return lines.groupBy("dataset_id").agg(F.round(1 - F.sum("edits") / F.sum(F.length("a")), 6).alias("accuracy"))


def _texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("mojibake")
def mojibake(spark, sf):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _texts(spark, sf).select("doc_id", fn.series(fn.repair_mojibake)("string")(broken).alias("repaired"))


@query("norm_body")
def norm_body(spark, sf):
    return _texts(spark, sf).select("doc_id", F.length(fn.series(fn.normal_body)("string")("text")).alias("n"))


@query("effective_text")
def effective_text(spark, sf):
    return _texts(spark, sf).select("doc_id", fn.series(signals.effective_text)("string")("text").alias("effective"))


def _fidelity():
    @F.pandas_udf("recall double, precision double")
    def apply(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn.fidelity(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["recall", "precision"])

    return apply


@query("text_fidelity")
def text_fidelity(spark, sf):
    f = _fidelity()("text", F.regexp_replace("text", "the ", ""))
    return _texts(spark, sf).where("text is not null").select("doc_id", f.alias("f")).select("doc_id", "f.recall", "f.precision", ((F.col("f.recall") >= 0.97) & (F.col("f.precision") >= 0.97)).alias("passed"))


@query(
    "html_table",
    """SELECT page_id, 1 + CAST((length(lower(html)) - length(replace(lower(html), '<table', ''))) / 6 AS INTEGER) AS tables, [['url', 'parts', 'parts'], ['url', 'scheme', 'host'], [url, split_part(url, '://', 1), split_part(split_part(url, '://', 2), '/', 1)]] AS grid FROM pages""",
)
def html_table(spark, sf):
    """How many tables each whole page has, and the grid of the first: a table of the url's parts with spanning headers, put before the page's own."""

    @F.pandas_udf("tables int, grid array<array<string>>")
    def first_grid(pages: pd.Series) -> pd.DataFrame:
        grids = [fn.table_grids(p) for p in pages]
        return pd.DataFrame([(len(g), next(iter(g), [])) for g in grids], columns=["tables", "grid"])

    cell = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    scheme, host = F.split_part("url", F.lit("://"), F.lit(1)), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    row = F.concat(F.lit("<tr><td>"), cell(F.col("url")), F.lit("</td><td>"), cell(scheme), F.lit("</td><td>"), cell(host), F.lit("</td></tr></table>"))
    made = F.concat(F.lit("<table><tr><th rowspan=2>url</th><th colspan=2>parts</th></tr><tr><th>scheme</th><th>host</th></tr>"), row, F.col("html"))
    return table(spark, sf, "pages").select("page_id", first_grid(made).alias("t")).select("page_id", "t.tables", "t.grid")


@query(
    "json_hash",
    "SELECT event_id, sha256('{\"event_type\":' || to_json(event_type) || ',\"k\":' || to_json(CAST(props->>'$.k' AS INTEGER)) || ',\"nested\":{\"a\":' || event_id || ',\"b\":[' || user_id || ',null]},\"user_id\":' || user_id || '}') AS hash FROM events",
)
def json_hash(spark, sf):
    """SHA-256 of JSON objects in canonical form, from texts whose keys come in another order and with white space."""
    kind, k = F.to_json(F.struct(F.col("event_type").alias("v"))), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    kind = F.substring(kind, 6, 1 << 20)  # the value and the closing brace of {"v":...}
    raw = F.concat(F.lit('{ "user_id": '), F.col("user_id").cast("string"), F.lit(', "nested": {"b": ['), F.col("user_id").cast("string"), F.lit(', null], "a": '), F.col("event_id").cast("string"), F.lit('}, "k": '), k, F.lit(', "event_type" :'), kind)
    return table(spark, sf, "events").select("event_id", fn.series(fn.canonical_hash)("string")(raw).alias("hash"))


@query(
    "heading_key",
    f"WITH {CHUNKS_SQL}, h AS (SELECT doc_id, chunk_index, content, row_number() OVER (PARTITION BY doc_id, content ORDER BY chunk_index) - 1 AS occurrence FROM chunks) "
    "SELECT doc_id, chunk_index, CAST(occurrence AS INTEGER) AS occurrence, sha256('{\"doc_id\":' || doc_id || ',\"occurrence\":' || occurrence || ',\"path\":[\"' || sha256(content) || '\"]}') AS heading_key FROM h",
)
def heading_key(spark, sf):
    """Identity of every line taken as a heading: document, path and how often the path came before. A path's step is its text's hash."""
    before = F.row_number().over(Window.partitionBy("doc_id", "content").orderBy("chunk_index")) - 1
    rows = chunks(spark, sf).select("doc_id", "chunk_index", before.cast("int").alias("occurrence"), F.array(F.sha2("content", 256)).alias("path"))
    return rows.select("doc_id", "chunk_index", "occurrence", F.sha2(F.to_json(F.struct("doc_id", "occurrence", "path")), 256).alias("heading_key"))


@query("token_count", f"WITH {CHUNKS_SQL} SELECT dataset_id, CAST(sum(ceil(length(content) / 4)) AS BIGINT) AS tokens FROM chunks GROUP BY dataset_id")
def token_count(spark, sf):
    return chunks(spark, sf).groupBy("dataset_id").agg(F.sum(F.ceil(F.length("content") / 4)).alias("tokens"))


@query("chunk_pages", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN k WHEN event_id % 4 = 1 THEN k + 1 WHEN event_id % 4 = 2 THEN least(k, 7) ELSE k END AS first_page, CASE WHEN event_id % 4 = 0 THEN k + 2 WHEN event_id % 4 = 1 THEN k + 3 WHEN event_id % 4 = 2 THEN greatest(k, 7) ELSE k END AS last_page FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)")
def chunk_pages(spark, sf):
    """Page range by fixed priority: start and end, a range, a list of numbers, a single page."""
    n, k = F.col("event_id") % 4, F.get_json_object("props", "$.k").cast("int")
    meta = F.when(n == 0, F.to_json(F.struct(k.alias("start_page"), (k + 2).alias("end_page"), F.lit(99).alias("page")))).when(n == 1, F.to_json(F.struct(F.struct((k + 1).alias("start"), (k + 3).alias("end")).alias("page_range")))).when(n == 2, F.to_json(F.struct(F.array(k, F.lit(7)).alias("page_numbers")))).otherwise(F.to_json(F.struct(k.alias("page"))))
    m = F.from_json(meta, "start_page int, end_page int, page_range struct<start:int,end:int>, page_numbers array<int>, page int")
    got = table(spark, sf, "events").select("event_id", m.alias("m"))
    return got.select("event_id", F.coalesce("m.start_page", "m.page_range.start", F.array_min("m.page_numbers"), "m.page").alias("first_page"), F.coalesce("m.end_page", "m.page_range.end", F.array_max("m.page_numbers"), "m.page").alias("last_page"))


@query("html_extract")
def html_extract(spark, sf):
    from fathomline.functions.htmltext import to_markdown

    return table(spark, sf, "pages").select("page_id", fn.series(to_markdown)("string")("html").alias("markdown"))


@query("md_tables")
def md_tables(spark, sf):
    """Cells of the tables in rendered pages; the pages get a table of their url's parts first."""
    from fathomline.functions.htmltext import cells, to_markdown
    from fathomline.functions.markdown import elements
    from fathomline.operators.chunking import per_document

    made = F.concat(F.lit("<table><tr><th>id</th><th>url</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), F.col("url"), F.lit("</td></tr></table>"), F.col("html"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), made.alias("text"))

    def grid(t):
        found = [cells(e.text) for e in elements(to_markdown(t)) if e.kind == "table"]
        return [(k, r, c, v) for k, g in enumerate(found) for r, row in enumerate(g) for c, v in enumerate(row)]

    return per_document(pages, "number long, line long, place long, cell string", grid)
