"""Queries of parse quality and acceptance. Pages are the lines of a document; a line's measures stand in for a page's."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.functions import text as fn
from fathomline.functions.geometry import union_area
from fathomline.sources.tables import CHUNKS_SQL, chunks, table

FLAGS = f"""
{CHUNKS_SQL}, flags AS (
  SELECT chunk_id, doc_id, chunk_index, length(content) AS n, length(content) < 20 AS sparse, length(regexp_replace(content, '[^#*$%&]', '', 'g')) * 20 > length(content) AS noisy,
         contains(content, '|') AS tabular FROM chunks
)
"""


def flags(spark, sf):
    n = F.length("content")
    marks = F.length(F.regexp_replace("content", "[^#*$%&]", ""))
    return chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index", n.alias("n"), (n < 20).alias("sparse"), (marks * 20 > n).alias("noisy"), F.col("content").contains("|").alias("tabular"))


@query("page_flags", f"WITH {FLAGS} SELECT chunk_id, sparse, noisy, tabular, CASE WHEN noisy THEN 'FAILED' WHEN sparse THEN 'WARNING' ELSE 'PASSED' END AS status FROM flags")
def page_flags(spark, sf):
    return flags(spark, sf).select("chunk_id", "sparse", "noisy", "tabular", F.when(F.col("noisy"), "FAILED").when(F.col("sparse"), "WARNING").otherwise("PASSED").alias("status"))


@query("quality_rollup", f"WITH {FLAGS} SELECT doc_id, count(*) AS pages, round(avg(CAST(NOT sparse AS INT)), 6) AS coverage, CASE WHEN bool_or(noisy) THEN 'FAILED' WHEN bool_or(sparse) THEN 'WARNING' ELSE 'PASSED' END AS status FROM flags GROUP BY doc_id")
def quality_rollup(spark, sf):
    worst = F.when(F.bool_or("noisy"), "FAILED").when(F.bool_or("sparse"), "WARNING").otherwise("PASSED")
    return flags(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg((~F.col("sparse")).cast("int")), 6).alias("coverage"), worst.alias("status"))


@query("scan_ratio", f"WITH {FLAGS} SELECT doc_id, round(avg(CAST(noisy AS INT)), 6) AS ratio, avg(CAST(noisy AS INT)) >= 0.8 AS scanned FROM flags WHERE NOT sparse GROUP BY doc_id")
def scan_ratio(spark, sf):
    share = F.avg(F.col("noisy").cast("int"))
    return flags(spark, sf).where("not sparse").groupBy("doc_id").agg(F.round(share, 6).alias("ratio"), (share >= 0.8).alias("scanned"))


@query("fallback_targets", f"WITH {FLAGS} SELECT chunk_id, CASE WHEN noisy THEN 'GARBLED' WHEN tabular THEN 'TABLE' ELSE 'LOW_TEXT' END AS reason FROM flags WHERE noisy OR tabular OR sparse")
def fallback_targets(spark, sf):
    return flags(spark, sf).where("noisy or tabular or sparse").select("chunk_id", F.when(F.col("noisy"), "GARBLED").when(F.col("tabular"), "TABLE").otherwise("LOW_TEXT").alias("reason"))


@query(
    "fallback_merge",
    f"""WITH {FLAGS}, own AS (
  SELECT chunk_id, doc_id, chunk_index, regexp_replace(content, '^[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+$', '', 'g') AS t FROM chunks
), due AS (
  SELECT own.*, coalesce(lead(t) OVER (PARTITION BY own.doc_id ORDER BY own.chunk_index), '') AS more, noisy OR tabular OR sparse AS wanted, NOT noisy AND tabular AS seen FROM own JOIN flags USING (chunk_id)
), merged AS (
  SELECT doc_id, chunk_index, CASE WHEN wanted AND more <> '' AND NOT contains(t, more) THEN t || CASE WHEN t = '' THEN '' ELSE chr(10) || chr(10) END || '<!-- PAGE_FALLBACK:' || CASE WHEN seen THEN 'VISION' ELSE 'OCR' END || ' -->' || chr(10) || chr(10) || CASE WHEN seen AND NOT starts_with(more, '图片说明：') THEN '图片说明：' ELSE '' END || more ELSE t END AS t FROM due
) SELECT doc_id, count(*) AS pages, sha256(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY chunk_index) FILTER (WHERE t <> ''), '')) AS merged_hash FROM merged GROUP BY doc_id""",
)
def fallback_merge(spark, sf):
    """Lines as pages; those with too little or garbled text take the next line of their document as recovered text, tabular ones as a description."""
    from fathomline.operators import pages

    after = F.lead("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    own = chunks(spark, sf).select("doc_id", F.col("chunk_index").alias("page"), F.col("content").alias("markdown"), "chunk_id", after.alias("text"))
    more = own.join(fallback_targets(spark, sf), "chunk_id").select("doc_id", "page", F.when(F.col("reason") == "TABLE", "vision").otherwise("ocr").alias("method"), "text")
    merged = pages.joined_pages(pages.merge_recovered(own.select("doc_id", "page", "markdown"), more))
    return merged.select("doc_id", "pages", F.sha2("text", 256).alias("merged_hash"))


@query("content_issues")
def content_issues(spark, sf):
    """Source and output pages by number: missing, extra and changed ones."""
    source = chunks(spark, sf).where(F.length("content") > 20).select("doc_id", "chunk_index", F.sha2("content", 256).alias("a"))
    output = chunks(spark, sf).where(F.length("content") < 400).select("doc_id", "chunk_index", F.sha2(F.trim("content"), 256).alias("b"))
    issue = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").when(F.col("a") != F.col("b"), "CHANGED")
    return source.join(output, ["doc_id", "chunk_index"], "full_outer").withColumn("issue", issue).where("issue is not null").groupBy("doc_id", "issue").count()


@query("page_order", f"WITH {CHUNKS_SQL}, g AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS place FROM chunks), p AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY length(content), chunk_index) AS place FROM chunks) SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE g.chunk_index = p.chunk_index) AS in_order FROM g JOIN p USING (doc_id, place) GROUP BY doc_id")
def page_order(spark, sf):
    by_doc = Window.partitionBy("doc_id")
    both = chunks(spark, sf).select("doc_id", F.row_number().over(by_doc.orderBy("chunk_index")).alias("a"), F.row_number().over(by_doc.orderBy(F.length("content"), "chunk_index")).alias("b"))
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("a") == F.col("b")).alias("in_order"))


@query("ocr_cov", f"WITH {FLAGS} SELECT doc_id, round(CASE WHEN count(*) FILTER (WHERE noisy) = 0 THEN 1e0 ELSE count(*) FILTER (WHERE noisy AND n > 100) / count(*) FILTER (WHERE noisy) END, 6) AS coverage FROM flags GROUP BY doc_id")
def ocr_cov(spark, sf):
    scanned, done = F.count_if(F.col("noisy")), F.count_if(F.col("noisy") & (F.col("n") > 100))
    return flags(spark, sf).groupBy("doc_id").agg(F.round(F.when(scanned == 0, 1.0).otherwise(done / F.nullif(scanned, F.lit(0))), 6).alias("coverage"))


@query("undescribed", f"WITH {FLAGS} SELECT doc_id, count(*) AS images, count(*) FILTER (WHERE n < 60) AS undescribed FROM flags WHERE tabular GROUP BY doc_id")
def undescribed(spark, sf):
    return flags(spark, sf).where("tabular").groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("n") < 60).alias("undescribed"))


@query(
    "critical_tokens",
    f"""WITH {CHUNKS_SQL}, sides AS (
  SELECT chunk_id, unnest(regexp_extract_all(content, '[0-9]+(?:[.,][0-9]+)*%?')) AS token, 1 AS n FROM chunks
  UNION ALL SELECT chunk_id, unnest(regexp_extract_all(replace(content, '9', ''), '[0-9]+(?:[.,][0-9]+)*%?')), -1 FROM chunks
) SELECT chunk_id, bool_and(balance = 0) AS exact FROM (SELECT chunk_id, token, sum(n) AS balance FROM sides GROUP BY ALL) GROUP BY chunk_id""",
)
def critical_tokens(spark, sf):
    """Numbers of a page and how often each occurs, against the output's: a page is exact if all counts agree."""
    numbers = F.regexp_extract_all("content", F.lit("\\d+(?:[.,]\\d+)*%?"), 0)
    want = chunks(spark, sf).select("chunk_id", F.explode(numbers).alias("token")).groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("want"))
    got = chunks(spark, sf).select("chunk_id", F.explode(F.regexp_extract_all(F.regexp_replace("content", "9", ""), F.lit("\\d+(?:[.,]\\d+)*%?"), 0)).alias("token")).groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("got"))
    return want.join(got, ["chunk_id", "token"], "full_outer").groupBy("chunk_id").agg(F.bool_and(F.col("want").eqNullSafe(F.col("got"))).alias("exact"))


@query("formula_exact", "SELECT event_id, event_id % 7 > 0 AS exact FROM events")
def formula_exact(spark, sf):
    """Formulas of five shapes around each event's value, spelt in two ways; every seventh is another formula in the second."""
    from fathomline.operators.validation import signature

    v, n = F.col("value").cast("string"), F.col("event_id") % 5
    w = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("7"), v)).otherwise(v)

    def shaped(v, shapes):
        made = [F.concat(*(v if part == "v" else F.lit(part) for part in s)) for s in shapes]
        return F.when(n == 0, made[0]).when(n == 1, made[1]).when(n == 2, made[2]).when(n == 3, made[3]).otherwise(made[4])

    one = shaped(v, [("\\frac{", "v", "}{x_1}"), ("E_i=AD_i\\times ", "v", "\\tag{2}"), ("\\left( a + ", "v", " \\right)"), ("\\sum_{i} x_i \\leq ", "v"), ("\\mathrm{CO} * ", "v", "/k")])
    two = shaped(w, [("\\displaystyle \\frac { ", "v", " }{ x_1 }"), ("E_{i} = AD_{i} × ", "v", " (2)"), ("（a+", "v", "）"), ("∑_{i} x_{i} ≤ ", "v"), ("CO × ", "v", " ÷ k")])
    return table(spark, sf, "events").select("event_id", (signature(one) == signature(two)).alias("exact"))


@query(
    "rect_union",
    """WITH boxes AS (
  SELECT l_orderkey AS page, CAST(l_partkey % 50 AS DOUBLE) AS x, l_partkey % 50 + CAST(l_quantity AS DOUBLE) AS x2, CAST(l_partkey % 31 AS DOUBLE) AS y, CAST(l_partkey % 31 + l_linenumber AS DOUBLE) AS y2 FROM lineitem
), edges AS (
  SELECT DISTINCT page, x FROM boxes UNION SELECT page, x2 FROM boxes
), slabs AS (
  SELECT page, x AS a, lead(x) OVER (PARTITION BY page ORDER BY x) AS z FROM edges
), spans AS (
  SELECT s.page, s.a, s.z, b.y, b.y2, max(b.y2) OVER (PARTITION BY s.page, s.a ORDER BY b.y, b.y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM slabs s JOIN boxes b ON b.page = s.page AND b.x <= s.a AND b.x2 >= s.z WHERE s.z IS NOT NULL
)
SELECT page, sum((z - a) * greatest(0, y2 - greatest(y, coalesce(top, y)))) AS area FROM spans GROUP BY page""",
)
def rect_union(spark, sf):
    """Area that rectangles of a page cover, by a sweep over their edges."""

    @F.pandas_udf("double")
    def areas(pages: pd.Series) -> pd.Series:
        return pages.map(lambda boxes: union_area((b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]) for b in boxes))

    k = F.col("l_partkey")
    boxes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (k % 50).cast("double").alias("x"), (k % 31).cast("double").alias("y"), F.col("l_quantity").alias("w"), F.col("l_linenumber").cast("double").alias("h"))
    return boxes.groupBy("page").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("boxes")).select("page", areas("boxes").alias("area"))  # the boxes of one page


@query("preview_map")
def preview_map(spark, sf):
    """Chunks with the precision their boundaries allow: strict ones, those that only follow in order, and the rest."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    rows = chunks(spark, sf).withColumn("end", F.col("chunk_index") + F.length("content") % 3)
    before = F.lag("end").over(w)
    tier = F.when(before.isNull() | (F.col("chunk_index") > before), "exact").when(F.col("end") > before, "ordered").otherwise("approximate")
    return rows.select("chunk_id", tier.alias("tier"))


@query(
    "legacy_bounds",
    f"""WITH RECURSIVE {CHUNKS_SQL}, spans AS (
  SELECT doc_id, chunk_index AS a, chunk_index + length(content) % 4 AS z, chunk_id FROM chunks
), kept AS (
  (SELECT doc_id, a, z, chunk_id FROM spans QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY a, z, chunk_id) = 1)
  UNION ALL (SELECT s.doc_id, s.a, s.z, s.chunk_id FROM kept k JOIN spans s ON s.doc_id = k.doc_id AND s.a > k.z QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY s.a, s.z, s.chunk_id) = 1)
) SELECT chunk_id FROM kept""",
)
def legacy_bounds(spark, sf):
    """Greedy monotone subsequence: a span is kept if it starts after the last kept one ends. Folded over a document's short list."""
    spans = chunks(spark, sf).select("doc_id", F.struct(F.col("chunk_index").alias("a"), (F.col("chunk_index") + F.length("content") % 4).alias("z"), "chunk_id").alias("s"))
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("ss"))  # the chunks of one document
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<string>").alias("kept"))

    def step(acc, s):
        ok = s["a"] > acc["last"]
        return F.struct(F.when(ok, s["z"]).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["kept"], F.array(s["chunk_id"]))).otherwise(acc["kept"]).alias("kept"))

    return listed.select(F.explode(F.aggregate("ss", start, step, lambda a: a["kept"])).alias("chunk_id"))


@query("html_main")
def html_main(spark, sf):
    """Each page's main container: the shortest that holds 60 % of the twelve-character grams of the page's paragraphs."""
    from fathomline.functions.maincontent import locate, read_page

    @F.pandas_udf("level string, tag string, container_chars int, grams int, wanted int, text string")
    def find(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for source in pages:
            page, target = read_page(source)
            at = locate(page, target)
            rows.append((at.level, at.tag, at.end - at.begin, at.grams, at.wanted, page.text[at.begin : at.end]))
        return pd.DataFrame(rows, columns=["level", "tag", "container_chars", "grams", "wanted", "text"])

    return table(spark, sf, "pages").select("page_id", find("html").alias("m")).select("page_id", "m.level", "m.tag", "m.container_chars", "m.grams", "m.wanted", F.sha2("m.text", 256).alias("text_hash"))


@query("html_clean", "SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')) AS n FROM pages")
def html_clean(spark, sf):
    no_comments = F.regexp_replace("html", "(?s)<!--.*?-->", "")
    no_scripts = F.regexp_replace(no_comments, "(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    return table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace(no_scripts, "<[^>]*>", "")).alias("n"))


@query("table_merge")
def table_merge(spark, sf):
    """Tables that continue over pages: a table with the header of the one before on the next page joins its chain."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("header"))
    fresh = ~((F.col("header") == F.lag("header").over(w)) & (F.col("l_linenumber") - F.lag("l_linenumber").over(w) <= 1))
    chain = rows.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("chain", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chain.groupBy("l_orderkey", "chain").agg(F.count(F.lit(1)).alias("parts"), F.min("header").alias("header"))


PAGES = """CASE WHEN i % 6 = 5 AND doc_id % 4 = 0 THEN concat(i div 6 + 10, '') WHEN i % 6 = 5 AND doc_id % 4 = 1 THEN concat('- ', i div 6 + 1, ' -') WHEN i % 6 = 0 AND doc_id % 4 = 2 THEN concat('Page ', i div 6 + 3, ' of 90')
WHEN i % 6 = 5 AND doc_id % 4 = 3 THEN concat(i * i, '') WHEN i % 6 = 2 THEN concat(i div 6 + 10, '') WHEN i % 18 = 7 THEN '```' WHEN i % 18 = 9 THEN '```' ELSE content END"""


@query(
    "page_numbers",
    f"""WITH {CHUNKS_SQL}, paged AS (
  SELECT doc_id, i // 6 + 1 AS page, i AS line, {PAGES.replace(" div ", " // ")} AS content FROM (SELECT doc_id, chunk_index AS i, content FROM chunks)
), fenced AS (
  SELECT *, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS t, regexp_matches(trim(content), '^(```|~~~)') AS fence, (count(*) FILTER (WHERE regexp_matches(trim(content), '^(```|~~~)')) OVER (PARTITION BY doc_id, page ORDER BY line)) % 2 = 1 AS inside FROM paged
), body AS (
  SELECT doc_id, page, line, t, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line DESC) AS z FROM fenced WHERE NOT fence AND NOT inside AND t <> ''
), seen AS (
  SELECT doc_id, page, line, CASE WHEN z <= 2 THEN 'tail' ELSE 'head' END AS edge, regexp_extract(t, '^(?i)page ([0-9]+) of [0-9]+$', 1) AS f, regexp_extract(t, '^(?:- )?([0-9]{{1,4}})(?: -)?$', 1) AS b FROM body WHERE a <= 2 OR z <= 2
), numbers AS (
  SELECT doc_id, page, line, edge, f <> '' AS explicit, CAST(CASE WHEN f <> '' THEN f ELSE b END AS INTEGER) AS printed FROM seen WHERE f <> '' OR b <> ''
)
SELECT n.doc_id, n.page, n.line, n.edge, n.printed, n.explicit OR n.printed = n.page OR EXISTS (SELECT 1 FROM numbers o WHERE o.doc_id = n.doc_id AND o.edge = n.edge AND NOT o.explicit AND NOT n.explicit AND o.page <> n.page AND o.printed - o.page = n.printed - n.page) AS removed
FROM numbers n""",
)
def page_numbers(spark, sf):
    """Numbers at the edges of pages of six lines, and which of them are page numbers; the lines get numbers and code by rule."""
    from fathomline.operators import pages

    lines = chunks(spark, sf).select("doc_id", F.col("chunk_index").alias("i"), "content")
    lines = lines.select("doc_id", F.expr("cast(i div 6 + 1 as int)").alias("page"), F.col("i").alias("line"), F.expr(PAGES).alias("content"))
    return pages.page_numbers(lines).where("printed is not null").select("doc_id", "page", "line", "edge", "printed", "removed")


@query(
    "table_chains",
    """WITH RECURSIVE tables AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_linenumber + CAST(l_partkey % 9 = 0 AS INTEGER) AS page, 2 + CAST(l_suppkey % 5 = 0 AS INTEGER) AS columns, l_linestatus AS header,
         CAST(l_quantity AS INTEGER) AS rows, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'Table ' || l_returnflag || ' （续）' ELSE 'Table ' || l_returnflag END AS title FROM lineitem
), steps AS (
  SELECT doc_id, place, page, columns, header, rows, title, 1 AS chain, coalesce(title, '') AS held, CAST(rows AS BIGINT) AS total, CAST(0 AS BIGINT) AS row_offset FROM tables WHERE place = 1
  UNION ALL
  SELECT doc_id, place, page, columns, header, rows, title, chain + CAST(NOT joins AS INTEGER), CASE WHEN joins AND held <> '' THEN held ELSE coalesce(title, '') END, CASE WHEN joins THEN total + rows - least(rows, 1) ELSE rows END, CASE WHEN joins THEN total ELSE 0 END
  FROM (SELECT t.*, s.chain, s.held, s.total, t.page = s.page + 1 AND t.columns = s.columns AND t.header = s.header AND (coalesce(t.title, '') LIKE '%（续）%' OR (coalesce(t.title, '') <> '' AND replace(t.title, ' （续）', '') = replace(s.held, ' （续）', ''))) AS joins
        FROM tables t JOIN steps s ON t.doc_id = s.doc_id AND t.place = s.place + 1)
)
SELECT doc_id, place, CAST(chain AS BIGINT) AS chain, row_offset FROM steps""",
)
def table_chains(spark, sf):
    """Line items as tables on the pages of their order: which continue the one before. Pages, columns and titles follow a stated rule."""
    from fathomline.operators import pages

    k = F.col("l_partkey")
    title = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, F.concat(F.lit("Table "), "l_returnflag", F.lit(" （续）"))).otherwise(F.concat(F.lit("Table "), "l_returnflag"))
    page = (F.col("l_linenumber") + (k % 9 == 0).cast("int")).cast("int")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("place"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("table_id"), page.alias("first_page"), page.alias("last_page"),
        (2 + (F.col("l_suppkey") % 5 == 0).cast("int")).alias("columns"), F.array(F.array(F.col("l_linestatus"))).alias("header"), F.lit(1).alias("header_rows"), F.col("l_quantity").cast("int").alias("rows"), title.alias("title"),
    )
    return pages.table_chains(rows).select("doc_id", "place", "chain", "row_offset")


@query("html_visible")
def html_visible(spark, sf):
    """Visible text of each page: without removed elements, hidden ones and comments."""
    from fathomline.functions.maincontent import read_page

    return table(spark, sf, "pages").select("page_id", fn.series(lambda t: read_page(t)[0].text)("string")("html").alias("t")).select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))
