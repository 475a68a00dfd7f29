"""Queries of chunking. Documents have no headings of their own, so lines are given them by a stated rule: every twelfth
line opens a first-level section and every other fourth a second-level one, titled with its first 30 characters. The line
itself stays whole under its title."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.functions import markdown as md
from fathomline.operators import chunking as op
from fathomline.sources.tables import CHUNKS_SQL, chunks, table


def markdown_documents(spark, sf):
    def title(x):
        return F.concat(F.left(x, F.lit(30)), F.lit("\n\n"), x)

    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 12 == 0, F.concat(F.lit("# "), title(x))).when(i % 4 == 0, F.concat(F.lit("## "), title(x))).otherwise(x))
    return table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("text"))


@query("md_elements")
def md_elements(spark, sf):
    return op.elements(markdown_documents(spark, sf))


@query("heading_metrics")
def heading_metrics(spark, sf):
    return md_elements(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("kind") == "heading").alias("headings"), F.max("level").alias("deepest"))


@query("coarse_chunks")
def coarse_chunks(spark, sf):
    return op.coarse(markdown_documents(spark, sf))


@query("struct_bounds")
def struct_bounds(spark, sf):
    def bounds(t):
        return [(k, b) for k, line in enumerate((t or "").split("\n")) if (b := md.structural_boundary(line))]

    numbered = F.regexp_replace(F.col("text"), "(?m)^The ", "1.2 The ")
    return op.per_document(table(spark, sf, "documents").select("doc_id", numbered.alias("text")), "line long, kind long", bounds)


@query("semantic_segments")
def semantic_segments(spark, sf):
    return op.semantic(table(spark, sf, "documents"))


@query("cohesion")
def cohesion(spark, sf):
    return op.cohesions(table(spark, sf, "documents")).select("doc_id", "gap", "cohesion")


@query("depth_valley")
def depth_valley(spark, sf):
    return op.cohesions(table(spark, sf, "documents")).select("doc_id", "gap", "depth")


@query("overlap", f"WITH {CHUNKS_SQL} SELECT chunk_id, coalesce(right(lag(content) OVER w, 64), '') AS before, coalesce(left(lead(content) OVER w, 64), '') AS after FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def overlap(spark, sf):
    return op.overlap(chunks(spark, sf), ["doc_id"], "chunk_index", 64).select("chunk_id", "before", "after")


@query("chunk_drafts", f"WITH {CHUNKS_SQL} SELECT substring(sha256(doc_id || ':' || chunk_index || ':' || sha256(content)), 1, 32) AS draft_id, doc_id, chunk_index, sha256(content) AS content_hash FROM chunks")
def chunk_drafts(spark, sf):
    return op.drafts(chunks(spark, sf))


@query("chunk_invariants", "SELECT doc_id, true AS lossless FROM documents WHERE text IS NOT NULL")
def chunk_invariants(spark, sf):
    """Lines joined again in order give the text: checked by hash, document by document."""
    from fathomline.sources.tables import table as t

    docs = t(spark, sf, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    joined = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("again"))  # the lines of one document
    return docs.join(joined, "doc_id").select("doc_id", (F.sha2("text", 256) == F.sha2("again", 256)).alias("lossless"))


TRAIL_SQL = f"""
{CHUNKS_SQL}, marked AS (
  SELECT *, CASE WHEN chunk_index % 12 = 0 THEN content END AS t1, CASE WHEN chunk_index % 4 = 0 AND chunk_index % 12 > 0 THEN content END AS t2 FROM chunks
), trails AS (
  SELECT chunk_id, doc_id, chunk_index, last_value(t1 IGNORE NULLS) OVER w AS h1,
         CASE WHEN max(CASE WHEN t2 IS NOT NULL THEN chunk_index END) OVER w > coalesce(max(CASE WHEN t1 IS NOT NULL THEN chunk_index END) OVER w, -1) THEN last_value(t2 IGNORE NULLS) OVER w END AS h2
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)
)
"""


def trails(spark, sf):
    rows = chunks(spark, sf)
    i = F.col("chunk_index")
    h1, h2 = op.trail([F.when(i % 12 == 0, F.col("content")), F.when((i % 4 == 0) & (i % 12 > 0), F.col("content"))], ["doc_id"], "chunk_index")
    return rows.select("chunk_id", "doc_id", "chunk_index", h1.alias("h1"), h2.alias("h2"))


@query("heading_trail", f"WITH {TRAIL_SQL} SELECT chunk_id, h1, h2 FROM trails")
def heading_trail(spark, sf):
    return trails(spark, sf).select("chunk_id", "h1", "h2")


@query("doc_outline", f"WITH {TRAIL_SQL} SELECT doc_id, h1, h2, min(chunk_index) AS first_index, count(*) AS n FROM trails GROUP BY doc_id, h1, h2")
def doc_outline(spark, sf):
    return trails(spark, sf).groupBy("doc_id", "h1", "h2").agg(F.min("chunk_index").alias("first_index"), F.count(F.lit(1)).alias("n"))


@query("section_read", f"WITH {TRAIL_SQL}, s AS (SELECT t.*, row_number() OVER (PARTITION BY t.doc_id, t.h1 ORDER BY t.chunk_index) AS place FROM trails t WHERE h1 IS NOT NULL) SELECT doc_id, chunk_id, place FROM s WHERE place <= 8")
def section_read(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id", "h1").orderBy("chunk_index"))
    return trails(spark, sf).where("h1 is not null").withColumn("place", place).where("place <= 8").select("doc_id", "chunk_id", "place")
