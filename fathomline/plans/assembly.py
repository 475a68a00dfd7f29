"""Queries of document structure, exact tokens and final chunks.

Documents have no structure of their own, so that it is given to their lines by stated rules (``NUMBERED``, ``KINDS``); every
line of every document takes part, whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.functions.text import upper_each
from fathomline.operators import assembly as op
from fathomline.operators import chunking, structure
from fathomline.operators.tokens import Vocabulary
from fathomline.plans.chunking import markdown_documents
from fathomline.sources.tables import CHUNKS_SQL, chunks, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(spark) -> Vocabulary:
    """The registered queries' vocabulary; operators take any."""
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


#: Sections n on every sixth line, n.1 and n.(2 + doc_id % 3) below them, two kinds of outline and articles on some others.
NUMBERED = """CASE WHEN i % 6 = 0 THEN concat(i div 6 + 1, ' ', left(content, 60)) WHEN i % 6 = 2 THEN concat(i div 6 + 1, '.1 ', left(content, 60))
WHEN i % 6 = 4 AND doc_id % 4 > 0 THEN concat(i div 6 + 1, '.', 2 + doc_id % 3, ' ', left(content, 60)) WHEN i % 6 = 3 AND doc_id % 5 = 0 THEN concat('二、', left(content, 60))
WHEN i % 12 = 5 THEN concat('（一）', left(content, 60)) WHEN i % 12 = 11 THEN concat('第', i, '条 ', content) ELSE content END"""


@query(
    "structure_bounds",
    f"""WITH {CHUNKS_SQL}, numbered AS (
  SELECT doc_id, i, trim({NUMBERED.replace('i div 6', 'i // 6')}) AS t FROM (SELECT doc_id, chunk_index AS i, content FROM chunks)
), looks AS (
  SELECT doc_id, i, t, CASE WHEN regexp_matches(t, '^第[0-9]+条') THEN 'legal_article' WHEN regexp_matches(t, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{0,4}}[ \\t]+[^ \\t]') OR regexp_matches(t, '^[0-9]{{1,3}}[.、]\\s*\\S') THEN 'decimal'
    WHEN regexp_matches(t, '^[一二三四五六七八九十]+、\\s*\\S') THEN 'chinese_outline' WHEN regexp_matches(t, '^（[一二三四五六七八九十]+）\\s*\\S') THEN 'chinese_subsection' END AS kind FROM numbered WHERE length(t) BETWEEN 1 AND 120
), labels AS (
  SELECT doc_id, i, list_transform(string_split(rtrim(regexp_extract(t, '^[0-9.]+'), '.'), '.'), lambda x: CAST(x AS INTEGER)) AS label FROM looks WHERE kind = 'decimal'
), runs AS (
  SELECT DISTINCT a.doc_id, a.label[:-2] AS parent FROM labels a JOIN labels b ON a.doc_id = b.doc_id AND a.label[:-2] = b.label[:-2] AND b.label[-1] = a.label[-1] + 1
), nested AS (
  SELECT DISTINCT doc_id FROM runs WHERE len(parent) > 0
)
SELECT l.doc_id, l.i AS position, CASE l.kind WHEN 'decimal' THEN 'decimal_section' ELSE l.kind END AS kind,
       CAST(CASE l.kind WHEN 'decimal' THEN least(5, len(label) + 1) WHEN 'chinese_outline' THEN 2 ELSE 3 END AS INTEGER) AS level, coalesce(l.kind = 'chinese_outline' OR len(label) = 1, false) AS hard, t AS heading
FROM looks l LEFT JOIN labels USING (doc_id, i)
WHERE l.kind = 'legal_article' OR (l.kind LIKE 'chinese%' AND (SELECT count(*) FROM looks o WHERE o.doc_id = l.doc_id AND o.kind = l.kind) >= 2)
   OR (len(label) = 1 AND l.doc_id IN (SELECT doc_id FROM nested)) OR (len(label) > 1 AND EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = l.doc_id AND r.parent = label[:-2]))""",
)
def structure_bounds(spark, sf):
    """Numbered lines that count as structure by the whole document's numbering."""
    lines = chunks(spark, sf).select("doc_id", F.col("chunk_index").alias("i"), "content")
    rows = lines.select("doc_id", F.col("i").alias("position"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.expr(NUMBERED).alias("body"))
    return structure.boundaries(rows).where("boundary is not null").select("doc_id", "position", "boundary.kind", "boundary.level", "boundary.hard", "boundary.heading")


#: Kinds of a document's lines, and levels of its headings.
KINDS = """CASE WHEN i % 4 = 0 OR i % 12 = 6 THEN 'heading' WHEN i % 7 = 3 THEN 'table' WHEN i % 11 = 5 THEN 'image' WHEN i % 9 = 8 THEN 'horizontal_rule' ELSE 'paragraph' END"""
LEVEL = "CASE WHEN i % 12 = 0 THEN 1 WHEN i % 4 = 0 THEN 2 WHEN i % 12 = 6 THEN 4 ELSE 0 END"
SUPPRESSED = "i % 13 = 1 AND doc_id % 2 = 0"
PATHS_SQL = f"""
{CHUNKS_SQL}, elements AS (
  SELECT doc_id, i, content, {KINDS} AS kind, {LEVEL} AS level, {SUPPRESSED} AS suppressed FROM (SELECT doc_id, chunk_index AS i, content FROM chunks)
), spots AS (
  SELECT *, max(CASE WHEN level = 1 THEN i END) OVER w AS p1, max(CASE WHEN level = 2 THEN i END) OVER w AS p2, max(CASE WHEN level = 4 THEN i END) OVER w AS p4 FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), paths AS (
  SELECT a.*, list_filter([h1.content, CASE WHEN p2 > coalesce(p1, -1) THEN h2.content END, CASE WHEN p4 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN h4.content END], lambda x: x IS NOT NULL) AS trail
  FROM spots a LEFT JOIN elements h1 ON h1.doc_id = a.doc_id AND h1.i = p1 LEFT JOIN elements h2 ON h2.doc_id = a.doc_id AND h2.i = p2 LEFT JOIN elements h4 ON h4.doc_id = a.doc_id AND h4.i = p4
)
"""


def line_elements(spark, sf):
    """Lines as elements of the kinds above, with heading paths; tables and images in Markdown."""
    lines = chunks(spark, sf).select("doc_id", F.col("chunk_index").alias("i"), "content")
    rows = lines.select("doc_id", F.col("i").alias("position"), F.expr(KINDS).alias("kind"), F.expr(LEVEL).alias("level"), F.expr(SUPPRESSED).alias("suppressed"), "content")
    body = F.when(F.col("kind") == "table", F.concat(F.lit("| n | line |\n| --- | --- |\n| "), F.col("position").cast("string"), F.lit(" | "), "content", F.lit(" |"))).when(F.col("kind") == "image", F.concat(F.lit("!["), "content", F.lit("](line.png)"))).otherwise(F.col("content"))
    heading = F.col("kind") == "heading"
    return structure.heading_paths(rows.withColumn("body", body), F.when(heading, F.col("content")), F.when(heading, F.col("level")))


@query("heading_path", f"WITH {PATHS_SQL} SELECT doc_id, i AS position, trail FROM paths")
def heading_path(spark, sf):
    """Every line's heading path, of any depth."""
    return line_elements(spark, sf).select("doc_id", "position", "trail")


@query(
    "heading_identity",
    f"""WITH {PATHS_SQL}, named AS (SELECT doc_id, i, trail, row_number() OVER (PARTITION BY doc_id, trail ORDER BY i) - 1 AS n FROM paths WHERE kind = 'heading')
SELECT doc_id, i AS position, CAST(n AS INTEGER) AS occurrence, sha256(doc_id || chr(31) || array_to_string(trail, chr(31)) || chr(31) || n) AS heading_key FROM named""",
)
def heading_identity(spark, sf):
    """Identity of every heading: its document, its whole path, and how often that path came before."""
    from pyspark.sql import Window

    found = line_elements(spark, sf).where("kind = 'heading'")
    before = F.row_number().over(Window.partitionBy("doc_id", "trail").orderBy("position")) - 1
    key = F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.array_join("trail", "\x1f"), F.col("occurrence").cast("string"))
    return found.select("doc_id", "position", "trail", before.cast("int").alias("occurrence")).select("doc_id", "position", "occurrence", F.sha2(key, 256).alias("heading_key"))


@query(
    "derived_elements",
    f"""WITH {PATHS_SQL}, near AS (
  SELECT doc_id, i, kind, suppressed, trail, lag(i) OVER w AS b, lead(i) OVER w AS a, lag(suppressed) OVER w AS bs, lead(suppressed) OVER w AS az FROM paths WHERE kind <> 'horizontal_rule' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), found AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS n FROM near WHERE kind IN ('table', 'image') AND NOT suppressed
)
SELECT doc_id, i AS position, kind, trail, kind || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS element_id, CASE WHEN NOT bs THEN b END AS before_position, CASE WHEN NOT az THEN a END AS after_position FROM found""",
)
def derived_elements(spark, sf):
    """Tables and images with ids, heading paths and both neighbours; noise is passed over."""
    return op.derived_elements(line_elements(spark, sf)).select("doc_id", "position", "kind", "trail", "element_id", "before_position", "after_position")


@query("derived_chunks")
def derived_chunks(spark, sf):
    """A chunk for every table and image, with 64 tokens of both neighbours."""
    return op.derived_chunks(line_elements(spark, sf), vocabulary(spark))


@query("structured_chunks")
def structured_chunks(spark, sf):
    """Coarse chunks at headings, clauses and levels, by exact token counts."""
    tokens = vocabulary(spark).count(F.col("body"), strip=True)
    return structure.gathered(structure.coarse_chunks(chunking.elements(markdown_documents(spark, sf)).withColumn("level", F.col("level").cast("int")), tokens))


@query("final_chunks")
def final_chunks(spark, sf):
    """The coarse chunks with exact counts, cut or flagged where they are too long."""
    return op.final_chunks(structured_chunks(spark, sf), vocabulary(spark)).select("doc_id", "chunk", "tokens", "original_tokens", "truncated", "oversized", "reason", F.sha2("content", 256).alias("content_hash"))


@query("token_overlap")
def token_overlap(spark, sf):
    """Every chunk with 64 tokens of its neighbours, within 512 tokens in all."""
    framed = op.with_overlap(chunks(spark, sf), ["doc_id"], "chunk_index", vocabulary(spark), 64, 512)
    return framed.select("chunk_id", "framed.before_tokens", "framed.after_tokens", F.sha2("framed.content", 256).alias("framed_hash"))


@query("bpe_count")
def bpe_count(spark, sf):
    """Exact tokens of every chunk."""
    return chunks(spark, sf).select("chunk_id", vocabulary(spark).count(F.col("content")).alias("n_tokens"))


@query("bpe_truncate")
def bpe_truncate(spark, sf):
    """Every document's first 256 tokens and how many are left out."""
    cut = vocabulary(spark).first(F.col("text"), 256)
    return table(spark, sf, "documents").select("doc_id", cut.alias("c")).select("doc_id", "c.kept", "c.removed")


VIOLATIONS_SQL = f"""
WITH {CHUNKS_SQL}, whole AS (
  SELECT doc_id, string_agg(content, chr(10) ORDER BY chunk_index) AS content, max(chunk_index) AS last FROM chunks GROUP BY doc_id
), parts AS (
  SELECT doc_id, chunk_index AS i, CASE WHEN chunk_index = last THEN c.content ELSE c.content || chr(10) END AS content FROM chunks c JOIN whole USING (doc_id)
), kept AS (
  SELECT doc_id, i, CASE WHEN doc_id % 7 = 2 AND i % 3 = 1 THEN upper(content) ELSE content END AS content FROM parts WHERE NOT (doc_id % 7 = 1 AND i % 5 = 2)
)
SELECT doc_id, 'lossless' AS rule, '0' AS subject FROM kept JOIN whole w USING (doc_id) GROUP BY doc_id, w.content HAVING string_agg(kept.content, '' ORDER BY i) <> w.content
UNION ALL SELECT doc_id, 'source', '1:' || i FROM (SELECT doc_id, max(i) AS i FROM kept WHERE doc_id % 7 = 3 GROUP BY doc_id)
UNION ALL SELECT doc_id, 'hard_max', '0:' || i FROM kept WHERE length(content) > 400
UNION ALL SELECT doc_id, 'anchor', 'e' || chunk_index FROM chunks c WHERE chunk_index % 4 = 3 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = c.doc_id AND k.i = c.chunk_index AND length(k.content) < 300) AND EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = c.doc_id AND length(k.content) < 300)
UNION ALL SELECT doc_id, 'protected', 'p' || chunk_index FROM chunks c WHERE chunk_index % 6 = 5 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = c.doc_id AND k.i - k.i % 2 <= c.chunk_index AND k.i - k.i % 2 + 2 >= c.chunk_index + c.doc_id % 3)
"""


@query("chunk_violations", VIOLATIONS_SQL)
def chunk_violations(spark, sf):
    """Faults planted into the lines of documents as final chunks: lines gone, changed, without a source, too long, unanchored, cut ranges."""
    lines = chunks(spark, sf)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n")  # the lines of one document
    whole = lines.groupBy("doc_id").agg(joined.alias("content"), F.max("chunk_index").alias("last"))
    i, d = F.col("chunk_index"), F.col("doc_id")
    parts = lines.join(whole.select("doc_id", "last"), "doc_id").withColumn("content", F.when(i == F.col("last"), F.col("content")).otherwise(F.concat("content", F.lit("\n"))))
    kept = parts.where(~((d % 7 == 1) & (i % 5 == 2))).withColumn("content", F.when((d % 7 == 2) & (i % 3 == 1), upper_each(F.col("content"))).otherwise(F.col("content")))
    finals = kept.select(
        "doc_id", F.lit(0).alias("chunk"), i.alias("place"), "content", F.length("content").alias("tokens"), F.array(F.lit("paragraph")).alias("kinds"), F.lit(False).alias("truncated"),
        F.when(F.length("content") < 300, F.array(F.concat(F.lit("e"), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("contained"), (i - i % 2).alias("first_line"), (i - i % 2 + 2).alias("last_line"),
    )
    lost = finals.where(d % 7 == 3).groupBy("doc_id").agg(F.max(F.struct("place", F.lit("").alias("content"))).alias("p")).select("doc_id", F.lit(1).alias("chunk"), "p.place", "p.content", F.lit(0).alias("tokens"), F.array(F.lit("paragraph")).alias("kinds"), F.lit(False).alias("truncated"), F.array().cast("array<string>").alias("contained"), F.lit(-9).alias("first_line"), F.lit(-9).alias("last_line"))
    derived = lines.where(i % 4 == 3).select("doc_id", F.concat(F.lit("e"), i.cast("string")).alias("element_id"))
    ranges = lines.where(i % 6 == 5).select("doc_id", F.concat(F.lit("p"), i.cast("string")).alias("element_id"), i.alias("first_line"), (i + d % 3).alias("last_line"))
    return op.violations(whole.select("doc_id", F.lit(0).alias("chunk"), "content"), finals.unionByName(lost), 400, derived, ranges)
