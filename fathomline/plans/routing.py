"""Queries of report kinds. The corpus is invented prose in four languages, so that kinds are told by its most common words."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import routing as op
from fathomline.sources.tables import table

#: kind, phrase, weight.
PHRASES = [op.term("de", "der"), op.term("de", "nicht"), op.Phrase("de", "sch", op.APPLIES), op.term("en", "the"), op.term("en", "tion"), op.Phrase("en", "of the", op.APPLIES), op.Phrase("en", "ñ", op.AGAINST), op.term("es", "que"), op.term("es", "mente"), op.Phrase("es", "ción", op.APPLIES), op.Phrase("es", "sch", op.AGAINST), op.Phrase("fr", "ement", op.DEFINED), op.term("fr", "les")]
ROUTES_SQL = f"""phrases AS (
  SELECT * FROM (VALUES {", ".join(f"({k}, '{p.kind}', '{p.phrase}', {p.weight}e0)" for k, p in enumerate(PHRASES))}) AS v(place, kind, phrase, weight)
), texts AS (
  SELECT doc_id, lower(regexp_replace(coalesce(source, '') || chr(10) || coalesce(text, ''), '[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+', ' ', 'g')) AS t FROM documents
), scores AS (
  SELECT doc_id, kind, greatest(sum(CASE WHEN contains(t, phrase) THEN weight ELSE 0 END), 0) AS score FROM texts CROSS JOIN phrases GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER w AS place, score - lead(score) OVER w AS margin FROM scores WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, kind)
)"""


def routed(spark, sf):
    return op.routes(table(spark, sf, "documents").select("doc_id", F.col("source").alias("filename"), "text"), PHRASES)


@query("document_routes", f"WITH {ROUTES_SQL} SELECT doc_id, CASE WHEN score >= 8 AND margin >= 2.5 THEN 'CONFIDENT' ELSE 'AMBIGUOUS' END AS state, CASE WHEN score >= 8 AND margin >= 2.5 THEN kind END AS selected, kind AS best, score FROM ranked WHERE place = 1")
def document_routes(spark, sf):
    """The kind of every whole document, where its words tell it."""
    best = F.col("candidates")[0]
    return routed(spark, sf).select("doc_id", "state", "selected", best["kind"].alias("best"), best["score"].alias("score"))


@query(
    "attachment_roles",
    f"""WITH {ROUTES_SQL}, files AS (
  SELECT doc_id // 3 AS request, doc_id, score, max(score) OVER (PARTITION BY doc_id // 3) AS top, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS n FROM ranked WHERE place = 1
), requests AS (
  SELECT request, max(top) > 0 AND count(*) FILTER (WHERE score = top) = 1 AS chosen, min(doc_id) FILTER (WHERE score = top) AS best, min(doc_id) FILTER (WHERE score < top) AS other, min(doc_id) FILTER (WHERE n = 1) AS one, min(doc_id) FILTER (WHERE n = 2) AS two FROM files GROUP BY request
) SELECT request, CASE WHEN chosen THEN other ELSE one END AS subject, CASE WHEN chosen THEN best ELSE two END AS template FROM requests""",
)
def attachment_roles(spark, sf):
    """Three documents a request: the one most like a report is the layout, the first of the others what is written about."""
    files = table(spark, sf, "documents").select(F.expr("doc_id div 3").alias("request"), F.col("doc_id").alias("position"), "doc_id")
    return op.attachment_roles(files, routed(spark, sf))
