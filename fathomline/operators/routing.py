"""Which kind of report a text belongs to, and which of several files is the layout to follow."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a class must score, and lead by, to be chosen; what terms and phrases weigh; how many are named.
LEAST_SCORE, LEAST_MARGIN = 8.0, 2.5
TERM, SHORT_TERM, APPLIES, DEFINED, AGAINST = 3.0, 2.0, 5.0, 1.5, -6.0
TERM_CHARS, NAMED, CANDIDATES = 4, 8, 3


class Phrase(NamedTuple):
    """A phrase of a class and its weight; a negative one speaks against the class."""

    kind: str
    phrase: str
    weight: float


def term(kind: str, phrase: str) -> Phrase:
    """A routing term; short ones weigh less."""
    return Phrase(kind, phrase, TERM if len(phrase) >= TERM_CHARS else SHORT_TERM)


def routes(documents: DataFrame, phrases: list[Phrase], least_score: float = LEAST_SCORE, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """doc_id, state, selected and candidates (the three best classes: kind, score, matched, against) of ``documents`` (doc_id, filename, text).

    A phrase counts once however often it stands in name or text, whatever its case and white space. A class's score doesn't fall below
    0; equal scores are ordered by class. The best is chosen if it scores enough and leads the next by enough. Null texts are empty.
    The phrases are a literal of the plan, tested inside one pass over the texts.
    """
    kinds = sorted({p.kind for p in phrases})
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    text = flat(F.concat_ws("\n", F.coalesce("filename", F.lit("")), F.coalesce("text", F.lit(""))))
    listed = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(p.kind).alias("kind"), F.lit(p.phrase).alias("phrase"), F.lit(" ".join(p.phrase.lower().split())).alias("form"), F.lit(float(p.weight)).alias("weight")) for k, p in enumerate(phrases)))
    rows = documents.select("doc_id", text.alias("_text")).withColumn("_hits", F.filter(listed, lambda p: F.contains(F.col("_text"), p["form"])))

    def judged(kind: str):
        mine = F.filter("_hits", lambda h: h["kind"] == kind)
        score = F.greatest(F.aggregate(mine, F.lit(0.0), lambda a, h: a + h["weight"]), F.lit(0.0))
        says = lambda test, n: F.slice(F.array_distinct(F.transform(F.filter(mine, test), lambda h: h["phrase"])), 1, n)
        return F.struct((-score).alias("minus"), F.lit(kind).alias("kind"), score.alias("score"), says(lambda h: h["weight"] > 0, NAMED).alias("matched"), says(lambda h: h["weight"] < 0, CANDIDATES).alias("against"))

    ranked = rows.select("doc_id", F.array_sort(F.array(*map(judged, kinds))).alias("r"))
    lead = F.col("r")[0]["score"] - F.coalesce(F.try_element_at("r", F.lit(2))["score"], F.lit(0.0))
    sure = (F.col("r")[0]["score"] >= least_score) & (lead >= least_margin)
    best = F.transform(F.slice("r", 1, CANDIDATES), lambda c: F.struct(c["kind"].alias("kind"), c["score"].alias("score"), c["matched"].alias("matched"), c["against"].alias("against")))
    return ranked.select("doc_id", F.when(sure, "CONFIDENT").otherwise("AMBIGUOUS").alias("state"), F.when(sure, F.col("r")[0]["kind"]).alias("selected"), best.alias("candidates"))


def attachment_roles(attachments: DataFrame, routed: DataFrame) -> DataFrame:
    """request, subject and template of every request of ``attachments`` (request, position, doc_id).

    The file that is most like a report is the template and the first of the others the subject. Where none is like one, or two
    are equally so, the first is the subject and the second the template; a single file that isn't is the subject, one that is the template.
    """
    liking = routed.select("doc_id", F.col("candidates")[0]["score"].alias("score"))
    scored = attachments.join(liking, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    listed = scored.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id", "score"))).alias("files"))  # the files of one request
    top = F.array_max(F.transform("files", lambda f: f["score"]))
    listed = listed.withColumn("top", top).withColumn("best", F.filter("files", lambda f: f["score"] == F.col("top")))
    chosen = (F.col("top") > 0) & (F.size("best") == 1)
    others = F.filter("files", lambda f: f["position"] != F.col("best")[0]["position"])
    subject = F.when(chosen, F.get(others, F.lit(0))["doc_id"]).otherwise(F.get("files", F.lit(0))["doc_id"])
    template = F.when(chosen, F.col("best")[0]["doc_id"]).otherwise(F.get("files", F.lit(1))["doc_id"])
    return listed.select("request", subject.alias("subject"), template.alias("template"))
