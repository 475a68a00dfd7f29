"""Pages of a source held against pages of its output: tables, images and formulas, critical tokens, collections, described images.

A page is a row (doc_id, page, ...); joins are by document and page, so that a document's pages are worked on wherever they lie.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import signals as fn
from fathomline.functions.text import composed, series

KEYS = ["doc_id", "page"]
MATRICES = "array<array<array<string>>>"
# Share of a page above which its images count as one, and how grave each kind of loss is.
HIGH_COVERAGE = 0.6
SEVERITIES = {"table": "BLOCKING", "image": "WARNING", "covering image": "BLOCKING", "formula": "BLOCKING", "hinted formula": "WARNING", "page": "BLOCKING"}
#: Fixed value: what a picture's description says when there is none.
PLACEHOLDER = r"(?i)(?:未提供|暂无|无)(?:图片|图表|图像)?(?:说明|描述|内容)|(?:image|figure)\s*(?:description|caption)\s*(?:missing|unavailable)"


def page_signals(markdown: Column, least: int = fn.DESCRIPTION_CHARS) -> Column:
    """tables (canonical matrices), images, descriptions and formulas (signatures) of each page; null as an empty page."""

    @F.pandas_udf(f"tables {MATRICES}, images int, descriptions int, formulas array<array<string>>")
    def find(pages: pd.Series) -> pd.DataFrame:
        rows = [fn.signals(t, least) for t in pages]
        return pd.DataFrame([(s.tables, s.images, s.descriptions, s.formulas) for s in rows], columns=["tables", "images", "descriptions", "formulas"])

    return find(markdown)


def signature(formula: Column) -> Column:
    """``formula_signature`` of a column."""

    @F.pandas_udf("array<string>")
    def sign(values: pd.Series) -> pd.Series:
        return values.map(fn.formula_signature)

    return sign(formula)


def _lacking(wanted: Column, given: Column) -> Column:
    """Whether some value stands more often in ``wanted`` than in ``given``; the lists of one page."""
    times = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    return F.exists(F.array_distinct(wanted), lambda x: times(wanted, x) > times(given, x))


def _shortfall(code: str, got: Column) -> Column:
    return F.concat(F.lit(code), F.when(got == 0, "_OUTPUT_MISSING").otherwise("_OUTPUT_COUNT_SHORTFALL"))


def page_issues(source: DataFrame, output: DataFrame, severities: dict[str, str] | None = None) -> DataFrame:
    """doc_id, page, kind, code and severity of every fault of ``output`` (doc_id, page, markdown) against ``source``.

    ``source`` has doc_id, page, tables, images, formulas and hinted (counts; null as 0), image_share, matrices (canonical, of its
    tables) and signatures (of its formulas). Fewer tables or formulas than in the source are missing or a shortfall, as many
    with other content a mismatch. Images may be shown or described; a page that images cover needs one of either. A page on
    one side only is a fault of kind ``page``. A page has at most one row on each side.
    """
    grave = {**SEVERITIES, **(severities or {})}
    shown = output.select(*KEYS, page_signals(F.col("markdown")).alias("o"), F.lit(True).alias("_out"))
    both = source.withColumn("_in", F.lit(True)).join(shown, KEYS, "full_outer")
    want = lambda name: F.coalesce(F.col(name), F.lit(0))
    tables, made = F.coalesce(F.size("o.tables"), F.lit(0)), F.coalesce(F.size("o.formulas"), F.lit(0))
    covered = F.coalesce(F.col("image_share") >= HIGH_COVERAGE, F.lit(False))
    pictures = F.col("o.images") + F.col("o.descriptions")
    pictures_due = F.when(covered, 1).otherwise(want("images"))

    def fault(kind: str, code: Column, severity: str | Column | None = None) -> Column:
        grade = severity if isinstance(severity, Column) else F.lit(grave[severity or kind])
        return F.struct(F.lit(kind).alias("kind"), code.alias("code"), grade.alias("severity"))

    table = F.when(tables < want("tables"), fault("table", _shortfall("TABLE", tables))).when(_lacking(F.col("matrices"), F.col("o.tables")), fault("table", F.lit("TABLE_CONTENT_MISMATCH")))
    image_code = _shortfall("IMAGE", pictures)
    image_code = F.when(covered, F.concat(F.lit("HIGH_IMAGE_COVERAGE"), F.substr(image_code, F.lit(len("IMAGE") + 1)))).otherwise(image_code)
    image = F.when(pictures < pictures_due, fault("image", image_code, F.when(covered, grave["covering image"]).otherwise(grave["image"])))
    formula = (
        F.when(made < want("formulas"), fault("formula", _shortfall("FORMULA", made)))
        .when(made < want("hinted"), fault("formula", _shortfall("HINTED_FORMULA", made), "hinted formula"))
        .when(_lacking(F.col("signatures"), F.col("o.formulas")), fault("formula", F.lit("FORMULA_TOKEN_MISMATCH")))
    )
    page = F.when(F.col("_out").isNull(), fault("page", F.lit("PAGE_MISSING"))).when(F.col("_in").isNull(), fault("page", F.lit("PAGE_UNEXPECTED")))
    found = F.when(page.isNotNull(), F.array(page)).otherwise(F.array_compact(F.array(table, image, formula)))
    return both.select(*KEYS, F.explode(found).alias("i")).select(*KEYS, "i.kind", "i.code", "i.severity")


def document_verdicts(source: DataFrame, issues: DataFrame) -> DataFrame:
    """pages, passed (nothing blocks), blocking and warnings (counts) and affected pages by kind of every document of ``source``, and of those that issues name only."""
    one = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("page")))).alias(f"{kind}_pages")
    blocks = F.col("severity") == "BLOCKING"
    found = issues.groupBy("doc_id").agg(F.count_if(blocks).alias("blocking"), F.count_if(~blocks).alias("warnings"), *map(one, ("table", "image", "formula")))
    every = source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).join(found, "doc_id", "full_outer")
    none = F.array().cast("array<int>")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("pages", "blocking", "warnings")}
    return every.withColumns(counts | {f"{k}_pages": F.coalesce(F.col(f"{k}_pages").cast("array<int>"), none) for k in ("table", "image", "formula")}).withColumn("passed", F.col("blocking") == 0)


def exactness(gold: DataFrame, found: DataFrame, by: list[str], signature: list[str]) -> DataFrame:
    """matched, wanted, given and exactness of the collections ``gold`` and ``found``, as multisets of ``signature`` for each ``by``.

    Exactness is the share of what both sides have in the larger side, 1 where both are empty (such keys have no row).
    Occurrences are counted before they are joined, so that a value's repeats don't multiply. Nulls are equal to nulls.
    """
    keys = [*by, *signature]
    side = lambda rows, w, g: rows.select(*keys, F.lit(w).alias("w"), F.lit(g).alias("g"))
    counted = side(gold, 1, 0).unionByName(side(found, 0, 1)).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("g").alias("g"))
    return _exactness(counted, by)


def _exactness(counted: DataFrame, by: list[str]) -> DataFrame:
    total = counted.groupBy(*by).agg(F.sum(F.least("w", "g")).alias("matched"), F.sum("w").alias("wanted"), F.sum("g").alias("given"))
    return total.withColumn("exactness", F.col("matched") / F.greatest("wanted", "given", F.lit(1)))


def _plain(text: Column) -> Column:
    """Composed letters (NFC), without page markers and images."""

    bare = F.regexp_replace(text, r"(?m)^[\t ]*<!--[\t ]*[A-Z]+_PAGE:\d+[\t ]*-->[\t ]*$", "")
    for image in (r"!\[[^\]\r\n]*\]\([^)\r\n]*\)", r"(?i)<img\b[^>]*>"):
        bare = F.regexp_replace(bare, image, "")
    return series(composed)("string")(bare)


def critical_tokens(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, category, matched, wanted, given and exactness of the tokens of ``gold`` (doc_id, category, value, page) in ``pages`` (doc_id, page, text).

    A token is found where no ASCII letter, digit or underscore touches it, so that ``2024`` is in ``2024年`` and not in
    ``12024``; with a page it counts there only, without in the whole document. The number of occurrences counts: too many are
    as wrong as too few. Empty and null values are found nowhere.
    """

    keys = ["doc_id", "category", "value", "at"]
    wanted = gold.select("doc_id", "category", series(composed)("string")("value").alias("value"), F.col("page").alias("at")).groupBy(*keys).agg(F.count(F.lit(1)).alias("w"))
    texts = pages.select("doc_id", "page", _plain(F.col("text")).alias("text"))
    quoted = F.concat(F.lit("(?<![0-9A-Za-z_])\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![0-9A-Za-z_])"))
    near = wanted.where("value <> ''").join(texts, "doc_id").where("at is null or at = page")
    seen = near.select(*keys, F.regexp_count("text", quoted).alias("n")).groupBy(*keys).agg(F.sum("n").alias("g"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    test = same[0]
    for s in same[1:]:
        test = test & s
    counted = wanted.alias("a").join(seen.alias("b"), test, "left").select("a.doc_id", "a.category", "a.w", F.coalesce("b.g", F.lit(0)).alias("g"))
    return _exactness(counted, ["doc_id", "category"])


def described(descriptions: list[str]) -> Column:
    """Whether one of an image chunk's texts says what is seen: eight characters besides images and white space, and no placeholder."""

    def says(name: str) -> Column:
        text = F.regexp_replace(F.regexp_replace(name, r"!\[[^\]\r\n]*\]\([^)\r\n]*\)", ""), r"(?i)<img\b[^>]*>", "")
        text = F.regexp_replace(text, r"(?U)\s+", "")
        return F.coalesce((F.length(text) >= fn.DESCRIPTION_CHARS) & ~text.rlike(PLACEHOLDER), F.lit(False))

    return F.array_max(F.array(*map(says, descriptions)))


def undescribed_images(chunks: DataFrame, descriptions: list[str]) -> DataFrame:
    """images and undescribed (ids, sorted) of each document's image ``chunks`` (doc_id, chunk_id and the columns ``descriptions``)."""
    silent = F.when(~described(descriptions), F.col("chunk_id"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"), F.sort_array(F.collect_list(silent)).alias("undescribed"))
