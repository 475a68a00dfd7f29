"""Markdown files and the ceilings that inputs must keep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
# What a document may hold before it is refused, in the order in which they are checked.
LIMITS = {"pages": 1000, "images": 2000, "image_pixels": 50_000_000, "total_image_pixels": 750_000_000, "image_bytes": 20 << 20, "total_image_bytes": 200 << 20, "output_files": 10_000, "output_bytes": 500 << 20}


def markdown_files(spark: SparkSession, path: str, pattern: str = "*.md", most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, n_bytes, text, n_lines and problem of every file under ``path`` that fits ``pattern``.

    Text is UTF-8, its byte order mark is left out. A file that isn't UTF-8, has no text or has more than ``most_bytes`` has a
    problem (``not_utf8``, ``empty``, ``too_large``) and no text; too large ones are told by their length and not read. Spark
    passes over files without a byte: they have no row.
    """

    @F.pandas_udf("string")
    def decoded(contents: pd.Series) -> pd.Series:
        def one(c: bytes | None) -> str | None:
            try:
                return None if c is None else bytes(c).decode("utf-8-sig")
            except UnicodeDecodeError:
                return None

        return contents.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    small = files.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("n_bytes"), decoded("content").alias("text"))
    problem = F.when(F.col("text").isNull(), "not_utf8").when(~F.col("text").rlike(r"(?U)\S"), "empty")
    small = small.select("path", "n_bytes", problem.alias("problem"), F.when(problem.isNull(), F.col("text")).alias("text"))
    large = files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("n_bytes"), F.lit("too_large").alias("problem"), F.lit(None).cast("string").alias("text"))
    lines = F.size(F.split(F.regexp_replace("text", "\r\n?|\n", "\n"), "\n")) - F.col("text").rlike("[\r\n]\\z").cast("int")
    return small.unionByName(large).select("path", "n_bytes", "text", F.when(F.col("text").isNotNull(), lines).alias("n_lines"), "problem")


def limits(measures: dict[str, Column], most: dict[str, int] | None = None) -> Column:
    """The names of the limits that a document's ``measures`` pass, in the order of ``LIMITS``; a null measure passes none."""
    known = {**LIMITS, **(most or {})}
    unknown = sorted(set(measures) - set(known))
    if unknown:
        raise ValueError(f"no limits for {', '.join(unknown)}")
    return F.array_compact(F.array(*(F.when(measures[k] > n, k) for k, n in known.items() if k in measures)))


def image_measures(images: DataFrame) -> DataFrame:
    """images, image_pixels and image_bytes (of the largest), total_image_pixels and total_image_bytes of each document's ``images`` (doc_id, width, height, n_bytes)."""
    pixels = F.col("width").cast("long") * F.col("height")
    return images.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images"), F.max(pixels).alias("image_pixels"), F.sum(pixels).alias("total_image_pixels"), F.max("n_bytes").alias("image_bytes"), F.sum("n_bytes").alias("total_image_bytes"))
