"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def mean(rows: DataFrame, key: str, vector: str, places: int) -> DataFrame:
    """Element-wise mean of each group's vectors, by position."""
    each = rows.select(key, F.posexplode(vector).alias("i", "v")).groupBy(key, "i").agg((F.round(F.avg(F.col("v").cast("double")), places) + 0.0).alias("v"))
    return each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p")).select(key, F.col("p.v").alias("mean"))  # one entry a dimension
