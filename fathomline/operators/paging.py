"""Sorting and pagination: offset pages with totals, has-more probes, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One offset page with the total on every row; the total is one row from a count without the sort."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def has_more(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of ``limit`` rows and whether another follows, found by asking for one row more. Both are at most limit + 1 rows."""
    probe = rows.orderBy(*order).offset(offset).limit(limit + 1)
    more = probe.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    return probe.orderBy(*order).limit(limit).crossJoin(F.broadcast(more))  # one row


def after(columns: list[str], values: list) -> Column:
    """Keyset predicate: the row (columns) comes lexicographically after ``values``."""
    return F.struct(*columns) > F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, values, strict=True)))
