"""Report records: typed field validation, keyed patches, series blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items())))


def patch(current: DataFrame, changes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Keyed upserts and deletes (``removed``); kept rows keep their order and new keys follow in the changes' order."""
    both = current.select(key, F.col(order).alias("_o"), F.col(value).alias("_v")).join(changes.select(key, F.col(order).alias("_o2"), F.col(value).alias("_v2"), "removed"), key, "full_outer")
    kept = both.where(~F.coalesce("removed", F.lit(False)))
    return kept.select(key, F.coalesce("_v2", "_v").alias(value), F.col("_o").isNull().alias("appended"), F.coalesce("_o", "_o2").alias(order))
