"""Joins that spread a hot key over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt into.
SALTS = 64


def attach(rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key.

    Rows of a key are dealt by a hash of ``by`` too. The table's row first meets the key's parts that exist, at most
    ``salts`` of them and combined before the shuffle, and then each part by itself, so that no task gets a whole hot key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(11)), F.lit(salts)).cast("int"))
    parts = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(parts, [*keys, "_salt"], how).drop("_salt")
