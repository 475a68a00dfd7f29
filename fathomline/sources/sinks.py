"""Sinks: Parquet by logical table, latest-wins upserts, batches bounded by rows and bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.scan import in_order
from fathomline.sources.shared import new_path


def write_tables(rows: DataFrame, path: str, keys: list[str]) -> None:
    """One directory for each logical table, compressed by zstd; rows of a table are brought together first."""
    rows.repartition(*keys).write.mode("overwrite").option("compression", "zstd").partitionBy(*keys).parquet(path)


def roundtrip(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` written by ``write_tables`` and read back with their own schema."""
    path = new_path(rows.sparkSession, "tables")
    write_tables(rows, path, keys)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(rows.columns)


def latest(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Latest-wins upsert: the row with the highest sequence of each key."""
    last = Window.partitionBy(*key).orderBy(F.desc(sequence))
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """``existing`` with ``changes`` applied; a change wins over a stored row of the same sequence or an older one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc(sequence), F.desc("_new"))
    return both.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place", "_new")


def batches(rows: DataFrame, group: str, order: str, size: str, most_rows: int = 500, most_bytes: int = 5 << 20) -> DataFrame:
    """``rows`` (group, order, size) with ``batch``: a new batch begins where the next row would pass either bound.

    The running total restarts at data-dependent places, so each group is walked in order, row by row: a task holds one running total.
    """

    def start() -> Callable[[dict | None], list[tuple]]:
        batch, n, total = 0, 0, 0

        def step(row: dict | None) -> list[tuple]:
            nonlocal batch, n, total
            if row is None:
                return []
            if n and (n >= most_rows or total + row[size] > most_bytes):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + row[size]
            return [(row[group], row[order], row[size], batch)]

        return step

    slim = rows.select(group, order, size)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return in_order(slim, group, [order], f"{fields}, batch int", start)
