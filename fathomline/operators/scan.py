"""Operators whose state depends on what came before: rows of a key, in order, through a small step function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def in_order(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Callable[[dict | None], list[tuple]]]) -> DataFrame:
    """Rows that a step gives for ``rows``, key by key and in order.

    Rows are dealt by ``key`` and sorted inside their partitions, so that a task streams through them and holds one
    key's state only. ``start`` makes the step of a new key; it is called with each row and, when the key ends, with None.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, out, begun = None, None, [], False
        kinds = run.kinds
        for b in batches:
            for row in b.to_pylist():
                if not begun or row[key] != at:
                    if begun:
                        out += step(None)
                    at, step, begun = row[key], start(), True
                out += step(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if begun and (out := step(None)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    run.kinds = [f.type for f in to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)]
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
