"""Helpers that the corpus operators share: table access, the shared folder, and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.shared import shared_folder

#: Rows and bytes of one Arrow batch that a Python worker holds: long texts must not add up to gigabytes.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``function`` over every Arrow batch of ``df``; it may return None for an empty result."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with its column ``text`` (null: empty) replaced by ``squeezed``, its UTF-8 compressed: for texts that a shuffle moves."""
    others = [c for c in df.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map(squeeze, utf8(b.column(len(others)))), pa.binary())], [*others, "squeezed"])

    return arrow_map(df.select(*others, "text"), "".join(f"`{c}` {kinds[c]}, " for c in others) + "squeezed binary", rows)


def expanded(column: pa.Array) -> list[bytes]:
    """The texts of a ``squeezed`` column."""
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))
