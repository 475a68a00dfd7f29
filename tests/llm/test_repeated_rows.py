"""Rows that repeat an id and its text: work and results grow with their number, not with its square."""

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from fathomline.llm import secret_ledger, suffix_dedup


def test_ranges_of_equal_rows_are_linear(spark):
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(960))
    seen = {}
    for ids in ("7", "cast(null as long)"):
        for n in (100, 400):
            docs = spark.range(n).select(F.expr(ids).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(9, "alone " * 20)], "doc_id long, text string"))
            seen[n] = suffix_dedup.repeated_ranges(docs).count()
            got = {tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.length("kept")).collect()}
            assert got == {(7 if ids == "7" else None, 960, 960, 1, 0), (9, 120, 0, 0, 120)}
        assert seen[400] <= 4.5 * seen[100]


def test_a_blob_is_scanned_once(spark):
    squeeze = zstandard.ZstdCompressor().compress
    scan = secret_ledger._scanner()
    one, two = "aa" * 32, "bb" * 32
    batch = pa.RecordBatch.from_arrays([pa.array([one] * 300 + [two]), pa.array([squeeze(b"password=hunter2hunter")] * 300 + [squeeze(b"x")], pa.binary())], ["blob", "squeezed"])
    assert scan(batch).column(0).to_pylist() == [one, two] and scan(batch) is None
    docs = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("password=hunter2hunter").alias("text"))
    found, new = secret_ledger.scan(docs)
    assert new.count() == 1 and found.count() == 300 and {r.n_assign for r in found.collect()} == {1}
