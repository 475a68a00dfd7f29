"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_KEPT: dict[tuple[str, str], tuple[str, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder that the application has set.

    Only in local mode, where the one machine has both sides, a folder of its own stands in; it goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = spark._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        path = tempfile.mkdtemp(prefix="fathomline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[context.applicationId] = "file://" + path
        context.setCheckpointDir(_OWN[context.applicationId])
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes when a file under ``paths`` is added, deleted or written anew: names, lengths and times, listed and summed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    h = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    n, mixed, total = files.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return f"{n}-{mixed}-{total}"


def kept(spark: SparkSession, key: str, inputs: list[str], make) -> DataFrame:
    """The table that ``make`` gives, written once for each application, ``key`` and state of the files under ``inputs``.

    Where those files have changed, the table is made anew and the one before is deleted.
    """
    held, state = (spark.sparkContext.applicationId, key), fingerprint(spark, *inputs)
    if held not in _KEPT or _KEPT[held][0] != state:
        path = new_path(spark, "kept")
        make().write.option("compression", "zstd").parquet(path)
        if held in _KEPT:
            delete(spark, _KEPT[held][1])
        _KEPT[held] = state, path
    return spark.read.parquet(_KEPT[held][1])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(rows: DataFrame, name: str = "stored") -> DataFrame:
    """``rows`` written to a fresh table in the shared folder and read back: computed once, with a short lineage."""
    path = new_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
