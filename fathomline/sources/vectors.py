"""A store of dense and sparse vectors: keyed upserts of versions, partitioned by dataset, merged now and then.

A point is a chunk's vector of one kind. Upserts and deletions are batches of rows that are added; the newest version of a
point wins, a replayed batch changes nothing, and a kind is never touched by writes of the other. ``compact`` merges the
batches into a new base. Readers take the newest whole base and the batches that it doesn't have, so that a writer that
is lost in between leaves the store as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "chunk_id string, doc_id long, dataset_id int, kind string, version long, deleted boolean, embedding array<float>, indices array<int>, weights array<float>, payload string"


class VectorStore:
    """The store under ``path``, of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        """Whole folders under ``folder``: those whose write has ended."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _add(self, rows: DataFrame) -> None:
        rows.write.partitionBy("dataset_id").option("compression", "zstd").parquet(f"{self.path}/batches/{uuid.uuid4().hex}")

    def upsert_dense(self, points: DataFrame) -> None:
        """Rows chunk_id, doc_id, dataset_id, version, embedding and maybe payload; a vector that is empty or not finite is an error."""
        wrong = F.coalesce(F.size("embedding") == 0, F.lit(True)) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        checked = F.when(wrong, F.raise_error(F.concat(F.lit("no finite vector: "), "chunk_id"))).otherwise(F.col("embedding").cast("array<float>"))
        self._add(self._rows(points.withColumn("embedding", checked), "dense"))

    def upsert_sparse(self, points: DataFrame, least: float = 0.0, most: int = 256) -> None:
        """Rows chunk_id, doc_id, dataset_id, version, indices and weights: kept are finite positive weights of at least ``least``,
        the largest of a repeated index, the ``most`` heaviest, by index."""
        pairs = F.filter(F.arrays_zip("indices", "weights"), lambda p: ~F.isnan(p["weights"]) & (p["weights"] < float("inf")) & (p["weights"] > 0) & (p["weights"] >= least))
        heavy = F.array_sort(F.transform(pairs, lambda p: F.struct((-p["weights"]).alias("w"), p["indices"].alias("i"))))
        once = F.aggregate(heavy, F.array().cast("array<struct<w:double,i:int>>"), lambda a, x: F.when(F.exists(a, lambda y: y["i"] == x["i"]) | (F.size(a) >= most), a).otherwise(F.concat(a, F.array(F.struct(x["w"].cast("double").alias("w"), x["i"].cast("int").alias("i"))))))
        ordered = points.withColumn("_p", F.array_sort(F.transform(once, lambda x: F.struct(x["i"].alias("i"), (-x["w"]).alias("w")))))
        self._add(self._rows(ordered.withColumns({"indices": F.col("_p.i"), "weights": F.col("_p.w").cast("array<float>")}), "sparse"))

    def delete(self, points: DataFrame, kind: str) -> None:
        """Rows chunk_id, doc_id, dataset_id and version: from this version on there is no such point."""
        self._add(self._rows(points, kind, deleted=True))

    def _rows(self, points: DataFrame, kind: str, deleted: bool = False) -> DataFrame:
        made = {"kind": F.lit(kind), "deleted": F.lit(deleted)}
        fields = [f.strip().split(" ", 1) for f in POINT.split(", ")]
        return points.select(*((made[n] if n in made else F.col(n) if n in points.columns else F.lit(None)).cast(k).alias(n) for n, k in fields))

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], POINT)
        return self.spark.read.schema(POINT).option("basePath", paths[0]).parquet(paths[0]) if len(paths) == 1 else self._read(paths[:1]).unionByName(self._read(paths[1:]))

    def _state(self) -> tuple[str | None, list[str]]:
        """The newest whole base, and the batches that it doesn't have."""
        base = max((n for n in self._names("merged")), default=None)
        done = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/merged/{base}").toLocalIterator()} if base else set()
        return base, [b for b in self._names("batches") if b not in done]

    def _latest(self) -> DataFrame:
        """The newest row of every point; of equal versions the one with the greater hash, so that replays and their order don't matter."""
        base, batches = self._state()
        rows = self._read(([f"{self.path}/bases/{base}"] if base else []) + [f"{self.path}/batches/{b}" for b in batches])
        order = F.struct("version", F.xxhash64("deleted", "embedding", "indices", "weights", "payload").alias("h"))
        others = [c.split()[0] for c in POINT.split(", ") if c.split()[0] not in ("chunk_id", "kind")]
        return rows.groupBy("chunk_id", "kind").agg(F.max_by(F.struct(*others), order).alias("p")).select("chunk_id", "kind", *(F.col(f"p.{c}").alias(c) for c in others))

    def points(self, kind: str) -> DataFrame:
        """chunk_id, doc_id, dataset_id, version, payload and the vector (embedding, or indices and weights) of every point of ``kind``."""
        columns = ["embedding"] if kind == "dense" else ["indices", "weights"]
        return self._latest().where((F.col("kind") == kind) & ~F.col("deleted")).select("chunk_id", "doc_id", "dataset_id", "version", "payload", *columns)

    def compact(self) -> None:
        """Merge all batches into a new base. It counts only when both its parts are whole; what it replaces is deleted by the compaction after."""
        base, batches = self._state()
        old = self._names("merged")
        name = f"{int(base or 0) + 1:012d}"
        self._latest().write.partitionBy("dataset_id").option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/bases/{name}")
        before = [(r.batch,) for r in self.spark.read.schema("batch string").parquet(f"{self.path}/merged/{base}").collect()] if base else []
        held = set(self._names("batches"))
        merged = [(b,) for b in batches] + [b for b in before if b[0] in held]
        self.spark.createDataFrame(merged, "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/merged/{name}")
        self._drop([f"merged/{n}" for n in old[:-1]] + [f"bases/{n}" for n in old[:-1]] + [f"batches/{b}" for (b,) in before if b in held and len(old) > 0])

    def _drop(self, names: list[str]) -> None:
        from fathomline.sources.shared import delete

        for n in names:
            delete(self.spark, f"{self.path}/{n}")
