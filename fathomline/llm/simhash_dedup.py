"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Fingerprints of 64 bits are compared exactly. The bits are cut into blocks; two fingerprints that differ in at most
RADIUS bits agree in all but RADIUS blocks, so a bucket for every choice of the other blocks holds every linked pair
together at least once. Inside a bucket, fingerprints sorted by population count form tiles, and tiles meet by numpy
exclusive-or and bit counts unless their population counts differ by more than the radius. Large buckets are dealt to
many tasks as pairs of tiles, again without those whose counts are too far apart. A tile sends on a spanning
set of its links, not all pairs.

Equal fingerprints are compared once. The number of blocks follows the number of fingerprints, so that buckets stay
small; every choice of blocks finds the same links.

Defined results: a null, empty or blank text has the fingerprint zero and is linked like any other; a text with fewer
words than a shingle has one shingle, all of its words; repeated rows of an id share its row's values; a row without an id
is linked like any other and names no component (one of such rows alone has a null one); an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, bounded_batches, materialise, utf8
from fathomline.llm.components import connected_components
from fathomline.operators.skew import attach

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints that a bucket should hold on average at most, rows of a tile, and rows beyond which a bucket is dealt as tile pairs.
BUCKET_ROWS, TILE, LARGE_BUCKET = 512, 512, 8192


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of ``hashes`` (one or more words each) set each of the bits, lowest first: carry-save adders first thin out the
    rows by eight."""
    total = np.zeros(64 * int(np.prod(hashes.shape[1:])), np.int64)
    weight = 1
    while len(hashes) >= 24:
        n = len(hashes) // 3
        a, b, c = hashes[:n], hashes[n : 2 * n], hashes[2 * n : 3 * n]
        x = a ^ b
        rest = np.concatenate([x ^ c, hashes[3 * n :]])
        total += weight * _plain_counts(rest) if len(rest) < 24 else weight * bit_counts(rest)
        hashes, weight = (a & b) | (x & c), weight * 2
    return total + weight * _plain_counts(hashes)


def _plain_counts(hashes: np.ndarray) -> np.ndarray:
    width = int(np.prod(hashes.shape[1:]))
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8 * width), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle (of ``shingle`` words) of ``text``, A-Z lower-cased, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.asarray([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return np.fromiter([digest(line[a:z], SEED) for a, z in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def fingerprint(text: bytes) -> int:
    """The SimHash as a signed 64-bit integer."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    bits = 2 * bit_counts(h) > len(h)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp of every row."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in utf8(b.column(1))], pa.int64())], ["doc_id", "fp"])

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long", rows)


def block_masks(n: int, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Bit masks (signed) that n fingerprints are bucketed by: every choice of all but ``radius`` of some number of blocks.

    The fewest blocks whose buckets hold ``bucket_rows`` of n evenly spread fingerprints, up to radius + 4.
    """
    for blocks in range(radius + 1, radius + 5):
        edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
        parts = [((1 << z) - 1) ^ ((1 << a) - 1) for a, z in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(parts, blocks - radius)]
        if n / 2 ** min(m.bit_count() for m in masks) <= bucket_rows:
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """Sets of row numbers, joined in whole arrays; the least row of a set is its root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def root(self, a: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[a]
            if (up == a).all():
                return a
            a = up

    def links(self) -> np.ndarray:
        """Root of every row."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def tiled_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root row) that join all of ``fps`` (uint64) within ``radius`` of each other, directly or through others here.

    Rows are sorted by population count and cut into tiles; a tile meets itself and the later ones up to the first whose
    smallest count lies over the radius above its own largest.
    """
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    s, c = fps[order], counts[order].astype(np.int64)
    forest = Forest(len(s))
    starts = range(0, len(s), tile)
    for i in starts:
        a = s[i : i + tile]
        for j in starts:
            if j < i:
                continue
            if c[j] - c[min(i + tile, len(s)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ s[None, j : j + tile]) <= radius
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                forest.join(x + i, y + j)
    root = forest.links()
    linked = np.flatnonzero(root != np.arange(len(s)))
    return order[linked], order[root[linked]]


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """u and v: links that connect all fingerprints of ``distinct`` (fp) within ``radius`` bits of each other."""
    bounded_batches(distinct.sparkSession)
    masks = block_masks(n, radius)
    bucket = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, m in enumerate(masks))))
    rows = distinct.select("fp", bucket.alias("b")).select("fp", "b.t", "b.block")
    large = rows.groupBy("t", "block").count().where(F.col("count") > LARGE_BUCKET)
    large = materialise(large.select(F.col("t").alias("lt"), F.col("block").alias("lblock"), F.ceil(F.col("count") / F.lit(LARGE_BUCKET)).cast("int").alias("deals")))
    n_large = large.count()
    key = ["t", "block"]
    small = rows
    if n_large:
        match = (F.col("t") == F.col("lt")) & (F.col("block") == F.col("lblock"))
        small = rows.join(large, match, "left_anti")
    small = small.withColumn("pair", F.lit(0).cast("long"))
    dealt = small
    if n_large:
        # tile of a row: population count and a hash part; it goes to each pair of tiles whose counts are near enough
        pop, part = F.bit_count("fp").cast("int"), F.pmod(F.xxhash64("fp", F.lit(3)), F.col("deals")).cast("int")
        own = rows.join(large, match).select("fp", "t", "block", "deals", pop.alias("pop"), part.alias("part"))
        others = F.explode(F.sequence(F.greatest(F.col("pop") - radius, F.lit(0)), F.least(F.col("pop") + radius, F.lit(64))))
        own = own.withColumn("pop2", others).withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
        a, b = F.col("pop") * 1000003 + F.col("part"), F.col("pop2") * 1000003 + F.col("part2")
        dealt = small.unionByName(own.select("fp", "t", "block", (F.least(a, b).cast("long") * F.lit(1 << 31) + F.greatest(a, b) + 1).alias("pair")))
    key = [*key, "pair"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def links_of(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(parts) if len(parts) > 1 else parts[0]
            if len(fps) > 1:
                u, v = tiled_links(fps.view(np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[u]), pa.array(fps[v])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fps, *keys = (batch.column(k).to_numpy() for k in range(4))
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            starts, stops = [0, *change.tolist()], [*change.tolist(), len(fps)]
            for a, z in zip(starts, stops, strict=True):
                this = tuple(k[a].item() for k in keys)
                if last is not None and this != last:
                    yield from links_of(held)
                    held = []
                held.append(fps[a:z])
                last = this
        if held:
            yield from links_of(held)

    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("fp", *key).repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(meet, "u long, v long")


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row."""
    rows = materialise(fingerprints(documents))
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = connected_components(links(distinct.select("fp"), distinct.count(), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = attach(rooted, least, ["root"], "fp").select("fp", "component_id")
    return attach(rows, named, ["fp"], "doc_id").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def keep_one(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``documents`` whose id is its component's: one of each group, once where its row is repeated.

    Rows without an id stay, since nothing tells them apart.
    """
    found = near_duplicates(documents, radius)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("stay_id")).distinct()
    columns = documents.columns
    kept = documents.join(stay, F.col("doc_id").cast("long") == F.col("stay_id")).dropDuplicates(["stay_id"]).select(*columns)
    return kept.unionByName(documents.where("doc_id is null"))
