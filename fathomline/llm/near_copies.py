"""Near copies: SimHash near-dedup of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The four-bit radius of 64-bit fingerprints only finds texts that are nearly equal: at a similarity of 0.8 the expected distance is
ten bits, and what is sure to hold all such pairs lets nearly everything through. So fingerprints here are wide, SKETCH_BITS bits
over the same shingle hashes, and a radius of five standard deviations around the distance expected at 0.8 misses a link
with a chance of 3e-7 while unrelated texts lie thirty deviations away. Tiles meet by exclusive-or and bit counts, as in
``simhash_dedup``, and skip each other where their population counts differ beyond the radius. No choice of blocks holds
all pairs within such a radius, so that tiles meet inside buckets of min-hashes: 32 bands of 4, which a pair at 0.8 misses
with a chance below 1e-7. Every link is then decided exactly, on the texts.

Links are looked for in three rounds, each leaving less to the next, since all pairs of a large group of copies must not be
compared one by one. Equal sets are one node. First a node meets the smallest node of the bucket it shares most often with.
Then the tiles of buckets that still hold several components give likely links, of which each bucket sends on a spanning forest,
the nearest pairs first. Last come all pairs within the radius whose components still differ.

Defined results: null, empty and blank texts have the empty set and are copies of each other; a text with fewer words
than a shingle has one shingle, all of its words; rows without an id stay, however many are equal; a row is known by its id and
text, so that two texts of one id are two rows and a repeated row stays once; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, bounded_batches, expanded, materialise, squeezed, utf8
from fathomline.llm.components import connected_components
from fathomline.llm.simhash_dedup import bit_counts, shingle_hashes
from fathomline.operators.skew import attach
from fathomline.sources.shared import stored

SHINGLE, BANDS, ROWS = 5, 32, 4
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Width of the fingerprints in 64-bit words; expected distance at the least similarity, for sets of equal size, and its deviation.
WORDS = 64
SKETCH_BITS = 64 * WORDS
_SHARE = float(np.arccos(2 * SIMILAR[0] / (SIMILAR[0] + SIMILAR[1])) / np.pi)
EXPECTED, DEVIATION = SKETCH_BITS * _SHARE, (SKETCH_BITS * _SHARE * (1 - _SHARE)) ** 0.5
#: Distance up to which a link is likely, and up to which one is possible.
LIKELY, RADIUS = int(EXPECTED + DEVIATION), int(EXPECTED + 5 * DEVIATION)
#: Rows of a tile, and rows beyond which a bucket is dealt as pairs of parts.
TILE, LARGE_BUCKET = 128, 2048
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.random.default_rng(8).integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.random.default_rng(9).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9FB21C651E98DF25)


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct shingle hashes of ``text``, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number a band (int64) from the least of ``hashes`` under each of the functions."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[a : a + 2048] * _FACTORS).min(axis=1), out=least)
    return ((least ^ least >> np.uint64(29)).reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The wide SimHash of a shingle set: each bit is 1 if over half of the hashes, mixed anew for each word, set it."""
    counts = np.zeros(SKETCH_BITS, np.int64)
    for a in range(0, len(hashes), 4096):
        h = hashes[a : a + 4096, None] * _SPREAD
        h = (h ^ h >> np.uint64(32)) * _MIX
        counts += bit_counts(h ^ h >> np.uint64(29))
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and text of the rows with an id."""
    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, th, node (hash of the shingle set) and bands of every row with an id."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(map(shingle_set, utf8(b.column(2))))
        nodes = np.asarray([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "th", "node", "bands"])

    return arrow_map(_keyed(documents), "doc_id long, th long, node long, bands array<long>", rows)


def texts_of(documents: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """node and squeezed (text) of the ``asked`` nodes; ``nodes`` gives the row (doc_id, th) of each."""
    rows = asked.select("node").distinct().join(nodes.select("node", "doc_id", "th"), "node")
    return squeezed(_keyed(documents)).join(rows, ["doc_id", "th"]).dropDuplicates(["node"]).select("node", "squeezed")


def verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) whose texts are similar."""
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    texts = stored(texts_of(documents, nodes, asked), "texts")
    sides = attach(pairs.join(texts.toDF("u", "a"), "u"), texts.toDF("v", "b"), ["v"], "u").select("u", "v", "a", "b")  # heads are hot

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        held = lru_cache(256)(shingle_set)
        stay = [similar(held(x), held(y)) for x, y in zip(expanded(b.column(2)), expanded(b.column(3)), strict=True)]
        return b.select(["u", "v"]).filter(pa.array(stay, pa.bool_()))

    return materialise(arrow_map(sides, "u long, v long", rows))


def near_pairs(sketches: np.ndarray, roots: np.ndarray, first: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers x, y and distance of all pairs of different roots within ``radius`` bits; of rows of both sides where ``first``
    (which side a row is of) tells two. Tiles of rows sorted by population count meet unless their counts lie too far apart."""
    counts = np.bitwise_count(sketches).sum(axis=1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    s, c, r, f = sketches[order], counts[order], roots[order], first[order]
    crossed = f.any() and not f.all()
    out = []
    for i in range(0, len(s), TILE):
        for j in range(i, len(s), TILE):
            if c[j] - c[min(i + TILE, len(s)) - 1] > radius:
                break
            apart = r[i : i + TILE, None] != r[None, j : j + TILE]
            if crossed:
                apart &= f[i : i + TILE, None] != f[None, j : j + TILE]
            if i == j:
                apart = np.triu(apart, 1)
            if not apart.any():
                continue
            distance = np.bitwise_count(s[i : i + TILE, None] ^ s[None, j : j + TILE]).sum(axis=2, dtype=np.int64)
            x, y = np.nonzero(apart & (distance <= radius))
            out.append((order[x + i], order[y + j], distance[x, y]))
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (empty, empty, empty)


def forest(x: np.ndarray, y: np.ndarray, distance: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which of the pairs join the components of ``roots``, the nearest pairs first: at most one less than there are components."""
    _, root = np.unique(roots, return_inverse=True)
    parent = np.arange(root.max(initial=-1) + 1)
    todo, taken = np.argsort(distance, kind="stable"), []
    while len(todo):
        for k in todo[:1000].tolist():
            a, b = root[x[k]], root[y[k]]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                taken.append(k)
        while not (parent[parent] == parent).all():
            parent = parent[parent]
        todo = todo[1000:]
        todo = todo[parent[root[x[todo]]] != parent[root[y[todo]]]]
    return np.asarray(taken, np.int64)


def tiled_pairs(rows: DataFrame, wide: DataFrame, likely: bool) -> DataFrame:
    """Distinct u and v (u > v) of ``rows`` (band, h, node, root): a spanning forest of the likely links of each bucket, or every
    possible link, once, from the first band that its nodes share. Buckets are dealt first, so that ``wide`` (node, sketch; bands too
    unless ``likely``) moves to its buckets once."""
    spark = rows.sparkSession
    bounded_batches(spark)
    sizes = rows.groupBy("band", "h").agg(F.ceil(F.count(F.lit(1)) / LARGE_BUCKET).cast("int").alias("parts"))
    dealt = attach(rows, sizes, ["band", "h"], "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", "h", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") == F.least("part", "other")).alias("first"), "node", "root").join(wide, "node")
    key = ["band", "h", "low", "high"]

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        if t.num_rows < 2:
            return None
        node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(len(node), WORDS)
        x, y, distance = near_pairs(sketches, root, t.column("first").to_numpy(zero_copy_only=False), LIKELY if likely else RADIUS)
        if likely:
            use = forest(x, y, distance, root)
        else:
            each = np.asarray(t.column("bands").to_pylist(), np.int64)
            use = np.concatenate([np.flatnonzero((each[x[a : a + 65536]] == each[y[a : a + 65536]]).argmax(axis=1) == t.column("band")[0].as_py()) + a for a in range(0, len(x), 65536)] or [np.empty(0, np.int64)])
        if not len(use):
            return None
        u, v = node[x[use]], node[y[use]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in key]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for a, z in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                this = tuple(k[a].item() for k in keys)
                if held and this != last:
                    if (out := links(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, z - a))
                last = this
        if held and (out := links(held)) is not None:
            yield out

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(meet, "u long, v long").distinct()


def sketches(documents: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """node and sketch of the ``asked`` nodes."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(shingle_set(t)) for t in expanded(b.column(1))], pa.binary())], ["node", "sketch"])

    return arrow_map(texts_of(documents, nodes, asked), "node long, sketch binary", rows)


def near_copies(documents: DataFrame) -> DataFrame:
    """node, doc_id and th (the first row that holds it) and root (the component) of every distinct shingle set."""
    first = signatures(documents).groupBy("node").agg(F.min(F.struct("doc_id", "th", "bands")).alias("r"))
    nodes = stored(first.select("node", "r.doc_id", "r.th", "r.bands"), "nodes")
    every = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    shared = every.groupBy("band", "h").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = stored(attach(every, shared.drop("n"), ["band", "h"], "node"), "shared")
    heads = rows.where("node != head").groupBy("node", "head").count()
    pairs = stored(heads.groupBy("node").agg(F.max(F.struct("count", "head")).alias("m")).select(F.col("node").alias("u"), F.col("m.head").alias("v")), "pairs")
    links = verified(documents, nodes, pairs)
    roots = materialise(connected_components(links))
    left, wide = _apart(rows.drop("head"), roots), None
    for likely in (True, False):
        if left.isEmpty():
            break
        if wide is None:
            wide = stored(sketches(documents, nodes, left), "sketches")
        found = stored(tiled_pairs(left, wide if likely else wide.join(nodes.select("node", "bands"), "node"), likely).join(pairs, ["u", "v"], "left_anti"), "pairs")
        links = links.unionByName(verified(documents, nodes, found))
        roots = materialise(connected_components(links))
        if likely:
            pairs, left = pairs.unionByName(found), _apart(left.drop("root"), roots)
    return nodes.drop("bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (node, band, h) with their root, of the buckets that hold several components."""
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("band", "h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "h")
    return stored(attach(placed, several, ["band", "h"], "node"), "apart")


def keep_one(documents: DataFrame) -> DataFrame:
    """The first row of each group of near copies, the one with the smallest id, once where it is repeated."""
    least = near_copies(documents).groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    stay = least.select(F.col("r.doc_id").alias("stay_id"), F.col("r.th").alias("stay_th"))
    columns = documents.columns
    marked = documents.withColumn("own_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(stay, (F.col("doc_id").cast("long") == F.col("stay_id")) & (F.col("own_th") == F.col("stay_th"))).dropDuplicates(["stay_id", "stay_th"]).select(*columns)
    return kept.unionByName(documents.where("doc_id is null"))
