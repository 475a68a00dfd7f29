"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows of equal text form an atomic group; groups are ordered by a 64-bit hash of the text. The smallest shard capacity for
which a greedy pass needs no more than the wanted number of shards is found by binary search, and the cuts keep every
shard within that capacity, as evenly as they can; a group larger than an even share has a shard of its own. The bounds
are hash values, so a row's shard follows from its own text.

The groups are never gathered: the search works on cells, ranges of the hash with their total size. Cells that a cut may
fall into are opened into finer cells until the cuts' cells hold one group each, so that what reaches the driver is a
fixed number of cells for each level and cut, and the capacity found is the exact minimum over the groups.

Defined results: a null text counts as empty, of size 16; all rows of equal text share a shard, however many they are;
an empty table gives no rows; rows that repeat an id, or have none, have a slot each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import materialise

ROW_BYTES = 16
#: Hash bits of the first level of cells, and of each later one.
FIRST_BITS, MORE_BITS = 16, 8
#: Rows that a slot bucket holds on average.
SLOT_ROWS = 20_000
#: Bits of the group hash. Texts whose hashes agree in all of them form one group.
HASH_BITS = 63


@dataclass
class Cells:
    """Consecutive hash ranges [low, next low): size, and groups in each."""

    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    def __len__(self) -> int:
        return len(self.low)


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cell indices that begin shards 2, 3, ... when every shard takes as many whole cells as fit; None if too many are needed."""
    cuts, start, at = [], 0, 0
    while True:
        nxt = int(np.searchsorted(ends, start + capacity, side="right"))
        if nxt >= len(ends):
            return cuts
        if nxt == at or len(cuts) + 1 >= shards:
            return None
        cuts.append(nxt)
        at, start = nxt, int(ends[nxt - 1])


def smallest_capacity(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity for whole cells, and its cuts."""
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(ends, low, shards)


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cell indices that begin shards 2, 3, ...: of all cuts that keep every shard within ``capacity``, those nearest to equal parts.

    A cut may lie no further than what the shards behind it still hold and no further than one capacity from the last cut.
    """
    total = int(ends[-1])
    edges = np.r_[0, ends]
    least, right = [0] * shards, total
    for k in range(shards - 1, 0, -1):
        right = int(edges[np.searchsorted(edges, max(0, right - capacity), side="left")])
        least[k] = right
    cuts, last = [], 0
    for k in range(1, shards):
        most = int(edges[np.searchsorted(edges, last + capacity, side="right") - 1])
        at = int(np.searchsorted(edges, total * k / shards))
        near = min((int(edges[j]) for j in (at - 1, at) if 0 <= j < len(edges)), key=lambda e: abs(e - total * k / shards))
        last = min(max(near, least[k], last), most)
        cuts.append(int(np.searchsorted(edges, last)))
    return cuts


def balanced_cuts(cells: Cells, capacity: int, shards: int) -> list[int]:
    """Cuts within the smallest capacity whose other shards are as even as can be.

    A group larger than an even share of what is left gets a shard of its own, the largest first; the stretches between
    such groups share the other shards by the same minimax search, and each is cut as evenly as its capacity allows.
    """
    rest, left = int(cells.size.sum()), shards
    alone = np.zeros(len(cells), bool)
    for c in np.argsort(-cells.size, kind="stable").tolist():
        if left <= 1 or cells.groups[c] > 1 or cells.size[c] * left <= rest:
            break
        alone[c], rest, left = True, rest - int(cells.size[c]), left - 1
    at = np.flatnonzero(alone).tolist()
    stretches = [(a, z) for a, z in zip([0, *(x + 1 for x in at)], [*at, len(cells)], strict=True) if a < z]

    def needs(limit: int) -> list[int] | None:
        found = [greedy(np.cumsum(cells.size[a:z]), limit, left) for a, z in stretches]
        counts = [len(f) + 1 for f in found if f is not None]
        return counts if len(counts) == len(found) and sum(counts) <= left else None

    if not at or not stretches or needs(capacity) is None:
        return even_cuts(np.cumsum(cells.size), capacity, shards)
    low, high = max(int(cells.size[a:z].max()) for a, z in stretches), capacity
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if needs(mid) is None else (low, mid)
    counts = needs(low)
    for _ in range(left - sum(counts)):
        wide = [int(cells.size[a:z].sum()) / n if n < z - a else 0.0 for (a, z), n in zip(stretches, counts, strict=True)]
        counts[int(np.argmax(wide))] += 1
    cuts = {x for c in at for x in (c, c + 1)}
    for (a, z), n in zip(stretches, counts, strict=True):
        cuts.update(a + c for c in even_cuts(np.cumsum(cells.size[a:z]), low, n))
    return sorted(c for c in cuts if 0 < c < len(cells))


def loosest(cells: Cells, capacity: int, shards: int) -> np.ndarray:
    """How far each cut can lie at most, in size from the start, if cells of several groups could be cut anywhere."""
    ends = np.cumsum(cells.size)
    begin = ends - cells.size
    at, out = 0, []
    for _ in range(shards - 1):
        at += capacity
        if at >= ends[-1]:
            break
        k = int(np.searchsorted(ends, at, side="right"))
        if cells.groups[k] == 1:
            at = int(begin[k])
        out.append(at)
    return np.asarray(out, np.int64)


def tightest(cells: Cells, capacity: int, shards: int) -> np.ndarray:
    """How far each cut lies at least: cells of several groups are left whole to the next shard, or taken if nothing else is."""
    ends = np.cumsum(cells.size)
    at, out = 0, []
    for _ in range(shards - 1):
        k = int(np.searchsorted(ends, at + capacity, side="right"))
        if k >= len(ends):
            break
        at = max(at, int(ends[k - 1]) if k else 0)
        out.append(at)
    return np.asarray(out, np.int64)


def bounds(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The exact minimax capacity and the first hashes of shards 2, 3, ..., of ``groups`` (h: hash, size)."""

    def level(cond, bits: int) -> Cells:
        cell = F.shiftright("h", HASH_BITS - bits)
        rows = groups.where(cond) if cond is not None else groups
        got = rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toArrow()
        low = got.column("cell").to_numpy().astype(np.int64) << (HASH_BITS - bits)
        order = np.argsort(low)
        return Cells(low[order], np.full(len(low), bits), got.column("size").to_numpy()[order].astype(np.int64), got.column("n").to_numpy()[order].astype(np.int64))

    cells = level(None, FIRST_BITS)
    if not len(cells):
        return 0, []
    while True:
        high, _ = smallest_capacity(cells.size, shards)
        largest = int(cells.size[cells.groups == 1].max(initial=0))
        low = max(largest, -(-int(cells.size.sum()) // shards))
        if high <= low:
            return high, [int(cells.low[c]) for c in balanced_cuts(cells, high, shards) if c < len(cells)]
        wide = (cells.groups > 1) & (cells.bits < HASH_BITS)
        ends = np.cumsum(cells.size)
        begin = ends - cells.size
        late, early = loosest(cells, high, shards), tightest(cells, low, shards)
        open_ = np.zeros(len(cells), bool)
        for k in range(shards - 1):
            a = int(early[k]) if k < len(early) else int(early[-1]) if len(early) else 0
            z = int(late[k]) if k < len(late) else int(ends[-1])
            open_ |= (ends > a) & (begin <= z)
        # cells over the lower bound come first: the largest group may be in them, and it raises that bound
        large = wide & (cells.size > low)
        open_ = large if large.any() else open_ & wide
        if not open_.any():
            return high, [int(cells.low[c]) for c in balanced_cuts(cells, high, shards) if c < len(cells)]
        bits = int(cells.bits[open_].min())
        chosen = open_ & (cells.bits == bits)
        finer = min(HASH_BITS, bits + MORE_BITS)
        wanted = (cells.low[chosen] >> (HASH_BITS - bits)).tolist()
        cond = F.shiftright("h", HASH_BITS - bits).isin(wanted) if len(wanted) <= 400 else _ranges(cells, chosen, bits)
        new = level(cond, finer)
        keep = ~chosen
        low_all = np.concatenate([cells.low[keep], new.low])
        order = np.argsort(low_all, kind="stable")
        cells = Cells(low_all[order], *(np.concatenate([getattr(cells, f)[keep], getattr(new, f)])[order] for f in ("bits", "size", "groups")))


def _ranges(cells: Cells, chosen: np.ndarray, bits: int):
    """A condition of few hash ranges for many chosen cells: cells are looked up in runs of neighbours."""
    width = 1 << (HASH_BITS - bits)
    low = cells.low[chosen]
    breaks = np.flatnonzero(np.diff(low) != width)
    starts, stops = low[np.r_[0, breaks + 1]], low[np.r_[breaks, len(low) - 1]] + (width - 1)
    return F.expr("(" + " or ".join(f"h between {a} and {z}" for a, z in zip(starts.tolist(), stops.tolist(), strict=True)) + ")")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and h (the group's hash) of every row; the text itself goes no further."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("h"),
    )


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless in the shard), grown_shard (null under this law) and h.

    Slots count through buckets of rows inside each shard: running sums of the bucket counts give the first slot of each bucket
    and a window the place in it, so that no task holds more than a bucket, whatever ids repeat or lack.
    """
    rows = materialise(keyed(documents)).withColumn("row", F.monotonically_increasing_id())  # fixed, as the checkpoint is
    _, cuts = bounds(rows.groupBy("h").agg(F.sum("size").alias("size")), shards)
    shard = sum(((F.col("h") >= F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int") if cuts else F.lit(0)
    dealt = rows.withColumn("shard", shard)
    n = rows.count()
    buckets = max(1, -(-n // (SLOT_ROWS * shards)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h", "row")) - 1
    return dealt.withColumn("place", place).join(begin, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "h")
