"""Suffix-array dedup: bytes covered by a string of WINDOW bytes that also starts anywhere else are removed.

The work is in four steps, all of them over whole texts.

1. *Anchors.* Every window of WINDOW bytes has one anchor, the least hash among its GRAM-byte strings (the leftmost among
   equals), so equal windows have equal anchors at equal places. Consecutive windows with the same anchor form a run,
   and the bytes they cover are the run's context. A row per run carries the anchor's hash and the context's, two hashes of 64 bits
   by different functions.
2. *Contexts.* Rows whose anchor stands nowhere else go first: nothing can repeat there. Rows of one anchor and context are
   counted, combined before the shuffle, and stand for one context, once or repeatedly there, which is fetched from one of its texts.
3. *Suffix arrays.* Contexts are sorted anchor by anchor, one that occurs repeatedly standing there twice. Relative to the anchor they
   are strings of BLOCK-byte symbols; the suffix array of a chunk of whole anchor groups, by linear grouping
   (``suffix_array``), brings equal runs of symbols together, and the up to BLOCK bytes on either side are compared exactly. It
   gives the ranges of single contexts and confirms the repeated ones, whose ranges then hold wherever they occur.
4. *Removal.* The covered byte ranges of each text are united and cut out.

An anchor with more than LARGE_GROUP different contexts isn't given to one task: its contexts are exploded into their windows'
hashes (again two of them), which are counted like contexts, and give the same result.

``suffix_array`` builds the order in two phases without renaming symbols recursively. First suffixes are grouped by
their longest Lyndon prefix: groups are processed in descending order, each suffix finds the nearest suffix before it in
a smaller group (previous-smaller pointer), and those found move to a new group behind their own. Then the groups are
emitted in order: a suffix that is placed places the suffixes before it whose next smaller suffix it is, each at the
front of its group.

Defined results: a null text is empty; texts shorter than a window lose nothing; repeated rows, and rows of equal text without an
id, count as occurrences of each other; an id may hold several texts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, bounded_batches, discard, materialise, utf8
from fathomline.sources.shared import new_path, stored

WINDOW, GRAM, BLOCK = 200, 32, 16
#: Different contexts of an anchor beyond which its windows are counted by hash instead of sorted in one task.
LARGE_GROUP = 20_000
#: An anchor is hot if it has more than one in HOT_SHARE of all runs.
HOT_SHARE = 1000
#: Symbols of a chunk of whole groups that one suffix array takes; a larger group is a chunk by itself.
CHUNK_SYMBOLS = 150_000
#: Window starts of a long text that one pass looks at; passes meet without a gap.
PASS_STARTS = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACE_BITS = 20
_POWERS: list[np.ndarray] = []


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of ``symbols`` (integers of at least 1), by Lyndon grouping; linear but for sorting members of a group."""
    text = np.asarray([*symbols, 0])
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[first, n])
    group_np = np.empty(n, np.int64)
    group_np[order] = np.repeat(first, sizes)
    group = group_np.tolist()  # start of each suffix's group
    slots, place_np = order.tolist(), np.empty(n, np.int64)
    place_np[order] = np.arange(n)
    place = place_np.tolist()
    size = np.zeros(n, np.int64)
    size[first] = sizes
    size = size.tolist()
    smaller = [-1] * n
    end = n
    while end > 1:
        start = group[slots[end - 1]]
        if end - start == 1:
            s = slots[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:  # p alone moves behind its group
                    last = g + k - 1
                    q, at = slots[last], place[p]
                    slots[at], place[q] = q, at
                    slots[last], place[p] = p, last
                    group[p], size[last], size[g] = last, 1, k - 1
            end = start
            continue
        found: dict[int, int] = {}
        for s in sorted(slots[start:end]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        # those with more pointers first, so that they end up behind those with fewer
        sets: dict[tuple[int, int], list[int]] = {}
        for p, count in found.items():
            sets.setdefault((count, group[p]), []).append(p)
        for (_, g), members in sorted(sets.items(), key=lambda x: -x[0][0]) if len(sets) > 1 else sets.items():
            k = size[g]
            behind = g + k - len(members)
            if behind == g:
                continue
            last = g + k - 1
            for p in members:
                q, at = slots[last], place[p]
                slots[at], place[q] = q, at
                slots[last], place[p] = p, last
                group[p] = behind
                last -= 1
            size[g], size[behind] = k - len(members), len(members)
        end = start
    out = [0] * n
    front = list(range(n))
    out[0] = n - 1
    for i in range(n):
        x = out[i]
        j, stop = x - 1, smaller[x]
        while j != stop and j >= 0:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            j = smaller[j]
    return out[1:]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, at least n."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of a text, from one running sum: equal strings have equal hashes wherever they stand."""

    def __init__(self, text: bytes) -> None:
        self.up, down = _powers(len(text) + 1)
        values = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(values * down[: len(text)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.up[starts])

    def all(self, first: int, last: int, length: int) -> np.ndarray:
        """Hashes of the strings of ``length`` that start at first .. last - 1."""
        return _mixed((self.sums[first + length : last + length] - self.sums[first:last]) * self.up[first:last])


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, anchor place, first and last window start of every run of ``text``."""
    n = len(text) - WINDOW + 1
    hashes = Hashes(text)
    parts = []
    wide = WINDOW - GRAM + 1
    for begin in range(0, n, PASS_STARTS):
        stop = min(n, begin + PASS_STARTS)
        grams = hashes.all(begin, stop + wide - 1, GRAM)
        least = (grams & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: stop - begin], least[wide - span :][: stop - begin])
        anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.r_[0, change], np.r_[change, len(anchor)] - 1
        place = anchor[first]
        parts.append((grams[place], place + begin, first + begin, last + begin))
    gram, place, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    shape = _mixed(((place - first) * 1024 + (place - last) + 1).astype(np.uint64))
    digest = xxhash.xxh3_64_intdigest
    context = np.fromiter([digest(text[a:z]) for a, z in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)], np.uint64, len(first))
    return gram, context ^ shape, place, first, last


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal ranges that [start, end) ranges cover; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[new[1:], True]]


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (place << 16) | ((place - first) << 8) | (place - last)


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = packed >> 16
    return place, place - (packed >> 8 & 255), place - (packed & 255)


RUN_SCHEMA = "doc long, th long, gram long, context long, packed long"


def text_runs(keyed: DataFrame) -> DataFrame:
    """A row for every run of (doc, th, text)."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for k, t in enumerate(utf8(b.column(2))):
            if len(t) >= WINDOW:
                gram, context, place, first, last = runs(t)
                parts.append((np.full(len(gram), k), gram.view(np.int64), context.view(np.int64), _packed(place, first, last)))
        if not parts:
            return None
        at, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in (0, 1)), *map(pa.array, columns)], ["doc", "th", "gram", "context", "packed"])

    return arrow_map(keyed, RUN_SCHEMA, rows)


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def _squeezed(documents: DataFrame) -> DataFrame:
    """doc_id, doc, th and the text compressed, as texts move through shuffles."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(map(squeeze, utf8(b.column(3))), pa.binary())], ["doc_id", "doc", "th", "squeezed"])

    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return arrow_map(keyed, "doc_id long, doc long, th long, squeezed binary", rows)


def _fetch(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contexts of ``wanted`` (doc, th, gram, context, n, packed, large) with their bytes, from a row that holds the text: a task
    takes one of equal rows, so that contexts don't come as often as a row is repeated."""
    asked = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("gram", "context", "n", "packed", "large")).alias("asked"))  # at most a text's runs
    found = _squeezed(documents).drop("doc_id").join(asked, ["doc", "th"])

    seen: set[tuple[int, int]] = set()  # of one task: each unpickles it empty

    def rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        expand = zstandard.ZstdDecompressor().decompress
        out: list[tuple] = []
        fresh = []
        for k, key in enumerate(zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                fresh.append(k)
        if not fresh:
            return None
        b = b.take(pa.array(fresh))
        for doc, th, squeezed, asked in zip(*(b.column(c).to_pylist() for c in ("doc", "th", "squeezed", "asked")), strict=True):
            text = expand(squeezed)
            for a in asked:
                place = a["packed"] >> 16
                out.append((a["gram"], a["context"], a["n"], doc, th, a["packed"], a["large"], text[place - (a["packed"] >> 8 & 255) : place - (a["packed"] & 255) + WINDOW]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["gram", "context", "n", "doc", "th", "packed", "large", "bytes"])

    return arrow_map(found.select("doc", "th", "squeezed", "asked"), "gram long, context long, n int, doc long, th long, packed long, large boolean, bytes binary", rows)


def repeated_windows(contexts: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window start in it) of every window that also occurs in another place of the contexts.

    ``before[c]`` is the anchor's place in context c. Blocks are counted from the anchor, so equal windows of a group have
    equal blocks. Only runs of blocks that occur twice or more and are long enough enter the suffix array.
    """
    depth = (WINDOW - BLOCK) // BLOCK  # whole blocks in every window
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(contexts), np.uint8)
    shift = before % BLOCK
    blocks = (lengths - shift) // BLOCK
    c_of = np.repeat(np.arange(len(contexts)), blocks)
    number = np.arange(len(c_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = base[c_of] + shift[c_of] + number * BLOCK
    wide = np.ascontiguousarray(data[at[:, None] + np.arange(BLOCK)]).view(np.uint64)
    _, name, count = np.unique(_pairs(wide), return_inverse=True, return_counts=True)
    live = count[name] > 1
    # maximal runs of live blocks inside a context
    edge = np.r_[True, (c_of[1:] != c_of[:-1]) | (live[1:] != live[:-1])] if len(c_of) else np.empty(0, bool)
    run = np.cumsum(edge) - 1
    run_size = np.bincount(run) if len(run) else np.empty(0, np.int64)
    use = live & (run_size[run] >= depth) if len(run) else live
    chosen = np.flatnonzero(use)
    empty = np.empty(0, np.int64)
    if not len(chosen):
        return empty, empty
    # the symbols with one separator behind every run; a suffix counts if ``depth`` blocks of its run are left
    breaks = np.flatnonzero(np.diff(run[chosen])) + 1
    symbols = np.insert(name[chosen] + 2, breaks, 1)
    source = np.insert(chosen, breaks, -1)
    order = np.asarray(suffix_array(symbols.tolist()))
    padded = np.concatenate([symbols, np.zeros(depth, symbols.dtype)])
    left = order[np.flatnonzero(source[order] >= 0)]
    run_end = np.cumsum(run_size)  # first block after each run
    left = left[run_end[run[source[left]]] - source[left] >= depth]
    if len(left) < 2:
        return empty, empty
    same = np.ones(len(left) - 1, bool)
    for k in range(depth):
        same &= padded[left[1:] + k] == padded[left[:-1] + k]
    interval = np.r_[0, np.cumsum(~same)]
    lone = np.bincount(interval)[interval] < 2
    left, interval = left[~lone], interval[~lone]
    block = source[left]
    c, start = c_of[block], at[block] - base[c_of[block]]
    got_c, got_s = [], []
    rest = WINDOW - depth * BLOCK
    for t in range(BLOCK):  # windows that start t bytes before a block: t bytes there and the others behind the blocks
        ok = (start >= t) & (start - t + WINDOW <= lengths[c])
        if not ok.any():
            continue
        o = base[c[ok]] + start[ok]
        tails = np.concatenate([data[(o[:, None] - t) + np.arange(t)], data[(o[:, None] + depth * BLOCK) + np.arange(rest - t)]], axis=1)
        words = np.zeros((len(o), -(-rest // 8) * 8), np.uint8)
        words[:, :rest] = tails
        keys = _pairs(np.column_stack([interval[ok].astype(np.uint64), words.view(np.uint64)]))
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        twice = n[back] > 1
        got_c.append(c[ok][twice])
        got_s.append(start[ok][twice] - t)
    return (np.concatenate(got_c), np.concatenate(got_s)) if got_c else (empty, empty)


def _pairs(words: np.ndarray) -> np.ndarray:
    """One exact key for each row of 64-bit words: the rows themselves as byte strings, or their rank where hashes suffice.

    Rows are told apart by a 64-bit hash first; rows of equal hash are compared, and different ones named apart.
    """
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h = _mixed(h * np.uint64(0x100000001B3) + words[:, k] + np.uint64(k + 1))
    order = np.argsort(h, kind="stable")
    same_hash = h[order][1:] == h[order][:-1]
    if (same_hash & (words[order][1:] != words[order][:-1]).any(axis=1)).any():
        return np.unique(words, axis=0, return_inverse=True)[1].reshape(-1)
    return h


def sorted_groups(contexts: DataFrame) -> DataFrame:
    """doc, th, a, z: byte ranges of contexts with n = 1 that windows repeated in their anchor's group cover; and gram and context of
    those with n = 2, which stand in the group twice, whose windows are all found again there."""
    bounded_batches(contexts.sparkSession)

    def ranges(held: list[tuple]) -> pa.RecordBatch | None:
        held = [x for h in held for x in ([h, h] if h[2] > 1 else [h])]
        place, first, last = _unpacked(np.asarray([h[5] for h in held], np.int64))
        c, s = repeated_windows([h[6] for h in held], place - first)
        if not len(c):
            return None
        # ranges of one context become one where they touch; contexts lie far apart on one line
        far = 1 << 20
        a, z = united(c * far + s, c * far + s + WINDOW)
        c = a // far
        again = np.asarray([h[2] > 1 for h in held])[c]
        second = np.asarray([k > 0 and held[k] is held[k - 1] for k in range(len(held))])[c]
        whole = again & (z - a == (last - first)[c] + WINDOW)
        use = np.flatnonzero(~again | whole & ~second)
        c, a, z, whole = c[use], a[use], z[use], whole[use]
        shift = first[c] - c * far
        numbers = [np.asarray([h[k] for h in held], np.int64)[c] for k in (3, 4, 0, 1)]
        columns = [pa.array(v, mask=m) for v, m in zip([numbers[0], numbers[1], a + shift, z + shift, numbers[2], numbers[3]], [whole] * 4 + [~whole] * 2, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "th", "a", "z", "gram", "context"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols, last = 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != last and symbols >= CHUNK_SYMBOLS:
                    if (out := ranges(held)) is not None:
                        yield out
                    held, symbols = [], 0
                held.append(row)
                symbols += row[2] * len(row[6]) // BLOCK
                last = row[0]
        if held and (out := ranges(held)) is not None:
            yield out

    parts = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = contexts.where("not large").select("gram", "context", "n", "doc", "th", "packed", "bytes").repartition(parts, "gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(meet, "doc long, th long, a long, z long, gram long, context long")


def counted_windows(contexts: DataFrame) -> DataFrame:
    """As ``sorted_groups``, for anchors with many contexts: their windows are counted by hash, combined before the shuffle."""

    def explode(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for n, doc, th, packed, text in zip(*(b.column(c).to_pylist() for c in ("n", "doc", "th", "packed", "bytes")), strict=True):
            h = Hashes(text).all(0, len(text) - WINDOW + 1, WINDOW).view(np.int64)
            x = np.fromiter([xxhash.xxh3_64_intdigest(text[k : k + WINDOW]) for k in range(len(h))], np.uint64, len(h)).view(np.int64)
            first = (packed >> 16) - (packed >> 8 & 255)
            out.append((h, x, np.full(len(h), min(n, 2)), np.full(len(h), doc), np.full(len(h), th), first + np.arange(len(h))))
        h, x, n, doc, th, start = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(n.astype(np.int32)), pa.array(doc), pa.array(th), pa.array(start)], ["h", "x", "n", "doc", "th", "a"])

    windows = arrow_map(contexts.where("large").select("n", "doc", "th", "packed", "bytes"), "h long, x long, n int, doc long, th long, a long", explode)
    twice = windows.groupBy("h", "x").agg(F.sum("n").alias("total")).where("total > 1").select("h", "x")
    return windows.where("n = 1").join(twice, ["h", "x"]).select("doc", "th", "a", (F.col("a") + WINDOW).alias("z"))


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """doc, th, a, z: byte ranges (they may overlap) that cover every repeated window of every text."""
    spark = documents.sparkSession
    table = new_path(spark, "runs")
    text_runs(_keyed(documents)).write.parquet(table)
    every = spark.read.schema(RUN_SCHEMA).parquet(table)
    found = stored(_live(every), "live")
    discard(spark, table)  # most anchors stand once, and nothing reads them again
    kinds = found.groupBy("gram", "context").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n"), *(F.first(c).alias(c) for c in ("doc", "th", "packed")))
    kinds = materialise(kinds.transform(_with_group).withColumn("large", F.col("contexts") > LARGE_GROUP).drop("contexts"))
    fetched = stored(_fetch(documents, kinds), "contexts")
    grouped = stored(sorted_groups(fetched), "ranges")
    confirmed = grouped.where("gram is not null").select("gram", "context").distinct().unionByName(kinds.where("large and n > 1").select("gram", "context"))  # each once
    whole = found.join(confirmed, ["gram", "context"])
    place = F.shiftright("packed", 16)
    full = whole.select("doc", "th", (place - F.shiftright("packed", 8).bitwiseAND(255)).alias("a"), (place - F.col("packed").bitwiseAND(255) + WINDOW).alias("z"))
    return full.unionByName(grouped.where("doc is not null").select("doc", "th", "a", "z")).unionByName(counted_windows(fetched))


def _live(every: DataFrame) -> DataFrame:
    """The runs whose anchor has several. A hot anchor has more than one run in HOT_SHARE, so that HOT_SHARE of them are the most
    there can be; its runs need no join by anchor, which would bring them into one task."""
    counts = materialise(every.groupBy("gram").count().where("count > 1"))
    hot = F.broadcast(counts.where(F.col("count") * HOT_SHARE > every.count()).select("gram"))
    return every.join(hot, "gram", "leftsemi").unionByName(every.join(hot, "gram", "leftanti").join(counts, "gram", "leftsemi"))


def _with_group(kinds: DataFrame) -> DataFrame:
    """``kinds`` with the number of different contexts of their anchor, ``contexts``."""
    return kinds.join(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")), "gram")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row: its text without the bytes that repeated windows cover."""
    ranges = repeated_ranges(documents)
    cut = ranges.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "z")).alias("ranges"))  # a text's own, however often its row is repeated
    held = _squeezed(documents).join(cut, ["doc", "th"], "left")

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        expand = zstandard.ZstdDecompressor().decompress
        lists = b.column(2)
        flat, offsets, valid = lists.flatten(), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
        a_all, z_all = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        out = []
        for k, squeezed in enumerate(b.column(1).to_pylist()):
            text = expand(squeezed)
            removed, spans, kept = 0, 0, text
            if valid[k] and offsets[k + 1] > offsets[k]:
                a, z = united(a_all[offsets[k] : offsets[k + 1]], z_all[offsets[k] : offsets[k + 1]])
                removed, spans = int((z - a).sum()), len(a)
                kept = b"".join(text[p:q] for p, q in zip([0, *z.tolist()], [*a.tolist(), len(text)], strict=True))
            out.append((len(text), removed, spans, kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow_map(held.select("doc_id", "squeezed", "ranges"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", rows)
