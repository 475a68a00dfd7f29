"""Best-fit packing: documents into training sequences by the sum-of-squares rule.

Every document becomes its token ids and an end id; only documents longer than a sequence are cut. Pieces are dealt by
a hash of (document, piece, place in the table) into groups of bounded size, and each group is packed by itself: a piece goes where the
squared counts of open sequences per residual gap become smallest, the longest pieces first. A group leaves a few
sequences open, so the loss is a few in tens of thousands however many groups there are.

Defined results: null and empty texts are the end id alone; rows that repeat an id, or have none, are packed each by itself; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, bounded_batches, text_bytes, utf8

CAPACITY = 4096
#: Pieces that one packing task gets on average; more input means more groups, not larger ones.
GROUP_PIECES = 40_000
#: Words, and their lower-case cores, whose ids a worker keeps, in two generations. When the young one is full the old one is forgotten. A
#: worker that later runs another stage still holds them (some 200 bytes each).
CACHED_WORDS, CACHED_CORES = 300_000, 300_000
#: Words longer than this are encoded without being kept.
CACHED_BYTES = 48
#: Plain words: Latin letters that no normalisation joins or changes beyond lower case, and marks after them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?%&$*#|]{,4})")

_ENCODERS: dict[str, WordEncoder] = {}


class _Generation(dict):
    """Ids by word; what is missing is taken from the older generation or encoded."""

    def __init__(self, owner: WordEncoder) -> None:
        self.owner, self.older = owner, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word) or self.owner.word(word)
        if len(word) <= CACHED_BYTES:
            self[word] = ids
        return ids


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit words, for a tokenizer that never joins over white space.

    Words between ASCII white space are encoded once and kept. A plain word skips the general normaliser and goes to the
    vocabulary's merges directly, a run of letters and then a run of marks. Texts that could hold a special token's
    string go through the tokenizer whole, since such strings may span words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.specials = [x.content.encode() for x in t.get_added_tokens_decoder().values()]
        self.tokenise = t.model.tokenize
        letters = {c: chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
        self.letters = {c: "".join(p for p, _ in t.pre_tokenizer.pre_tokenize_str(x)) for c, x in letters.items()}
        self.cores: dict[str, bytes] = {}
        self.older_cores: dict[str, bytes] = {}
        self.seen_marks: dict[str, bytes] = {}
        self.direct = self._agrees()
        self.words = _Generation(self)

    def _agrees(self) -> bool:
        """Whether this tokenizer cuts and names plain words as the direct way does; else every word takes the general one."""
        tries = ["Thonnt,", "été", "ÉIÈRE.", "straße!!", "ABC%%%", "ñandú", "x", "won|"]
        try:
            return all(self._plain(PLAIN.fullmatch(w)) == self._general(w) for w in tries)
        except Exception:
            return False

    def _general(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, found: re.Match) -> bytes:
        core, marks = found.groups()
        core = core.lower()
        ids = self.cores.get(core) or self.older_cores.get(core)
        if ids is None:
            ids = self.cores[core] = array("I", [t.id for t in self.tokenise(core if core.isascii() else core.translate(self.letters))]).tobytes()
            if len(self.cores) > CACHED_CORES // 2:
                self.older_cores, self.cores = self.cores, {}
        return ids + (self.marks(marks) if marks else b"")

    def marks(self, marks: str) -> bytes:
        if marks not in self.seen_marks:
            self.seen_marks[marks] = self._general(marks)
        return self.seen_marks[marks]

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        return self._plain(found) if self.direct and (found := PLAIN.fullmatch(text)) else self._general(text)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get = self.words.__getitem__
        out = [self._general(t.decode()) if b"<|" in t and any(s in t for s in self.specials) else b"".join(map(get, t.split())) for t in texts]
        if len(self.words) > CACHED_WORDS // 2:
            fresh = _Generation(self)
            fresh.older, self.words.older = self.words, {}
            self.words = fresh
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder for ``path``, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length, by the sum-of-squares rule over the lengths in descending order.

    ``open_[g]`` counts the sequences with ``g`` free places. Putting a length s into a gap g changes the sum of squares
    by 2 * (open_[g - s] - open_[g] + 1), without the first term where the gap closes; a new sequence by
    2 * open_[capacity - s] + 1. Ties go to the smallest gap.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, never = 0, np.iinfo(np.int64).max
    for i in order.tolist():
        s = int(lengths[i])
        if s >= capacity:
            where[i], offset[i], made = made, 0, made + 1
            continue
        have = open_[s:capacity]
        change = np.where(have > 0, 2 * (open_[: capacity - s] - have + 1), never)
        if have[0]:
            change[0] = 1 - 2 * have[0]
        k = int(change.argmin())
        if change[k] <= 2 * open_[capacity - s] + 1:
            gap = s + k
            b = stacks[gap].pop()
            open_[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        where[i], offset[i] = b, capacity - gap
        if rest := gap - s:
            open_[rest] += 1
            stacks[rest].append(b)
    return where, offset


def tokenise(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and ids (bytes of 32-bit words)."""
    return _pieces(documents, tokenizer, end_id, capacity, True)


def _pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(utf8(b.column(1))), strict=True):
            ids += end
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, cut)


def groups_needed(documents: DataFrame, capacity: int = CAPACITY) -> int:
    """How many packing groups keep each near GROUP_PIECES: one piece a document and one for every sequence's worth of bytes."""
    n, size = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum(text_bytes(F.col("text"))), F.lit(0))).first()
    return max(1, -(-(n + size // capacity) // GROUP_PIECES))


def pack_pieces(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; a group is at most a hash share of all pieces."""
    bounded_batches(pieces.sparkSession)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", "pack_group")]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        where, offset = pack(table.column("length").to_numpy(), capacity)
        group = key[0].as_py()
        out = table.select(columns).append_column("sequence_id", pa.array(where + (group << 32))).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    dealt = pieces.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("long").alias("pack_group"))
    return dealt.groupBy("pack_group").applyInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(_pieces(documents, tokenizer, end_id, capacity, False), groups_needed(documents, capacity), capacity)
