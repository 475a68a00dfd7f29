"""Fill-in-middle transformation over run-length encoded character classes.

A text's units are its runs of ASCII letters and every other character by itself. No list of units is made: the text is
stored as maximal runs of one class (letters or the rest) with cumulative unit counts, a run of letters being one unit
and any other run as many as it has characters. A cut after u units lies in the run that a binary search over the
counts finds, and its offset is that run's start plus the units left, by arithmetic. All texts of an Arrow batch share
one array of runs, so that both cuts of every text come from one search.

``transform`` gives the output texts, ``restore`` rebuilds each exact text from its output and form alone, by JVM
expressions. Rows are independent of one another: one map pass, no shuffle, and a lost task is simply run again.

Defined results: a null or empty text has no units, is plain and its output is the empty text; a null id counts as an
empty decimal number; a text that holds one of the marks is plain; repeated rows repeat in the result with equal values
(equal texts under different ids are cut differently, since cuts come from the id); columns other than doc_id and text
are ignored, whatever their names; an empty table gives an empty result. Texts are never cut short.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"
#: Of a hundred: texts cut, and of the cut ones those written suffix first.
CUT, SUFFIX_FIRST = 90, 20
PLACES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the id's hash as numbers."""
    digest = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


class Runs:
    """Maximal runs of one character class in a row of texts; runs end where a text ends."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        folded = points | 0x20
        letter = (folded >= ord("a")) & (folded <= ord("z"))
        opens = np.ones(len(points), bool)
        opens[1:] = letter[1:] != letter[:-1]
        opens[self.base[:-1][sizes > 0]] = True
        self.start = np.flatnonzero(opens)  # code points before each run
        self.letters = letter[self.start]
        length = np.diff(np.append(self.start, len(points)))
        self.cumulative = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, length))])  # units before each run
        self.first = np.searchsorted(self.start, self.base)  # each text's first run
        self.units = np.diff(self.cumulative[self.first])

    def offsets(self, cuts: np.ndarray) -> np.ndarray:
        """Code points of each text before its first ``cuts`` units."""
        wanted = self.cumulative[self.first[:-1]] + cuts
        run = np.searchsorted(self.cumulative, wanted, side="right") - 1  # the run that unit number `wanted` is in
        inside = np.minimum(run, len(self.start) - 1)
        at = self.start[inside] + (wanted - self.cumulative[inside]) if len(self.start) else np.zeros(len(cuts), np.int64)
        return np.where(cuts == self.units, self.base[1:], at) - self.base[:-1]


def _cut(texts: list[str], ids: list[int | None]) -> list[tuple]:
    runs = Runs(texts)
    drawn = [draws(i) for i in ids]
    ends = np.array([sorted((h[0] % (n + 1), h[1] % (n + 1))) for h, n in zip(drawn, runs.units.tolist(), strict=True)], np.int64).reshape(-1, 2)
    first, second = runs.offsets(ends[:, 0]).tolist(), runs.offsets(ends[:, 1]).tolist()
    rows = []
    for i, t, n, h, a, b in zip(ids, texts, runs.units.tolist(), drawn, first, second, strict=True):
        if not t or h[2] % 100 >= CUT or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)):
            rows.append((i, n, "plain", None, None, t))
        elif h[3] % 100 < SUFFIX_FIRST:
            rows.append((i, n, "spm", a, b - a, f"{SUFFIX}{t[b:]}{PREFIX}{t[:a]}{MIDDLE}{t[a:b]}"))
        else:
            rows.append((i, n, "psm", a, b - a, f"{PREFIX}{t[:a]}{SUFFIX}{t[b:]}{MIDDLE}{t[a:b]}"))
    return rows


def transform(documents: DataFrame) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output."""
    names = [c.split()[0] for c in PLACES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        found = _cut([t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), PLACES, rows)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Texts that hold a mark are plain, so that each mark's first place is the mark."""
    size = F.lit(len(PREFIX))
    middle = F.locate(MIDDLE, output)
    second = F.locate(SUFFIX, output)
    psm = F.concat(F.substring(output, size + 1, second - size - 1), F.substring(output, middle + size, F.length(output)), F.substring(output, second + size, middle - second - size))
    prefix = F.locate(PREFIX, output)
    spm = F.concat(F.substring(output, prefix + size, middle - prefix - size), F.substring(output, middle + size, F.length(output)), F.substring(output, size + 1, prefix - size - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """``made`` (of ``transform``) with hashes of its outputs and of the texts rebuilt from them, in place of the outputs."""
    again = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))
