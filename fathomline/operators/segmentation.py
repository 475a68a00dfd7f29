"""Segmentation as column functions, with dictionaries that Spark counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.segmentation import Lexicon, Paths

#: Words of a dictionary, and their characters in all, at most: it travels to every worker.
MOST_WORDS, MOST_CHARS = 500_000, 8_000_000


def word_counts(words: DataFrame, most: int, least: int = 1) -> DataFrame:
    """The ``most`` frequent values of ``words`` (column word) with ``n`` of at least ``least``, ties by word."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


class Segmenter:
    """A dictionary (word, n), collected after its size is checked and sent to each executor once as a broadcast."""

    def __init__(self, dictionary: DataFrame):
        held = dictionary.select("word", "n").persist()  # counted once, for its size and its rows
        size = held.agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("chars")).first()
        if size.words > MOST_WORDS or (size.chars or 0) > MOST_CHARS:
            held.unpersist()
            raise ValueError(f"a dictionary of {size.words} words and {size.chars} characters is too large")
        self._context = dictionary.sparkSession.sparkContext
        self._sent = self._context.broadcast([(r.word, r.n) for r in held.toLocalIterator()])
        self._paths = None
        held.unpersist()

    def lexicon(self) -> Callable[[], Lexicon]:
        """What workers call for the dictionary; a worker builds it once."""
        sent = self._sent

        class Once:
            held: Lexicon | None = None

        def get() -> Lexicon:
            if Once.held is None:
                Once.held = Lexicon(sent.value)
            return Once.held

        return get

    def _lists(self, text: Column, what: str) -> Column:
        lexicon = self.lexicon()

        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(getattr(lexicon(), what))

        return cut(text)

    def coarse(self, text: Column) -> Column:
        return self._lists(text, "coarse")

    def terms(self, text: Column) -> Column:
        """Coarse and fine terms: can stand for ``recall.words`` in an index and its queries."""
        return self._lists(text, "terms")

    def path(self, run: Column) -> Column:
        """The words of a text taken as one run, whatever its script."""
        return self.recut(F.array(F.coalesce(run, F.lit(""))))["words"]

    def recut(self, words: Column) -> Column:
        """An array of words joined to one run and cut again: ``words``, and ``n_found``, how many of the old words' ends are ends of new ones."""
        if self._paths is None:
            self._paths = self._context.broadcast(Paths(self._sent.value))
        sent = self._paths

        @F.arrow_udf("words array<string>, n_found int")
        def cut(lists: pa.Array) -> pa.Array:
            return recut_lists(sent.value, lists)

        return cut(words)


def recut_lists(paths: Paths, lists: pa.Array) -> pa.Array:
    """``recut`` of an Arrow array; the new words share the old ones' bytes."""
    lists = lists.cast(pa.large_list(pa.large_string()))
    rows = np.append(0, np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy()))
    old = lists.flatten().fill_null("")
    at = np.frombuffer(old.buffers()[1], np.int64, len(old) + 1, old.offset * 8) if len(old) else np.zeros(1, np.int64)
    data = np.frombuffer(old.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    bounds = at[rows]  # where rows begin and end
    ends = paths.ends(data, bounds[1:])
    was = np.zeros(len(data) + 1, bool)
    was[at] = True
    both = np.append(0, np.cumsum(was[ends]))
    upto = np.searchsorted(ends, bounds, "right")
    words = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words), pa.array(np.diff(both[upto]), pa.int32())], ["words", "n_found"])
