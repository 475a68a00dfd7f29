"""Exact token counts and token-bounded texts as column functions; the vocabulary is a parameter."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.bpe import BytePairs, read_ranks


class Vocabulary:
    """Merge ranks, read once on the driver (their size is checked) and sent to each executor once as a broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as lines:
            self._sent, self._pattern = spark.sparkContext.broadcast(read_ranks(lines)), pattern

    def encoder(self) -> Callable[[], BytePairs]:
        """What workers call for their encoder; a worker makes one."""
        sent, pattern = self._sent, self._pattern

        class Once:
            pairs: BytePairs | None = None

        def get() -> BytePairs:
            if Once.pairs is None:
                Once.pairs = BytePairs(sent.value, pattern)
            return Once.pairs

        return get

    def count(self, text: Column, strip: bool = False) -> Column:
        """Tokens of a text, or of what is left without white space around it; 0 for null."""
        encoder = self.encoder()

        @F.pandas_udf("int")
        def counted(texts: pd.Series) -> pd.Series:
            if strip:
                texts = texts.str.strip()
            return texts.map(encoder().count).astype("int32")

        return counted(text)

    def first(self, text: Column, most: int) -> Column:
        """Struct of ``kept`` (the first tokens, whole characters) and ``removed`` (tokens left out)."""
        encoder = self.encoder()

        @F.pandas_udf("kept string, removed int")
        def cut(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([encoder().first(t or "", most) for t in texts], columns=["kept", "removed"])

        return cut(text)

    def with_neighbours(self, before: Column, body: Column, after: Column, side: int = 64, most: int | None = None) -> Column:
        """Struct of ``content``, ``before_tokens`` and ``after_tokens``: a body with the end of the chunk before and the
        beginning of the one after, ``side`` tokens each at most.

        The body is never cut: neighbours share what it leaves of ``most``, the one before at most half, and give way
        token by token while the whole, with its separators, is too long; the longer one first, then the one after.
        """
        encoder = self.encoder()

        def build(pairs: BytePairs, b: str, text: str, a: str, left: int, right: int) -> tuple[str, int, int]:
            head, tail = pairs.last(b, left), pairs.first(a.strip(), right)[0].rstrip() if right > 0 else ""
            return "\n\n".join(x for x in (head, text, tail) if x).strip(), pairs.count(head), pairs.count(tail)

        def one(b: str | None, text: str | None, a: str | None) -> tuple[str, int, int]:
            pairs, b, text, a = encoder(), b or "", text or "", a or ""
            left, right = side if b else 0, side if a else 0
            if most is not None:
                room = most - pairs.count(text, keep=True)
                if room <= 0:
                    return text, 0, 0
                if b and a:
                    left = min(left, room // 2)
                    right = min(right, room - left)
                left, right = min(left, room), min(right, room)
            out = build(pairs, b, text, a, left, right)
            while most is not None and (left or right) and len(out[0].encode()) > most and pairs.count(out[0]) > most:  # a token has a byte at least
                if right and right >= left:
                    right -= 1
                else:
                    left -= 1
                out = build(pairs, b, text, a, left, right)
            return out

        @F.pandas_udf("content string, before_tokens int, after_tokens int")
        def framed(bs: pd.Series, texts: pd.Series, as_: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(*r) for r in zip(bs, texts, as_, strict=True)], columns=["content", "before_tokens", "after_tokens"])

        return framed(before, body, after)

    def whole_lines(self, text: Column, most: int) -> Column:
        """The whole lines at the beginning of a text that have at most ``most`` tokens together; its first tokens where the first line has more."""
        encoder = self.encoder()

        def cut(t: str | None) -> str:
            pairs, t = encoder(), t or ""
            if pairs.count(t) <= most:
                return t
            lines = t.splitlines(keepends=True)
            low, high = 0, len(lines)  # halving: a longer beginning hardly ever has fewer tokens
            while low < high:
                mid = (low + high + 1) // 2
                if pairs.count("".join(lines[:mid]).strip()) <= most:
                    low = mid
                else:
                    high = mid - 1
            return "".join(lines[:low]) if low else pairs.first(t, most)[0]

        @F.pandas_udf("string")
        def kept(texts: pd.Series) -> pd.Series:
            return texts.map(cut)

        return kept(text)
