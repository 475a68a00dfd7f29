"""Byte-pair encoding by merge ranks: exact counts, and cuts on token edges that keep characters whole."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

#: Bytes of a vocabulary at most: it travels to every worker.
MOST_BYTES = 16 << 20
#: Distinct words whose tokens, and whose counts, a worker remembers.
CACHED = 200_000
#: Texts whose words are remembered: chunks are asked for as neighbours and as bodies, one after the other.
RECENT = 4
#: Bytes of a word up to which its pairs are looked through for the lowest rank; longer words have a queue.
SHORT = 40


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    ranks, held = {}, 0
    for line in lines:
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
            held += len(token)
            if held > MOST_BYTES:
                raise ValueError(f"the vocabulary has more than {MOST_BYTES} bytes")
    return ranks


class _Counts(dict):
    """Tokens of words, counted when they are first asked for."""

    def __init__(self, merged: Callable[[bytes], list[bytes]]):
        self.merged = merged

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = n = len(self.merged(word.encode()))
        return n


class BytePairs:
    """An encoder: ``pattern`` cuts a text into words, whose bytes are merged pair by pair, the lowest rank first, leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.words = ranks, regex.compile(pattern)
        self.held: dict[str, list[bytes]] = {}
        self.counts = _Counts(self.merged)
        self.recent: dict[str, list[str]] = {}

    def split(self, text: str, keep: bool = False) -> list[str]:
        """The words of a text; with ``keep`` they are remembered for a while."""
        if (found := self.recent.get(text)) is not None:
            return found
        found = [m[0] for m in self.words.finditer(text)] if self.words.groups else self.words.findall(text)
        if keep:
            while len(self.recent) >= RECENT:
                del self.recent[next(iter(self.recent))]
            self.recent[text] = found
        return found

    def _merged_short(self, word: bytes) -> list[bytes]:
        rank, none = self.ranks.get, float("inf")
        parts = [word[k : k + 1] for k in range(len(word))]
        found = [rank(word[k : k + 2], none) for k in range(len(word) - 1)]
        while found and (least := min(found)) != none:
            k = found.index(least)
            parts[k] += parts.pop(k + 1)
            del found[k]
            if k < len(found):
                found[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                found[k - 1] = rank(parts[k - 1] + parts[k], none)
        return parts

    def merged(self, word: bytes) -> list[bytes]:
        """The tokens of one word: a queue of ranked pairs over a linked list of parts, so that long words stay near-linear."""
        if word in self.ranks:
            return [word]
        n = len(word)
        if n <= SHORT:
            return self._merged_short(word)
        ends = list(range(1, n + 1))  # of the part that begins at each place; 0 where none does any more
        before = list(range(-1, n - 1))
        ranks = self.ranks
        queue = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
        heapify(queue)
        while queue:
            _, a, z = heappop(queue)
            middle = ends[a]
            if not middle or middle >= n or ends[middle] != z:
                continue  # one of its parts has been merged since
            ends[a], ends[middle] = z, 0
            if z < n:
                before[z] = a
                if (r := ranks.get(word[a : ends[z]])) is not None:
                    heappush(queue, (r, a, ends[z]))
            if (b := before[a]) >= 0 and (r := ranks.get(word[b:z])) is not None:
                heappush(queue, (r, b, z))
        out, at = [], 0
        while at < n:
            out.append(word[at : ends[at]])
            at = ends[at]
        return out

    def encode(self, text: str) -> list[bytes]:
        """The tokens of ``text`` as bytes; joined they are its UTF-8."""
        out: list[bytes] = []
        for word in self.split(text):
            out += self.tokens(word)
        return out

    def tokens(self, word: str) -> list[bytes]:
        found = self.held.get(word)
        if found is None:
            if len(self.held) >= CACHED:
                self.held.clear()
            found = self.held[word] = self.merged(word.encode())
        return found

    def count(self, text: str | None, keep: bool = False) -> int:
        return sum(map(self.counts.__getitem__, self.split(text, keep))) if text else 0

    def first(self, text: str, most: int) -> tuple[str, int]:
        """The longest beginning of at most ``most`` tokens that ends with a whole character, and how many tokens it leaves out."""
        every = self.count(text, keep=True)
        if every <= most:
            return text, 0
        tokens: list[bytes] = []
        for word in self.split(text):
            if len(tokens) >= most:
                break
            tokens += self.tokens(word)
        data = b"".join(tokens[: max(most, 0)])
        while most > 0:
            try:
                return data.decode(), every - most
            except UnicodeDecodeError:  # the edge is inside a character: one token less
                most -= 1
                data = data[: len(data) - len(tokens[most])]
        return "", every

    def last(self, text: str, most: int) -> str:
        """The longest end of ``text``, without white space in front, that has at most ``most`` tokens when read by itself."""
        text = text.strip()
        if most <= 0 or not text:
            return ""
        if self.count(text, keep=True) <= most:
            return text
        tokens: list[bytes] = []  # from the end on
        for word in reversed(self.split(text)):
            if len(tokens) >= most:
                break
            tokens += reversed(self.tokens(word))
        tokens = tokens[:most][::-1]
        # an end of `most` tokens of the whole is where to look; read by itself it may split otherwise
        at = max(0, len(text) - len(b"".join(tokens).decode(errors="ignore")) - 8)
        while at < len(text) and self.count(text[at:].lstrip()) > most:
            at += 1
        return text[at:].lstrip()
