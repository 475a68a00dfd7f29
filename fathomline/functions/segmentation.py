"""Words of texts without spaces: the most probable path through the dictionary words that fit, and finer cuts inside long ones."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd

#: Runs of scripts that are written without spaces, and runs of other letters and digits.
_RUNS = re.compile(r"([⺀-⿟々-〇぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0003fffd]+)|[^\W_]+")
#: Characters of a word that fine cuts look into, at least.
FINE = 3


#: A log probability in billionths times this, less one for each word, orders paths by probability and then by fewest words.
_STEP = 1 << 20


def _log(p: float) -> int:
    return round(math.log(p) * 1e9)


def _weight(p: float) -> int:
    return _log(p) * _STEP - 1


class Lexicon:
    """Dictionary words with their log probabilities, in a trie of characters.

    A character that begins no word is one by itself, at half the weight of a word seen once.
    """

    def __init__(self, counts: Iterable[tuple[str, int]]):
        held = dict(counts)
        total = sum(held.values()) + 1
        self.unknown = _weight(0.5 / total)
        self.trie: dict = {}
        for word, n in held.items():
            at = self.trie
            for c in word:
                at = at.setdefault(c, {})
            at[""] = _weight(n / total)

    def path(self, text: str, without: str | None = None, known_only: bool = False) -> list[str] | None:
        """The most probable words that ``text`` consists of; among equals the fewest, then those with the longest words first.

        ``without``: a word that is not used. ``known_only``: None where dictionary words alone don't cover the text.
        """
        n, trie, unknown = len(text), self.trie, self.unknown
        best: list[int | None] = [None] * n + [0]  # of the text from here on
        first = [0] * n  # the end of its first word
        for k in range(n - 1, -1, -1):
            top, end = None, 0
            if not known_only and "" not in trie.get(text[k], ()) and best[k + 1] is not None:
                top, end = best[k + 1] + unknown, k + 1
            at, z = trie, k
            while z < n:
                at = at.get(text[z])
                if at is None:
                    break
                z += 1
                if "" in at and (rest := best[z]) is not None and (without is None or text[k:z] != without):
                    found = at[""] + rest
                    if top is None or found >= top:
                        top, end = found, z
            best[k], first[k] = top, end
        if best[0] is None:
            return None
        out, k = [], 0
        while k < n:
            out.append(text[k : first[k]])
            k = first[k]
        return out

    def fine(self, word: str) -> list[str]:
        """Shorter dictionary words that make up ``word``; itself where they don't, or where it has fewer than FINE characters."""
        parts = self.path(word, without=word, known_only=True) if len(word) >= FINE else None
        return parts or [word]

    def coarse(self, text: str | None) -> list[str]:
        """Lower-case words: runs of letters and digits as they are, runs of scripts without spaces by their most probable path."""
        out: list[str] = []
        for m in _RUNS.finditer((text or "").lower()):
            out += self.path(m[0]) if m[1] else [m[0]]
        return out

    def terms(self, text: str | None) -> list[str]:
        """What an index holds: the coarse words, each followed by its finer ones."""
        out: list[str] = []
        for word in self.coarse(text):
            out.append(word)
            if _RUNS.fullmatch(word) and _RUNS.fullmatch(word)[1] and len(parts := self.fine(word)) > 1:
                out += parts
        return out


#: Between runs; no UTF-8 text holds this byte.
_APART = 255
#: Bytes that are looked at together; more only while words cross every place of a run.
BLOCK = 1 << 17
#: Bytes from the end of a stretch within which a sum of logs, the words and the first word's bytes (8 bits each) fit into 64 bits.
_SAFE = 192
#: Stretches that are stepped through together, at least; fewer are gone through one by one.
_NARROW = 16


class Paths:
    """The paths of ``Lexicon.path`` for many runs at once, over arrays of UTF-8 bytes.

    No word crosses the ends of a stretch, so that its best path hangs on nothing outside it: stretches are stepped through side by
    side, from their ends on.
    """

    def __init__(self, counts: Iterable[tuple[str, int]]):
        held = dict(counts)
        total = sum(held.values()) + 1
        words = [w.encode() for w in held if w]
        logs = np.array([_log(n / total) for w, n in held.items() if w], np.int64)
        self.unknown = _log(0.5 / total)
        size = np.array([len(w) for w in words], np.int64)
        data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        self.longest = int(max(size.max(initial=0), 4))  # bytes of a word or character
        # the trie: a node is the place of its edge among keys of (parent + 1, byte); its log is 1 where no word ends
        keys, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        node, left, depth, first = np.full(len(words), -1, np.int64), np.arange(len(words)), 0, 0
        while len(left):
            found, which = np.unique((node[left] + 1) << 8 | data[at[left] + depth], return_inverse=True)
            node[left] = first + which
            depth += 1
            done, log = size[left] == depth, np.ones(len(found), np.int64)
            log[which[done]] = logs[left[done]]
            keys.append(found)
            ends.append(log)
            first, left = first + len(found), left[~done]
        self.keys, self.logs = pd.Index(np.concatenate(keys)), np.concatenate(ends)
        self.heads = self.keys.get_indexer(np.arange(256))  # the nodes of first bytes, and of first two
        pairs = (self.heads[:, None] + 1) << 8 | np.arange(256)
        self.pairs = np.where(self.heads[:, None] < 0, -1, self.keys.get_indexer(pairs.ravel()).reshape(256, 256)).ravel()

    def ends(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words end, as ascending offsets into ``data``; ``bounds`` are the runs' ends in it, equal ones where runs are empty."""
        out, begin = [np.zeros(0, np.int64)], 0
        runs = np.unique(bounds[bounds > 0])
        while len(runs):
            k = int(np.searchsorted(runs, begin + BLOCK, "right"))
            end = int(runs[k - 1]) if k else self._part(data, begin, int(runs[0]))
            out.append(begin + self._block(data[begin:end], np.append(runs[: max(0, k - 1)], end) - begin))
            begin, runs = end, runs[np.searchsorted(runs, end, "right") :]
        return np.concatenate(out)

    def _part(self, data: np.ndarray, begin: int, end: int) -> int:
        """A place after ``begin`` that no word of its run, which ends at ``end``, crosses."""
        size = BLOCK
        while begin + size < end:
            text, _, _, chars, reach = self._text(data[begin : begin + size], np.array([size]))
            self._words(text, chars, reach)
            places = np.flatnonzero(self._whole(reach)[1 : max(1, size - self.longest)]) + 1  # words that begin near the part's end may go on
            if len(places):
                return begin + int(places[-1])
            size *= 2
        return end

    def _block(self, data: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """As ``ends``, for runs that have bytes."""
        text, apart, inside, chars, reach = self._text(data, runs)
        word, to, log, rank, count = self._words(text, chars, reach)

        whole = self._whole(reach)
        whole[apart] = True
        stop = np.flatnonzero(whole)
        begin = stop[inside.take(stop)]
        away = np.repeat(stop[1:], np.diff(stop))  # to the end of the stretch
        away = away.take(chars) - chars

        order = np.argsort(away.astype(np.uint16) if away.max() < 1 << 16 else away, kind="stable")
        chars = chars.take(order)
        lay = np.append(0, np.cumsum(count.take(chars)))  # of a character's first word among all words, by distance and character
        count[chars] = lay[:-1]
        place = count.take(word) + rank
        by_place = np.empty((2, len(place)), np.int64)
        by_place[0][place], by_place[1][place] = to, log
        first = self._best(chars, lay, *by_place, np.append(0, np.cumsum(np.bincount(away))), whole)

        cut = np.zeros(len(text), bool)
        while len(begin) > _NARROW:
            cut[begin] = True
            begin = first[begin]
            begin = begin[~whole[begin]]
        for k in begin.tolist():
            cut[k] = True
            while not whole[k := int(first[k])]:
                cut[k] = True
        cut[apart] = True
        cut[0] = cut[apart[:-1] + 1] = False  # a run's end stands for its last word; its begin ends none
        found = np.flatnonzero(cut)
        return found - np.searchsorted(apart, found)

    @staticmethod
    def _text(data: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs set apart, where they are, which bytes are theirs, where their characters begin, and the furthest end of what begins at a byte."""
        apart = runs + np.arange(len(runs))  # the bytes between the runs, which take one place each
        text = np.full(len(data) + len(runs), _APART, np.uint8)
        inside = np.ones(len(text), bool)
        inside[apart] = False
        text[inside] = data
        starts = (text & 0xC0) != 0x80
        starts[np.append(0, apart[:-1] + 1)] = True
        chars = np.flatnonzero(starts)
        reach = np.arange(1, len(text) + 1)
        reach[chars[:-1]] = chars[1:]
        reach[apart] = apart
        chars = chars[inside.take(chars)]
        return text, apart, inside, chars, reach

    @staticmethod
    def _whole(reach: np.ndarray) -> np.ndarray:
        """Whether no word crosses the place before a byte."""
        return np.append(True, np.maximum.accumulate(reach[:-1]) <= np.arange(1, len(reach)))

    def _words(self, text: np.ndarray, chars: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words that begin at ``chars``: where, their ends, logs, and ranks among those of their start; and how many begin at a byte.

        ``reach`` has the ends of characters, and is moved to the furthest end of a word.
        """
        count, one, unknown = np.zeros(len(text), np.int64), reach.copy(), np.zeros(len(text), bool)
        unknown[chars] = True
        at, node, depth = chars, self.heads.take(text.take(chars)), 1
        found: list[tuple[np.ndarray, ...]] = []
        while len(at):
            if depth == 2:
                node = self.pairs.take(text.take(at).astype(np.int64) << 8 | text.take(at + 1))
            elif depth > 2:
                node = self.keys.get_indexer((node + 1) << 8 | text.take(at + (depth - 1)))
            on = np.flatnonzero(node >= 0)
            at, node = at.take(on), node.take(on)
            log = self.logs.take(node)
            on = np.flatnonzero(log < 1)
            p = at.take(on)
            rank, z = count.take(p), p + depth
            count[p], reach[p] = rank + 1, z
            found.append((p, z, log.take(on), rank))
            if depth <= 4:
                unknown[p[one.take(p) == z]] = False
            depth += 1
        p = np.flatnonzero(unknown)
        rank = count.take(p)
        count[p] = rank + 1
        found.append((p, one.take(p), np.full(len(p), self.unknown, np.int64), rank))
        return *map(np.concatenate, zip(*found)), count

    @staticmethod
    def _best(chars: np.ndarray, lay: np.ndarray, to: np.ndarray, log: np.ndarray, steps: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """For each of ``chars``, which lie by their distance from the end of the stretch, the end of its path's first word.

        The words of character i are ``lay[i]`` to ``lay[i + 1]``, the characters at distance t ``steps[t]`` to ``steps[t + 1]``.
        """
        best, first, inner = np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int64), ~whole[chars]  # 0 where a stretch begins: the one before ends there
        last = int(np.flatnonzero(np.diff(steps[: _SAFE + 1]) >= _NARROW).max(initial=0)) + 1
        done, base = int(steps[last]), int(lay[steps[last]])
        packed = (log[:base] << 16) + (to[:base] - np.repeat(chars[:done], np.diff(lay[: done + 1])) - 256)  # one word less, and its bytes
        for a, b in zip(steps[1:last].tolist(), steps[2 : last + 1].tolist()):
            if a == b:
                continue
            i, j = int(lay[a]), int(lay[b])
            top = np.maximum.reduceat(packed[i:j] + best.take(to[i:j]), lay[a:b] - i)
            size, k = top & 255, chars[a:b]
            best[k] = (top - size) * inner[a:b]
            first[k] = k + size
        if done < len(chars):
            sums, after = {}, best.take(to[base:]) >> 8
            logs = -(-after >> 8)  # of what is known, with as many words as are left
            ends, scores = to[base:].tolist(), ((log[base:] + logs) * _STEP - 1 - ((logs << 8) - after)).tolist()
            for k, on, i, j in zip(chars[done:].tolist(), inner[done:].tolist(), (lay[done:-1] - base).tolist(), (lay[done + 1 :] - base).tolist()):
                top = end = None
                for m in range(i, j):
                    z = ends[m]
                    score = scores[m] + sums[z] if z in sums else scores[m]
                    if top is None or score > top or score == top and z > end:
                        top, end = score, z
                first[k] = end
                if on:
                    sums[k] = top
        return first
