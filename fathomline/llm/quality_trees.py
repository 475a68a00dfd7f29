"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

``statistics`` measures every whole text; ``fit`` boosts small histogram trees on labelled statistics with monotonic
constraints on chosen features; ``Trees`` keeps the nodes of all trees in flat arrays and scores a batch level by level.

Defined results: null and empty texts have zero words and fail the base rules; without any labelled row, or with labels
of one kind only, the base rules alone decide; labels that are null, other than 0 or 1, or without a document are left out;
rows without an id are judged like any other; repeated rows are judged each by itself and count once in the sample, where an
id with several texts has its least features; equal scores are equal verdicts; extra columns are kept by ``keep_good`` and
ignored by ``verdicts``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, utf8

#: The classifier is fitted on at most this many labelled documents, those with the smallest hash of their id.
SAMPLE_ROWS = 6000
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
UPPER, DIGITS, LETTERS = bytes(range(65, 91)), bytes(range(48, 58)), bytes([*range(65, 91), *range(97, 123)])
ENDS = b".!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees, and the sign a score may move in as the feature grows (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "digit_share": 0, "mark_share": 0, "distinct_share": 0, "short_line_share": 0, "words_per_line": 0, "longest_run_share": -1}


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts in the order of COUNTS and the features in the order of FEATURES, of one UTF-8 text."""
    words = text.split()
    n = len(words)
    code_points = len(text) if text.isascii() else len(text.decode())
    chars = code_points - (len(text) - len(text.translate(None, WHITE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = short = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
            short += len(line) < 30
    repeat = repeated_words(words)
    run = longest = 1 if n else 0
    distinct = len(set(words))
    if distinct < n:
        for a, b in zip(words, words[1:], strict=False):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    d = max(1, n)
    upper, letters = len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, LETTERS))
    digits, ends = len(text) - len(text.translate(None, DIGITS)), len(text) - len(text.translate(None, ENDS))
    features = [np.log1p(n), chars / d, symbols / d, dup / max(1, lines), repeat / d, upper / max(1, letters), digits / max(1, chars), ends / d, distinct / d, short / max(1, lines), n / max(1, lines), longest / d]
    return [n, chars, symbols, dup, repeat], features


def repeated_words(words: list[bytes]) -> int:
    """Words in a window of three that occurs twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count: dict[tuple, int] = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


@dataclass
class Trees:
    """Boosted trees as flat arrays: node k tests feature[k] <= cut[k] and goes to left[k] or left[k] + 1; leaves point to themselves."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``; all trees and rows move down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.left[at] >= 0
            go = self.left[at] + (x[rows, self.feature[at]] > self.cut[at])
            at = np.where(inner, go, at)
        return self.start + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: int = 12, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits.

    A split on a constrained feature must order its children's values by the sign, and the midpoint of the two bounds
    everything below them, which keeps each tree, and so their sum, monotonic in that feature.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    score = np.full(len(y), start)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        grad, hess = y - q, q * (1 - q)
        roots.append(len(nodes))
        nodes.append([0, 0.0, -1, 0.0])
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            k, rows, level, low, high = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[k][3] = rate * float(np.clip(g / (h + ridge), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * leaf:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    n_l = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    g_l = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                    h_l = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                    v_l, v_r = np.clip(g_l / (h_l + ridge), low, high), np.clip((g - g_l) / (h - h_l + ridge), low, high)
                    fair = (n_l >= leaf) & (len(rows) - n_l >= leaf) & ((v_r - v_l) * signs[f] >= 0)
                    gain = np.where(fair, g_l**2 / (h_l + ridge) + (g - g_l) ** 2 / (h - h_l + ridge) - g**2 / (h + ridge), 0)
                    if gain.max() > best[0]:
                        c = int(gain.argmax())
                        best = (float(gain[c]), (f, c, float(v_l[c]), float(v_r[c])))
            if best[1] is None:
                score[rows] += nodes[k][3]
                continue
            f, c, v_l, v_r = best[1]
            nodes[k][:3] = [f, float(edges[f][c]), len(nodes)]
            nodes += [[0, 0.0, -1, 0.0], [0, 0.0, -1, 0.0]]
            mid = (v_l + v_r) / 2
            go_left = binned[rows, f] <= c
            bounds = ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid)) if signs[f] < 0 else ((low, high), (low, high))
            for child, part, (a, z) in zip((len(nodes) - 2, len(nodes) - 1), (rows[go_left], rows[~go_left]), bounds, strict=True):
                todo.append((child, part, level + 1, a, z))
    flat = np.asarray(nodes)
    return Trees(start, np.asarray(roots), flat[:, 0].astype(np.int32), flat[:, 1], flat[:, 2].astype(np.int32), flat[:, 3], depth)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts and ``features`` (array of double) of every document."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = zip(*map(statistics, utf8(b.column(1))), strict=True)
        return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*counts, strict=True)), pa.array(features, pa.list_(pa.float64()))], ["doc_id", *COUNTS, "features"])

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>", rows)


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``bound`` labelled documents, chosen by a hash of the id over the whole label table."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = clean.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most `bound` rows
    measured = measure(found).groupBy("doc_id").agg(F.min("features").alias("features"))  # one row an id, however often it is repeated
    rows = measured.join(F.broadcast(chosen), "doc_id").select("doc_id", "features", "quality").toArrow().sort_by("doc_id")  # the fit doesn't depend on arrival
    if not rows.num_rows:
        return np.empty((0, len(FEATURES))), np.empty(0)
    return np.asarray(rows.column("features").to_pylist(), float), rows.column("quality").to_numpy().astype(float)


def train(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Trees | None:
    """Trees fitted on the labelled sample; None where it has no two kinds of labels."""
    x, y = labelled_sample(documents, labels, bound)
    return fit(x, y, list(FEATURES.values())) if len(set(y.tolist())) == 2 else None


def _failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])


def verdicts(documents: DataFrame, trees: Trees | None, threshold: float = 0.0) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score (log odds, 0 without trees) of every document."""

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = zip(*map(statistics, utf8(b.column(1))), strict=True)
        counts = np.asarray(counts, np.int64)
        failed = _failed(counts)
        score = trees.score(np.asarray(features)) if trees else np.zeros(len(counts))
        return pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, rows)


def keep_good(documents: DataFrame, trees: Trees | None, threshold: float = 0.0) -> DataFrame:
    """The rows of ``documents`` that both the base rules and the trees keep, with all their columns."""
    at = documents.columns.index("text")

    def rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        counts, features = zip(*map(statistics, utf8(b.column(at))), strict=True)
        keep = ~_failed(np.asarray(counts, np.int64))
        if trees:
            keep &= trees.score(np.asarray(features)) >= threshold
        return b.filter(pa.array(keep)) if keep.any() else None

    return arrow_map(documents, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), rows)
