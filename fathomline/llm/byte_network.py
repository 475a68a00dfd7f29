"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes become classes (letters folded to lower case, digits to one class, runs of other ASCII to one blank,
each byte beyond ASCII its own) and are laid in windows of ``WINDOW`` bytes that overlap by the widest filter, so that
every stretch of text lies whole in one of them and nothing is left out. Filters of several widths slide over a window, their
greatest responses (max pooling, cut at zero) enter a softmax over the languages. A text's probabilities are its windows'
means, weighted by how many letters a window has; its language is the likeliest, ties by name.

Training sees at most ``SAMPLE_ROWS`` texts, shared evenly by the languages (``MAX_LANGUAGES`` most frequent ones),
``SAMPLE_WINDOWS`` places of each; they are chosen by hash among documents that have a language and are not held out
(crc32 of the id as text, modulo 3, is 1). Prediction is one map pass over whole texts; language, source and id are not
read by it.

Defined results: a null text and one without a letter are ``und`` with score 0; without labelled documents everything is;
a null id counts as an empty text for the hold-out; repeated rows repeat, equal texts get equal values; extra columns
are ignored; very long texts are read whole, ``PIECE`` windows at once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
SAMPLE_ROWS, SAMPLE_WINDOWS, MAX_LANGUAGES = 6000, 2, 200
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
#: Windows that are scored at once.
PIECE = 32
UNKNOWN = "und"
STEP = WINDOW - (max(WIDTHS) - 1)

BLANK, DIGIT = 0, 27
CLASSES = 156
#: Class of each byte: blank, a to z, digit, and one for each byte beyond ASCII.
CLASS_OF = np.array([c - 128 + 28 if c >= 128 else (c | 32) - 96 if chr(c).isalpha() else DIGIT if chr(c).isdigit() else BLANK for c in range(256)], np.uint8)
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _WORD.search(text)
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def windows(data: bytes) -> np.ndarray:
    """Classes of a text in windows (rows); the last one is filled up with blanks."""
    codes = CLASS_OF[np.frombuffer(data, np.uint8)]
    codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])[: len(codes)]]
    n = max(1, -(-(len(codes) - (WINDOW - STEP)) // STEP))
    filled = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    filled[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(filled, WINDOW)[::STEP]


def pool(responses: np.ndarray) -> np.ndarray:
    """Maxima over the places of (window, place, filter), halved step by step; ``responses`` is used up."""
    left = responses.shape[1]
    while left > 1:
        half = left // 2
        np.maximum(responses[:, :half], responses[:, left - half : left], out=responses[:, :half])
        left -= half
    return responses[:, 0]


@dataclass
class Network:
    """Filters by width, as tables (place in the filter, class, filter); their biases; the softmax's weights and biases."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Responses (window, place, filter) of each width's filters."""
        return [sum(f[i][x[:, i : WINDOW - len(f) + 1 + i]] for i in range(len(f))) for f in self.filters]

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """A network whose filters are tables over pairs of classes, so that a place's responses are the sum of two rows."""

    def __init__(self, network: Network):
        self.network = network
        zero = np.zeros((CLASSES, FILTERS), np.float32)
        part = [np.concatenate([f[i] if i < len(f) else zero for f in network.filters], axis=1) for i in range(4)]  # by place: class, filters of all widths
        self.head = (part[0][:, None] + part[1]).reshape(CLASSES * CLASSES, -1)
        self.tail = (part[2][:, None] + part[3]).reshape(CLASSES * CLASSES, -1)
        self.room = [np.empty((PIECE, WINDOW - 3, self.head.shape[1]), np.float32) for _ in range(2)]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Greatest responses in each of at most PIECE windows."""
        pairs = x[:, :-1].astype(np.intp) * CLASSES + x[:, 1:]
        n = pairs.shape[1]
        got, more = (r[: len(x)] for r in self.room)
        np.take(self.head, pairs[:, : n - 2], axis=0, out=got, mode="clip")
        np.take(self.tail, pairs[:, 2:], axis=0, out=more, mode="clip")
        got += more
        best = pool(got)
        # the places that only narrow filters reach, at the window's end
        end = self.head[pairs[:, n - 2 :]]
        two, three = slice(FILTERS), slice(FILTERS, 2 * FILTERS)
        best[:, two] = np.maximum(best[:, two], end[:, :, two].max(axis=1))
        best[:, three] = np.maximum(best[:, three], end[:, 0, three] + self.network.filters[1][2][x[:, -1]])
        return best

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Each text's probabilities of the languages; the windows of all texts go through the network in pieces."""
        found = [windows(t) for t in texts]
        ends = np.cumsum([len(w) for w in found])
        x = np.concatenate(found)
        chances = np.concatenate([self.network.probabilities(self.pooled(x[a : a + PIECE])) for a in range(0, len(x), PIECE)])
        chances *= ((x != BLANK) & (x != DIGIT)).sum(axis=1)[:, None]
        sums = np.add.reduceat(chances, np.concatenate([[0], ends[:-1]]), axis=0)
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)


def fit(x: np.ndarray, language: np.ndarray, languages: list[str]) -> Network:
    """A network trained on windows ``x`` and their languages (places in ``languages``) by Adam on the cross-entropy.

    A window is cut to a random length in each epoch, so that short texts are learned as well.
    """
    rng = np.random.default_rng(SEED)
    f = [rng.normal(0, 0.1, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    width = FILTERS * len(WIDTHS)
    net = Network(languages, f, np.zeros(width, np.float32), rng.normal(0, 0.1, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    held = [*net.filters, net.bias, net.out, net.out_bias]
    first, second, t = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    columns = np.arange(FILTERS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            lengths = np.where(rng.random(len(at)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(at)))
            part = np.where(np.arange(WINDOW) < lengths[:, None], x[at], BLANK)
            found = net.responses(part)
            places = [r.argmax(axis=1) for r in found]
            pooled = np.concatenate([np.take_along_axis(r, p[:, None], 1)[:, 0] for r, p in zip(found, places, strict=True)], axis=1)
            active = np.maximum(pooled + net.bias, 0)
            error = net.probabilities(pooled)
            error[np.arange(len(at)), language[at]] -= 1
            error /= len(at)
            back = (error @ net.out.T) * (active > 0)
            slopes = []
            for k, (w, p) in enumerate(zip(WIDTHS, places, strict=True)):
                g, own = np.zeros_like(net.filters[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(w):
                    np.add.at(g[i], (np.take_along_axis(part, p + i, 1), columns), own)
                slopes.append(g)
            slopes += [back.sum(axis=0), active.T @ error, error.sum(axis=0)]
            t += 1
            for p, g, m, v in zip(held, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def train(documents: DataFrame) -> Network | None:
    """A network fitted on a bounded sample of the documents that have a language and are not held out; None without any."""
    labelled = documents.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return None
    quota = max(1, SAMPLE_ROWS // len(counts))
    # twice the quota of each language by hash; the window below keeps the quota
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, 2 * quota / r["n"]))))[F.col("lang")]
    chosen = labelled.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def places(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in b.column(1).to_pylist():
            found = windows(text.encode()) if has_letter(text) else np.empty((0, WINDOW), np.uint8)
            at = np.unique(np.linspace(0, len(found) - 1, SAMPLE_WINDOWS).round().astype(int)) if len(found) else []
            rows.append(b"".join(found[k].tobytes() for k in at))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], ["lang", "h", "x"])

    cut = arrow_map(chosen.select("lang", "text", "h"), "lang string, h long, x binary", places)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))
    sample = cut.where(F.length("x") > 0).withColumn("place", place).where(F.col("place") <= quota).select("lang", "x").orderBy("lang", "x").toArrow()
    if not sample.num_rows:
        return None
    languages = sorted(set(sample.column("lang").to_pylist()))
    x = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW) for b in sample.column("x").to_pylist()]
    y = np.repeat([languages.index(n) for n in sample.column("lang").to_pylist()], list(map(len, x)))
    return fit(np.concatenate(x), y, languages)


def identify(documents: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the probability of that language; 0 for ``und``) of every document."""

    class Once:
        scorer: Scorer | None = None

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        if network is not None and Once.scorer is None:
            Once.scorer = Scorer(network)
        names, scores = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
        texts = b.column(2).to_pylist()
        at = [k for k, t in enumerate(texts) if t is not None and has_letter(t)] if network is not None else []
        if at:
            chances = Once.scorer.score([texts[k].encode() for k in at])
            for k, best, p in zip(at, chances.argmax(axis=1).tolist(), chances.max(axis=1).tolist(), strict=True):
                names[k], scores[k] = network.languages[best], min(1.0, p)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(read, "doc_id long, held_out boolean, lang_pred string, score double", rows)
