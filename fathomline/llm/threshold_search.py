"""Ranked lexical search by Fagin's threshold algorithm, exact, over shards of the documents.

A document's score for an item is the sum of w * c over the item's terms, where w weighs the term and c grows with its
share of the document. Two passes over the documents answer a block of items:

* ``statistics`` counts documents, terms and the block's document frequencies: tasks send partial sums only.
* ``search`` cuts the documents that a task reads into shards of a bounded size. A shard keeps a forward index (the
  block's terms of every document) and, for every term, a list of its documents by falling impact. For each item the
  lists are read round-robin from the top; a document met for the first time is looked up in the forward index and
  scored in full. The threshold is the sum of the impacts at the depth reached: no unread document scores more, so that
  reading stops when it falls strictly below the k-th best score so far, which the task carries from shard to shard.
  Documents that tie with the k-th are always read, so that ties go by id.

Every task sends its k best of an item on; they are merged in two steps, so that no task gets more than ``MERGE_PARTS``
times k rows of an item. Documents are never shuffled and no posting list leaves its shard, whatever words are
frequent or groups of copies large. Items are taken in blocks with a bound on their terms (``BLOCK_ITEMS``,
``BLOCK_BYTES``; one item is never divided); each block's hits are appended to a table in the shared folder.

Defined results: a null or empty text has no term and is never found; an item without terms finds nothing; repeated
rows are documents of their own, as are those without an id, which come last among equals; repeated items each have
their hits, items without an id under a null item_id; columns with other names are ignored; without documents or items
the result is empty. Whole texts count, whatever their length.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, bounded_batches, utf8
from fathomline.sources.shared import new_path

K = 50
#: Items of a block, and bytes of their distinct terms; a block is all of the items that driver and tasks hold at once.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 4 << 20
#: Documents and postings of a shard at most (a shard has one document at least).
SHARD_DOCS, SHARD_POSTINGS = 8192, 1_000_000
#: Parts that the tasks' hits of an item are merged in first.
MERGE_PARTS = 64
#: Depth that lists are read to before the threshold is first compared; it doubles after that.
FIRST_DEPTH = 32
HITS = "item bigint, doc_id bigint, score bigint"
#: ASCII but letters and digits separates terms, so that terms are runs of bytes in UTF-8 as well.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

Block = tuple[list[int], list[int | None], list[list[bytes]]]


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return text.translate(FOLD).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def blocks(items: DataFrame) -> Iterator[Block]:
    """Numbers, item ids and distinct terms of the items, in blocks within BLOCK_ITEMS and BLOCK_BYTES."""
    numbers, ids, asked, held = [], [], [], 0
    for number, row in enumerate(items.select(F.col("item_id").cast("long"), "text").toLocalIterator()):
        found = sorted(set(terms((row[1] or "").encode())))
        size = sum(map(len, found))
        if numbers and (len(numbers) == BLOCK_ITEMS or held + size > BLOCK_BYTES):
            yield numbers, ids, asked
            numbers, ids, asked, held = [], [], [], 0
        numbers.append(number)
        ids.append(row[0])
        asked.append(found)
        held += size
    if numbers:
        yield numbers, ids, asked


def statistics(documents: DataFrame, vocabulary: list[bytes]) -> tuple[int, int, list[int]]:
    """Documents with a term, all terms, and how many documents hold each term of ``vocabulary``."""
    place = {t: k for k, t in enumerate(vocabulary)}
    bounded_batches(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary) + 2, np.int64)  # two more: documents and terms
        for b in batches:
            for t in utf8(b.column(0)):
                words = terms(t)
                seen[-2] += bool(words)
                seen[-1] += len(words)
                seen[[place[w] for w in place.keys() & set(words)]] += 1
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["place", "n"])

    found = dict(documents.select("text").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n")).toLocalIterator())
    v = len(vocabulary)
    return found.get(v, 0), found.get(v + 1, 0), [found.get(k, 0) for k in range(v)]


class Shard:
    """Some documents: a forward index, and for every term its documents by falling impact."""

    def __init__(self, docs: np.ndarray, edges: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.docs, self.edges, self.term, self.impact = docs, edges, term, impact
        owner = np.repeat(np.arange(len(docs)), np.diff(edges))
        order = np.lexsort((-impact, term))
        self.listed, self.listed_impact = owner[order], impact[order]
        self.list_edges = np.searchsorted(term[order], np.arange(n_terms + 1))

    def look_up(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of documents: the impacts of their terms that are ``asked`` for (a flag a term), from the forward index."""
        size = self.edges[rows + 1] - self.edges[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.edges[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate([[0], np.cumsum(np.where(asked[self.term[at]], self.impact[at], 0))])
        return sums[ends] - sums[ends - size]

    def search(self, query: np.ndarray, n_terms: int, held: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``held`` (scores and ids of the k best so far, best first) with this shard's documents merged in."""
        asked = np.zeros(n_terms, bool)
        asked[query] = True
        begins, ends = self.list_edges[query], self.list_edges[query + 1]
        begins, ends = begins[ends > begins], ends[ends > begins]
        met = np.zeros(len(self.docs), bool)
        depth, step = 0, FIRST_DEPTH
        while len(begins):
            fresh = np.zeros(len(self.docs), bool)
            for a, z in zip((begins + depth).tolist(), np.minimum(begins + depth + step, ends).tolist(), strict=True):
                fresh[self.listed[a:z]] = True
            rows = np.flatnonzero(fresh & ~met)
            met |= fresh
            held = merged(held, self.look_up(rows, asked), self.docs[rows], k)
            depth, step = depth + step, 2 * step
            left = begins + depth < ends
            begins, ends = begins[left], ends[left]
            # an unread document has at most the next impact of each list that is not at its end
            if len(held[0]) == k and self.listed_impact[begins + depth].sum() < held[0][-1]:
                break
        return held


def merged(held: tuple[np.ndarray, np.ndarray], score: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, best first, ties by id; scores of 0 don't count."""
    least = held[0][-1] if len(held[0]) == k else 1
    use = score >= least
    if not use.any():
        return held
    score, docs = np.concatenate([held[0], score[use]]), np.concatenate([held[1], docs[use]])
    if len(score) > k:
        use = score >= -np.partition(-score, k - 1)[k - 1]
        score, docs = score[use], docs[use]
    order = np.lexsort((docs, -score))[:k]
    return score[order], docs[order]


#: Stands for a null id inside tasks, behind all others.
NO_ID = np.iinfo(np.int64).max


def search(documents: DataFrame, block: Block, k: int = K) -> DataFrame:
    """Each task's ``k`` best documents of every item of ``block``: item (its number), doc_id and score."""
    numbers, _, asked = block
    vocabulary = sorted(set().union(*asked))
    n_docs, n_words, frequencies = statistics(documents, vocabulary)
    weights = np.array([weight(n_docs, f) for f in frequencies], np.int64)
    place = {t: j for j, t in enumerate(vocabulary) if weights[j] > 0 and frequencies[j]}
    queries = [np.array([place[t] for t in found if t in place], np.int64) for found in asked]
    v = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.int64)
        best = [(nothing, nothing)] * len(queries)
        for shard in _shards(batches, place, weights, n_docs, n_words):
            best = [shard.search(q, v, held, k) if len(q) else held for q, held in zip(queries, best, strict=True)]
        item = np.repeat(np.array(numbers, np.int64), [len(s) for s, _ in best])
        score, docs = (np.concatenate([x[j] for x in best]) for j in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(docs, mask=docs == NO_ID), pa.array(score)], ["item", "doc_id", "score"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)


def _shards(batches: Iterator[pa.RecordBatch], place: dict[bytes, int], weights: np.ndarray, n_docs: int, n_words: int) -> Iterator[Shard]:
    docs, sizes, term, ratio = (array("q") for _ in range(4))

    def shard() -> Shard:
        t = np.array(term)
        made = Shard(np.array(docs), np.concatenate([[0], np.cumsum(sizes)]), t, weights[t] * np.array(ratio), len(weights))
        for held in (docs, sizes, term, ratio):
            del held[:]
        return made

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            words = terms(text)
            counted = Counter(words)
            found = [(place[w], counted[w]) for w in place.keys() & counted.keys()]
            if not found:
                continue
            if docs and (len(docs) == SHARD_DOCS or len(term) + len(found) > SHARD_POSTINGS):
                yield shard()
            m = 50 + 50 * len(words) * n_docs // n_words
            docs.append(NO_ID if doc is None else doc)
            sizes.append(len(found))
            term.extend(p for p, _ in found)
            ratio.extend(1_000_000_000 * tf // (1000 * tf + 20 * m) for _, tf in found)
    if docs:
        yield shard()


def rank_documents(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1, highest score first, ties by doc_id), doc_id and score: the ``k`` best documents of every item."""
    spark = documents.sparkSession
    path = new_path(spark, "hits")
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    wrote = False
    for block in blocks(items):
        hits = search(documents, block, k)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
        for by in (["item", part], ["item"]):
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(zip(block[0], block[1], strict=True)), "item bigint, item_id bigint")  # one block's
        hits.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        wrote = True
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    return spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)
