"""Document-to-chunk operators: per-document Python in Arrow batches where order matters, windows for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import markdown as md


#: Characters of rows that a worker gathers before it sends them on, and rows.
SENT_CHARS, SENT_ROWS = 1 << 20, 5000


def per_document(documents: DataFrame, schema: str, split: Callable[[str | None], list[tuple]]) -> DataFrame:
    """Rows (doc_id, *row) of ``split(text)`` for every document, without a shuffle: a document is one row.

    A worker reads one document at a time and sends rows on as they gather, so that it holds a few texts whatever a batch holds.
    """
    names = ["doc_id", *(f.split()[0] for f in schema.split(", "))]
    most_chars, most_rows = SENT_CHARS, SENT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), run.kinds, strict=True)], names)

        rows, chars = [], 0
        for b in batches:
            for d, t in zip(b.column(0), b.column(1), strict=True):
                d, t = d.as_py(), t.as_py()
                for r in split(t):
                    rows.append((d, *r))
                    chars += sum(len(v) for v in r if isinstance(v, str))
                    if chars >= most_chars or len(rows) >= most_rows:
                        yield sent(rows)
                        rows, chars = [], 0
        if rows:
            yield sent(rows)

    from pyspark.sql.pandas.types import to_arrow_schema

    made = "doc_id long, " + schema
    run.kinds = [f.type for f in to_arrow_schema(documents.sparkSession.createDataFrame([], made).schema)]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, made)


def elements(documents: DataFrame) -> DataFrame:
    return per_document(documents, "position long, kind string, first_line long, last_line long, level long, trail string, body string", lambda t: [(k, e.kind, e.start, e.end, e.level, " > ".join(e.trail), e.text) for k, e in enumerate(md.elements(t))])


def coarse(documents: DataFrame) -> DataFrame:
    return per_document(documents, "chunk long, first_line long, last_line long, body string", lambda t: [(k, *c) for k, c in enumerate(md.coarse_chunks(md.elements(t)))])


def semantic(documents: DataFrame) -> DataFrame:
    return per_document(documents, "segment long, tokens long, body string", lambda t: [(k, md.tokens(s), s) for k, s in enumerate(md.segments(t or ""))])


def cohesions(documents: DataFrame) -> DataFrame:
    def gaps(t: str | None) -> list[tuple]:
        parts = md.atoms(t or "")
        c = md.cohesion([md.stub_vector(p) for p in parts], [md.tokens(p) for p in parts])
        return [(k, x, d) for k, (x, d) in enumerate(zip(c, md.depths(c), strict=True))]

    return per_document(documents, "gap long, cohesion double, depth double", gaps)


def overlap(chunks: DataFrame, keys: list[str], order: str, chars: int) -> DataFrame:
    """Chunks with the tail of the one before and the head of the one after, which never displace the body."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag("content").over(w), F.lead("content").over(w)
    return chunks.withColumns({"before": F.coalesce(F.right(before, F.lit(chars)), F.lit("")), "after": F.coalesce(F.left(after, F.lit(chars)), F.lit(""))})


def drafts(chunks: DataFrame) -> DataFrame:
    """Chunk rows ready to be stored: an id that reruns reproduce, the content's hash, the order in the document."""
    body = F.sha2("content", 256)
    return chunks.select(F.substring(F.sha2(F.concat_ws(":", "doc_id", "chunk_index", body), 256), 1, 32).alias("draft_id"), "doc_id", "chunk_index", body.alias("content_hash"))


def trail(level: list[Column], keys: list[str], order: str) -> list[Column]:
    """Heading trails by windows: the last title of each level, forgotten where a higher level begins anew.

    ``level[k]`` is the title on rows that are headings of level k + 1, else null.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for k, title in enumerate(level):
        at = F.max(F.when(title.isNotNull(), F.col(order))).over(w)
        above = F.greatest(*(F.coalesce(F.max(F.when(t.isNotNull(), F.col(order))).over(w), F.lit(-1)) for t in level[:k]), F.lit(-1)) if k else F.lit(-1)
        out.append(F.when(at > above, F.last(title, ignorenulls=True).over(w)))
    return out
