"""Office files as tables: cells of workbooks, blocks of word-processor files, and folders of files as trees.

Files come as rows (path, content) of Spark's binary-file source, so that they are read where they lie and parsed in
parallel, one file a row. Both formats are zip archives of XML and need no library. A file that can't be read, or that
unpacks to more than MOST_BYTES, gives one row with ``problem`` set, so that one bad file doesn't fail the others.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import mathml
from fathomline.functions.text import flat_headers

#: Bytes that one file may unpack to, and rows of one Arrow batch.
MOST_BYTES = 512 << 20
BATCH_ROWS = 20_000

CELLS = "file string, sheet string, row int, col int, value string, formula boolean, problem string"
BLOCKS = "file string, block int, kind string, level int, body string, problem string"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and content of every file under ``path`` whose name fits ``glob``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def file_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under ``path`` as a tree: the folders from there down, depth, name and bytes. Contents are not read.

    The source leaves out empty files, which hold nothing to import.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    root = re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/")
    below = F.element_at(F.split("path", re.escape(root) + "/", 2), -1)
    parts = F.split(below, "/")
    return found.select(F.slice(parts, 1, F.size(parts) - 1).alias("folders"), (F.size(parts) - 1).alias("depth"), F.element_at(parts, -1).alias("name"), F.col("length").alias("n_bytes"))


def _per_file(found: DataFrame, schema: str, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Rows (file, *row, problem) of ``parse(content)``; a failure is a row of its own."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for row in parse(content or b""):
                yield (path, *row, None)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
            yield (path, *(None for _ in names[2:]), f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held: list[tuple] = []
                for row in rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return found.select("path", "content").mapInArrow(run, schema)


def _open(content: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(content))
    if sum(i.file_size for i in archive.infolist()) > MOST_BYTES:
        raise ValueError("the file unpacks to too many bytes")
    return archive


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _number(text: str) -> str:
    """Stored numbers have 17 digits; the shortest form that means the same is what was typed."""
    return text if re.fullmatch(r"-?\d+", text) else repr(float(text))


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, row, col, value, formula) of every filled cell, rows and columns from 1; formulas show their stored result."""
    with _open(content) as archive:
        names = set(archive.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _tag(t) == "t"))
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
            if _tag(sheet) != "sheet":
                continue
            target = targets[_attribute(sheet, "id")].lstrip("/")
            with archive.open(target if target.startswith("xl/") else f"xl/{target}") as source:
                at = 0
                for _, row in ElementTree.iterparse(source):
                    if _tag(row) != "row":
                        continue
                    at, col = int(row.get("r") or at + 1), 0
                    for cell in row:
                        letters = re.match(r"[A-Z]+", cell.get("r") or "")
                        col = _column(letters[0]) if letters else col + 1
                        parts = {_tag(p): p for p in cell}
                        kind, text = cell.get("t"), parts["v"].text if "v" in parts else None
                        if kind == "inlineStr":
                            text = "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
                        elif kind == "s" and text is not None:
                            text = shared[int(text)]
                        elif kind in (None, "n") and text is not None:
                            text = _number(text)
                        if text is not None or "f" in parts:
                            yield sheet.get("name"), at, col, text, "f" in parts
                    row.clear()


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def cells(found: DataFrame) -> DataFrame:
    """file, sheet, row, col, value, formula and problem of the workbooks in ``found`` (path, content)."""
    return _per_file(found, CELLS, workbook_cells)


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of plain cells: numbers as numbers, everything else as text, None as nothing."""
    out = io.BytesIO()
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relation}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{relation}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(_cell(v) for v in row) + "</row>" for r, row in enumerate(rows, 1))
            archive.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    if value.startswith("="):
        return f"<c><f>{escape(value[1:])}</f></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def word_blocks(content: bytes) -> Iterator[tuple]:
    """(block, kind, level, body): headings, paragraphs and tables in order. Formulas become LaTeX between dollar signs.

    A table's spanning cells repeat in every place they cover; its body has a header line and a line for each row.
    """
    with _open(content) as archive:
        body = next(e for e in ElementTree.fromstring(archive.read("word/document.xml")) if _tag(e) == "body")
        n = 0
        for e in body:
            if _tag(e) == "p" and (text := " ".join(_inline(e).split())):
                style = next((_attribute(s, "val") or "" for s in e.iter() if _tag(s) == "pStyle"), "")
                level = re.fullmatch(r"(?i)heading\s*([1-9])", style)
                yield n, "heading" if level else "paragraph", int(level[1]) if level else 0, text
                n += 1
            elif _tag(e) == "tbl" and (grid := word_grid(e)):
                lines = [flat_headers(grid[:1]), *grid[1:]]
                yield n, "table", 0, "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |" for line in lines)
                n += 1


def _inline(e: ElementTree.Element) -> str:
    out = []
    for child in e:
        name = _tag(child)
        if name in ("oMath", "oMathPara"):
            out.append(f" ${mathml.latex(child)}$ ")
        elif name == "t":
            out.append(child.text or "")
        elif name in ("tab", "br", "cr"):
            out.append(" ")
        elif name not in ("pPr", "rPr", "del", "moveFrom"):
            out.append(_inline(child))
    return "".join(out)


def word_grid(table: ElementTree.Element) -> list[list[str]]:
    """The cells of a table as a full grid: gridSpan repeats to the right, a continued vMerge repeats from above."""
    grid: list[list[str]] = []
    for row in (r for r in table if _tag(r) == "tr"):
        line: list[str] = []
        for cell in (c for c in row if _tag(c) == "tc"):
            text = " ".join(" ".join(_inline(p) for p in cell if _tag(p) in ("p", "tbl")).split())
            props = {_tag(p): p for q in cell if _tag(q) == "tcPr" for p in q}
            merged = "vMerge" in props and _attribute(props["vMerge"], "val") != "restart"
            span = int(_attribute(props["gridSpan"], "val") or 1) if "gridSpan" in props else 1
            for _ in range(min(1000, max(1, span))):
                line.append(grid[-1][len(line)] if merged and grid and len(line) < len(grid[-1]) else text)
        grid.append(line)
    width = max(map(len, grid), default=0)
    return [line + [""] * (width - len(line)) for line in grid]


def blocks(found: DataFrame) -> DataFrame:
    """file, block, kind, level, body and problem of the word-processor files in ``found`` (path, content)."""
    return _per_file(found, BLOCKS, word_blocks)
