"""Tables as cells: shapes, header paths, unambiguous field names, and retrieval texts with a line for each data row.

Cells are rows (doc_id, table_id, row, column, row_span, column_span, header, text, images, links, nested, blocks); everything
else is windows and groups over them, so that a document's tables are worked on wherever their cells lie.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.sources.shared import stored

KEYS = ["doc_id", "table_id"]
CELLS = "doc_id long, table_id string, row int, column int, row_span int, column_span int, header boolean, text string, images array<string>, links array<struct<label:string,href:string>>, nested array<string>, blocks int"
# Labels of the retrieval text.
COLUMN, TITLE, HEADERS, DATA, LINE, CONTENT = "列", "表格：", "表头：", "数据：", "行", "内容："


def html_cells(pages: DataFrame) -> DataFrame:
    """Cells of all tables, nested ones too, of ``pages`` (doc_id, text: HTML)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fathomline.functions.htmlcells import table_cells

        links = pa.list_(pa.struct([("label", pa.string()), ("href", pa.string())]))
        kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.bool_(), pa.string(), pa.list_(pa.string()), links, pa.list_(pa.string()), pa.int32()]
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", CELLS)]
        for b in batches:
            rows = [
                (d, c.table, c.row, c.column, c.row_span, c.column_span, c.header, c.text, c.images, [{"label": x, "href": h} for x, h in c.links], c.nested, c.blocks)
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c in table_cells(t)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pages.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CELLS)


def shapes(cells: DataFrame) -> DataFrame:
    """rows, columns, header_rows, title and reasons (what makes a table complex, sorted) of every table.

    Header rows are the leading rows of header cells only, one where there is none. A first header cell over all columns is
    the table's title, if more header rows follow.
    """
    by_row = cells.groupBy(*KEYS, "row").agg(F.bool_and("header").alias("all"))
    headed = by_row.where("all").withColumn("n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("row")) - 1).where("n = row")
    heads = headed.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("heads"))
    wide = lambda name, test: F.when(F.bool_or(test), name)
    shape = cells.groupBy(*KEYS).agg(
        F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("column") + F.col("column_span")).alias("columns"),
        F.max(F.when((F.col("row") == 0) & (F.col("column") == 0) & F.col("header") & (F.col("text") != ""), F.struct("column_span", "text"))).alias("corner"),
        wide("colspan", F.col("column_span") > 1).alias("c"), wide("image_cell", F.size("images") > 0).alias("i"), wide("link_cell", F.size("links") > 0).alias("l"),
        wide("multi_block_cell", F.col("blocks") > 1).alias("m"), wide("nested_table", F.size("nested") > 0).alias("n"), wide("rowspan", F.col("row_span") > 1).alias("r"),
    )
    found = shape.join(heads, KEYS, "left").withColumn("header_rows", F.coalesce("heads", F.lit(1)))
    many = F.when(F.col("header_rows") > 1, "multi_header")
    title = F.when((F.col("header_rows") > 1) & (F.col("corner.column_span") >= F.col("columns")), F.col("corner.text"))
    return found.select(*KEYS, "rows", "columns", "header_rows", title.alias("title"), F.sort_array(F.array_compact(F.array("c", "i", "l", "m", many, "n", "r"))).alias("reasons"))


def header_paths(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """column, path (header texts from the top, repeats in a row once; its number where there is none) and name of every column.

    A name is the shortest end of the path that no other column's path has; where there is none, the last text, with the column's
    number if an earlier one is named so.
    """
    inside = cells.join(shape.select(*KEYS, "columns", "header_rows", F.col("title").isNotNull().alias("titled")), KEYS).where((F.col("row") < F.col("header_rows")) & (F.col("text") != ""))
    rows = F.sequence(F.col("row"), F.least(F.col("row") + F.col("row_span"), F.col("header_rows")) - 1)
    columns = F.sequence(F.col("column"), F.least(F.col("column") + F.col("column_span"), F.col("columns")) - 1)
    spread = inside.select(*KEYS, "titled", "text", F.explode(rows).alias("r"), F.struct(F.col("row"), F.col("column").alias("c0")).alias("from"), columns.alias("cs"))
    spread = spread.where(~F.col("titled") | (F.col("r") > 0)).select(*KEYS, "text", "r", "from", F.explode("cs").alias("column"))
    one = spread.groupBy(*KEYS, "column", "r").agg(F.max_by("text", "from").alias("text"))  # a later cell covers an earlier one
    fresh = ~F.coalesce(F.lag("text").over(Window.partitionBy(*KEYS, "column").orderBy("r")) == F.col("text"), F.lit(False))
    part = F.struct("r", "text")
    paths = one.withColumn("_fresh", fresh).where("_fresh").groupBy(*KEYS, "column").agg(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]).alias("path"))
    every = shape.select(*KEYS, F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    paths = every.join(paths, [*KEYS, "column"], "left").withColumn("path", F.coalesce("path", F.array(F.concat(F.lit(COLUMN), (F.col("column") + 1).cast("string")))))
    ends = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(n.alias("width"), F.array_join(F.slice("path", F.size("path") - n + 1, n), "/").alias("end")))
    suffixes = paths.select(*KEYS, "column", F.size("path").alias("size"), F.explode(ends).alias("e")).select(*KEYS, "column", "size", "e.width", "e.end")
    # a path shorter than a width ends as a whole for that width too
    longest = suffixes.groupBy(*KEYS).agg(F.max("size").alias("most"))
    padded = suffixes.where("width = size").join(longest, KEYS).where("most > size").select(*KEYS, "column", "size", F.explode(F.sequence(F.col("size") + 1, F.col("most"))).alias("width"), "end")
    alike = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "width", "end"))
    single = suffixes.unionByName(padded).withColumn("alike", alike).where("alike = 1 and width <= size").groupBy(*KEYS, "column").agg(F.min_by("end", "width").alias("single"))
    named = paths.join(single, [*KEYS, "column"], "left").withColumn("name", F.coalesce("single", F.element_at("path", -1)))
    again = F.row_number().over(Window.partitionBy(*KEYS, "name").orderBy("column")) > 1
    marked = F.concat("name", F.lit(f"({COLUMN}"), (F.col("column") + 1).cast("string"), F.lit(")"))
    return named.withColumn("_again", again).select(*KEYS, "column", "path", F.when(F.col("_again"), marked).otherwise(F.col("name")).alias("name"))


def cell_value(c: str = "") -> Column:
    """Text, images, links and nested tables of a cell in one line."""
    images = F.transform("images", lambda s, i: F.concat(F.lit("![表格图片"), (i + 1).cast("string"), F.lit("]("), s, F.lit(")")))
    links = F.transform("links", lambda x: F.concat(F.lit("链接：["), F.when(x["label"] == "", "链接").otherwise(x["label"]), F.lit("]("), x["href"], F.lit(")")))
    nested = F.transform("nested", lambda t: F.concat(F.lit("嵌套表格："), t))
    return F.array_join(F.filter(F.concat(F.array("text"), images, links, nested), lambda x: x != ""), "；")


def retrieval_texts(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, title, reasons, complex and text of every table: title, header groups, and for every data row its fields by name.

    A cell over several rows stands in each of their lines, one over several columns once under all their names.
    A table without data rows gives its cells' contents. Cells, shapes and paths are read several times and stored.
    """
    cells = stored(cells, "cells")
    shape = stored(shapes(cells), "shapes")
    paths = stored(header_paths(cells, shape), "paths")
    order = Window.partitionBy(*KEYS, "root").orderBy("column")
    roots = paths.withColumns({"root": F.col("path")[0], "rest": F.array_join(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), "/")}).withColumn("_first", F.first("column").over(order))
    groups = roots.groupBy(*KEYS, "_first", "root").agg(F.array_distinct(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("column", "rest"))), lambda x: x["rest"]), lambda x: x != "")).alias("rest"))
    group = F.concat(F.lit("- "), "root", F.when(F.size("rest") > 0, F.concat(F.lit("："), F.array_join("rest", "、"))).otherwise(""))
    heads = groups.groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_first", group.alias("line")))), lambda x: x["line"]), "\n").alias("heads"))
    valued = cells.withColumn("value", cell_value()).where("value <> ''").join(shape.select(*KEYS, "rows", "columns", "header_rows"), KEYS)
    body = valued.where(F.col("row") >= F.col("header_rows")).select(*KEYS, "row", "column", "row_span", "column_span", "columns", "value")
    under = body.withColumn("under", F.explode(F.sequence(F.col("column"), F.least(F.col("column") + F.col("column_span"), F.col("columns")) - 1)))
    under = under.join(paths.select(*KEYS, F.col("column").alias("under"), "name"), [*KEYS, "under"])
    fields = under.groupBy(*KEYS, "row", "column", "row_span", "value").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("under", "name"))), lambda x: x["name"])), "、").alias("name"))
    field = F.replace(F.concat("name", F.lit("："), "value"), F.lit(" | "), F.lit(" \\| "))
    lines = fields.select(*KEYS, "row", "column", field.alias("field"), F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("line"))
    lines = lines.groupBy(*KEYS, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "column", "field"))), lambda x: x["field"]), " | ").alias("fields"))
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("line"))
    lines = lines.withColumn("fields", F.concat(F.lit(f"- {LINE}"), number.cast("string"), F.lit("："), "fields"))
    data = lines.groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "fields"))), lambda x: x["fields"]), "\n").alias("data"))
    plain = valued.groupBy(*KEYS).agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("row", "column", "value"))), lambda x: x["value"])), "；").alias("content"))
    every = shape.join(heads, KEYS, "left").join(data, KEYS, "left").join(plain, KEYS, "left")
    text = F.concat_ws(
        "\n", F.when(F.col("title").isNotNull(), F.concat(F.lit(TITLE), "title")), F.when(F.col("heads").isNotNull(), F.concat(F.lit(HEADERS + "\n"), "heads")),
        F.when(F.col("data").isNotNull(), F.concat(F.lit(DATA + "\n"), "data")).when(F.col("content").isNotNull(), F.concat(F.lit(CONTENT), "content")),
    )
    return every.select(*KEYS, "rows", "columns", "header_rows", "title", "reasons", (F.size("reasons") > 0).alias("complex"), text.alias("text"))


_COMMENT, _LINK, _TAG = re.compile(r"<!--.*?-->", re.DOTALL), re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), re.compile(r"<[^>]+>")


def _canonical(value: str | None) -> str:
    """Visible text of a cell without markup, link targets and white space."""
    text = unescape(_TAG.sub(" ", _LINK.sub(r"\1", _COMMENT.sub(" ", value or ""))))
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


def canonical_matrix(rows: Column) -> Column:
    """A rectangular matrix of canonical cells; null where rows differ in length or nothing is in them."""

    @F.pandas_udf("array<array<string>>")
    def canonical(tables: pd.Series) -> pd.Series:
        def one(table):
            if table is None or not len(table) or len({len(r) for r in table}) != 1 or not len(table[0]):
                return None
            made = [[_canonical(x) for x in r] for r in table]
            return made if any(map(any, made)) else None

        return tables.map(one)

    return canonical(rows)
