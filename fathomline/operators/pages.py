"""Pages of documents: printed page numbers, and tables that go on over pages. Both decide by windows over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of printed page numbers, lines of a page's edge that are looked at, marks of continued tables.
EXPLICIT = "(?i)^(?:第\\s*([0-9]{1,4})\\s*页(?:\\s*共\\s*[0-9]{1,4}\\s*页)?|(?:page\\s*)?([0-9]{1,4})\\s*(?:/|of)\\s*[0-9]{1,4})$"
BARE = "^(?:[-—–]\\s*)?([0-9]{1,4})(?:\\s*[-—–])?$"
FENCE = "^(```|~~~)"
EDGE_LINES = 2
CONTINUED = "(?:\\(续\\)|（续）|续表|表续)$"


def page_numbers(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, line, content) with edge, printed and removed: which lines are visible page numbers.

    Only the first and last two lines of a page count, blank ones and fenced code apart. A full form ("page 3 of 9") always goes;
    a bare number goes where it equals its page, or where some other page has one at the same edge that is as far from
    its page's number.
    """
    text = F.trim(F.regexp_replace("content", "^\\s+|\\s+$", ""))
    page = Window.partitionBy("doc_id", "page").orderBy("line")
    fence = text.rlike(FENCE)
    rows = lines.withColumns({"_text": text, "_inside": F.sum(fence.cast("int")).over(page) % 2 == 1, "_fence": fence})
    counts = (F.col("_text") != "") & ~F.col("_inside") & ~F.col("_fence")
    rows = rows.withColumn("_n", F.when(counts, 1).otherwise(0))
    first, last = F.sum("_n").over(page), F.sum("_n").over(Window.partitionBy("doc_id", "page").orderBy(F.desc("line")))
    edge = F.when(counts & (last <= EDGE_LINES), "tail").when(counts & (first <= EDGE_LINES), "head")
    full = F.nullif(F.coalesce(F.nullif(F.regexp_extract("_text", EXPLICIT, 1), F.lit("")), F.regexp_extract("_text", EXPLICIT, 2)), F.lit(""))
    bare = F.nullif(F.regexp_extract("_text", BARE, 1), F.lit(""))
    rows = rows.withColumns({"edge": edge, "_full": full, "_bare": bare})
    printed = F.when(F.col("edge").isNotNull(), F.coalesce("_full", "_bare").cast("int"))
    rows = rows.withColumn("printed", printed)
    votes = F.when(F.col("_full").isNull() & F.col("printed").isNotNull(), F.col("page"))
    alike = Window.partitionBy("doc_id", "edge", F.col("printed") - F.col("page"))
    stable = F.min(votes).over(alike) < F.max(votes).over(alike)  # at least two pages
    gone = F.col("printed").isNotNull() & (F.col("_full").isNotNull() | (F.col("printed") == F.col("page")) | F.coalesce(stable, F.lit(False)))
    return rows.withColumn("removed", gone).drop("_text", "_inside", "_fence", "_n", "_full", "_bare")


def without_page_numbers(lines: DataFrame) -> DataFrame:
    """``lines`` with page numbers emptied, so that line numbers stay."""
    return page_numbers(lines).withColumn("content", F.when(F.col("removed"), "").otherwise(F.col("content"))).drop("edge", "printed", "removed")


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", ""))


def table_chains(tables: DataFrame) -> DataFrame:
    """``tables`` with chain, reason and row_offset: which tables continue the one before them.

    A table: doc_id, table_id, place (order in the document), first_page, last_page, columns, header (an array of levels for
    each column), header_rows, rows, title. It goes on where it begins on the page after the other's last, has as many
    columns and the same header, and the same title as the chain (or one that says it is continued). A chain's
    title is that of its first table, or the first one there is behind it. ``row_offset``: where its rows stand in the
    merged table, whose header is written once.

    Pages, columns and header only depend on the table before, so they cut a document into islands. Inside an island a table
    whose title isn't marked as continued either repeats the chain's title or begins a chain, so that it leads the
    marked ones behind it: the title to compare with is the last leader's, or that of the first marked one where the leader has none.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("place")
    header = F.transform("header", lambda levels: F.transform(levels, _plain))
    named = F.exists("header", lambda levels: F.exists(levels, lambda x: F.length(_plain(x)) > 0))
    spaceless = F.regexp_replace(F.coalesce("title", F.lit("")), "\\s+", "")
    marked = spaceless.contains("续表") | spaceless.contains("（续）") | spaceless.endswith("(续)")
    norm = F.regexp_replace(F.regexp_replace(_plain(F.col("title")), CONTINUED, ""), "[^\\p{L}\\p{N}]+", "")
    rows = tables.withColumns({"_header": F.when(named, header), "_marked": marked, "_title": F.nullif(F.col("title"), F.lit("")), "_norm": norm})
    gap = F.when(F.lag("place").over(by_doc).isNull(), "FIRST").when(F.lag("last_page").over(by_doc).isNull() | F.col("first_page").isNull(), "MISSING_PAGE_PROVENANCE")
    gap = gap.when(F.col("first_page") != F.lag("last_page").over(by_doc) + 1, "NON_CONSECUTIVE_PAGES")
    gap = gap.when((F.col("columns") != F.lag("columns").over(by_doc)) | (F.col("columns") == 0), "COLUMN_COUNT_MISMATCH")
    gap = gap.when(~F.coalesce(F.col("_header") == F.lag("_header").over(by_doc), F.lit(False)), "HEADER_MISMATCH")
    rows = rows.withColumn("_gap", gap)
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    leads = F.col("_gap").isNotNull() | ~F.col("_marked")
    rows = rows.withColumns({"_island": F.sum(F.col("_gap").isNotNull().cast("int")).over(so_far), "_led": F.sum(leads.cast("int")).over(so_far), "_leads": leads})
    # the title of each leader's group: its own or the first behind it
    group = Window.partitionBy("doc_id", "_led").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_group_norm", F.first(F.when(F.col("_title").isNotNull(), F.col("_norm")), ignorenulls=True).over(group))
    same = (F.lag("_group_norm").over(by_doc) == F.col("_norm")) & (F.col("_norm") != "") & F.col("_title").isNotNull()
    merged = F.col("_gap").isNull() & (F.col("_marked") | F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("_merged", merged)
    reason = F.when(F.col("_merged") & F.col("_marked"), "CONTINUATION_TITLE").when(F.col("_merged"), "TABLE_TITLE_MATCH").otherwise(F.coalesce("_gap", F.lit("INSUFFICIENT_CONTINUATION_EVIDENCE")))
    rows = rows.withColumns({"chain": F.sum((~F.col("_merged")).cast("int")).over(so_far), "reason": reason})
    inside = Window.partitionBy("doc_id", "chain").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("rows") - F.when(F.col("_merged"), F.least("rows", "header_rows")).otherwise(0)
    rows = rows.withColumn("_own", own).withColumn("row_offset", F.coalesce(F.sum("_own").over(inside), F.lit(0)))
    return rows.select(*tables.columns, "chain", "reason", "row_offset")


def merged_tables(chained: DataFrame) -> DataFrame:
    """One row for each chain: doc_id, chain, table_id (its first part's), parts in order, first_page, last_page, rows and title."""
    part = F.sort_array(F.collect_list(F.struct("place", "table_id", "title", "rows", "header_rows", "first_page", "last_page")))  # the parts of one table
    found = chained.groupBy("doc_id", "chain").agg(part.alias("p"))
    later = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    added = F.aggregate(later, F.lit(0).cast("long"), lambda n, x: n + x["rows"] - F.least(x["rows"], x["header_rows"]))
    titles = F.filter(F.transform("p", lambda x: x["title"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return found.select("doc_id", "chain", F.col("p")[0]["table_id"].alias("table_id"), F.transform("p", lambda x: x["table_id"]).alias("parts"), F.col("p")[0]["first_page"].alias("first_page"), F.element_at("p", -1)["last_page"].alias("last_page"), (F.col("p")[0]["rows"] + added).alias("rows"), F.get(titles, F.lit(0)).alias("title"))


# The mark in front of a page's recovered text, and the prefix of what a model saw.
RECOVERED, SEEN = "<!-- PAGE_FALLBACK:%s -->", "图片说明："


def merge_recovered(pages: DataFrame, recovered: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page, markdown) trimmed and with the text ``recovered`` (doc_id, page, method, text) behind their own, and ``added``.

    Text that the page holds already isn't added again; a picture's description says that it is one. ``added`` is null for pages without
    recovered text, which keep theirs. A page has at most one recovered text; a text for no page is left out.
    """
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^(?U:\\s)+|(?U:\\s)+$", "")
    more = recovered.select("doc_id", "page", "method", strip(F.col("text")).alias("_more")).where("_more <> ''")
    both = pages.join(more, ["doc_id", "page"], "left").withColumn("markdown", strip(F.col("markdown")))
    said = F.when((F.lower("method") == "vision") & ~F.col("_more").startswith(SEEN), F.concat(F.lit(SEEN), "_more")).otherwise(F.col("_more"))
    mark = F.replace(F.lit(RECOVERED), F.lit("%s"), F.upper("method"))
    fresh = ~F.contains(F.col("markdown"), F.col("_more"))
    text = F.when(F.coalesce(fresh, F.lit(False)), F.array_join(F.filter(F.array("markdown", mark, said), lambda t: t != ""), "\n\n")).otherwise(F.col("markdown"))
    return both.select(*[c for c in pages.columns if c != "markdown"], text.alias("markdown"), fresh.alias("added"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, pages and text: a document's pages in order, parted by an empty line; pages without text leave no gap."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda p: p["markdown"])  # the pages of one document
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.filter(listed, lambda t: t != ""), "\n\n").alias("text"))
