"""Queries of office files and cursors. The tables hold no files, so that workbooks are made of them by a stated rule:
one workbook a region, with a block of electricity factors for its nations and fixed rows in the eleven other blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.functions import cursors
from fathomline.operators import assets
from fathomline.operators import workbook as op
from fathomline.sources import office
from fathomline.sources.tables import CHUNKS_SQL, chunks, table


def hub_sheet(regions: list[tuple[str, str, float]]) -> list[list]:
    """A factor sheet: twelve blocks, an empty column at the left; ``regions`` (code, name, first factor) fill block 6."""
    # The titles and columns of the twelve tables, and a row or two of each.
    gases = ["CO2 Factor", "CH4 Factor", "N2O Factor"]
    bodies = {
        1: [["Fuel Type", "Heat Content (HHV)", *gases, *gases], [None, "mmBtu per short ton"], ["Coal and Coke"], ["Anthracite", 25.09, 103.69, 11, 1.6, 2602, 276, 40]],
        2: [["Fuel Type", "kg CO2 per unit", "Unit"], ["Motor Gasoline", 8.78, "gallon"]],
        3: [["Vehicle Type", "Model Year", "CH4 Factor", "N2O Factor"], ["Passenger Cars", "2020", 0.1, 0.2]],
        4: [["Vehicle Type", "Fuel Type", "Model Year", "CH4 Factor", "N2O Factor"], ["Passenger Cars", "Diesel", "2020", 0.1, 0.2], [None, None, "2021", 0.3, "NA"], [None, "Biodiesel", "2021", "-", "<0.5"]],
        5: [["Vehicle Type", "Fuel Type", "CH4 Factor", "N2O Factor"], ["Ships", "Diesel", 0.1, 0.2]],
        6: [["eGRID Subregion Acronym", "eGRID Subregion Name", *gases, *gases, "Grid Gross Loss (%)"], [None, None, "lb/MWh"], *([c, n, v, 2, 3, 4, 5, 6, 0.04] for c, n, v in regions), ["Notes: by subregion"], ["second line"]],
        7: [[None, *gases], ["Steam and Heat", 1, 2, 3]],
        8: [["Vehicle Type", *gases, "Units"], ["Passenger Car", 1, 2, 3, "vehicle-mile"]],
        9: [["Material", "Recycled", "Landfilled", "Combusted", "Composted"], ["Aluminum", 1, 2, 3, "NA"]],
        10: [["Vehicle Type", *gases, "Units"], ["Bus", 1, 2, 3, "passenger-mile"]],
        11: [["Industrial Designation or Common Name", "Chemical Formula", "100-Year GWP"], ["Carbon dioxide", "CO2", 1], ["Old gas", ">5"]],
        12: [["ASHRAE #", "100-year GWP", "Blend Composition"], ["R-401A", "1,130", "53% HCFC-22"]],
    }
    return [row for n, body in bodies.items() for row in ([None, f"Table {n}", "title"], [], *([None, None, *r] for r in body))]


def workbooks(spark, sf):
    """path and content of one workbook for each region."""

    @F.pandas_udf("binary")
    def build(regions: pd.Series) -> pd.Series:
        return regions.map(lambda r: office.workbook({op.HUB_SHEET: hub_sheet([(x["code"], x["name"], x["first"]) for x in r])}))

    nation = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), (F.col("n_nationkey") + F.lit(0.5)).cast("double").alias("first")))).alias("r"))  # 25 nations
    return nation.select(F.concat(F.lit("hub-2024-"), "n_regionkey", F.lit(".xlsx")).alias("path"), build("r").alias("content"))


@query("workbook_profiles", "SELECT 'hub-2024-' || n_regionkey || '.xlsx' AS file, 'EPA_GHG_EMISSION_FACTORS_HUB' AS template_code, CAST(2024 AS INTEGER) AS edition_year, CAST(12 AS INTEGER) AS table_count, 0::BIGINT AS formula_count, CAST(NULL AS VARCHAR) AS problem FROM nation GROUP BY n_regionkey")
def workbook_profiles(spark, sf):
    return op.profiles(office.cells(workbooks(spark, sf))).select("file", "template_code", "edition_year", "table_count", "formula_count", "problem")


# The factors of the rows above.
FIXED = """
(VALUES ('stationary_combustion', 'Anthracite', 'HEAT_CONTENT', 25.09e0, 'short ton'), ('stationary_combustion', 'Anthracite', 'CO2', 103.69e0, 'mmBtu'), ('stationary_combustion', 'Anthracite', 'CH4', 11e0, 'mmBtu'),
  ('stationary_combustion', 'Anthracite', 'N2O', 1.6e0, 'mmBtu'), ('stationary_combustion', 'Anthracite', 'CO2', 2602e0, 'short ton'), ('stationary_combustion', 'Anthracite', 'CH4', 276e0, 'short ton'),
  ('stationary_combustion', 'Anthracite', 'N2O', 40e0, 'short ton'), ('mobile_combustion_co2', 'Motor Gasoline', 'CO2', 8.78e0, 'gallon'), ('mobile_onroad_gasoline', 'Passenger Cars', 'CH4', 0.1e0, 'vehicle-mile'),
  ('mobile_onroad_gasoline', 'Passenger Cars', 'N2O', 0.2e0, 'vehicle-mile'), ('mobile_onroad_alternative', 'Passenger Cars', 'CH4', 0.1e0, 'vehicle-mile'), ('mobile_onroad_alternative', 'Passenger Cars', 'N2O', 0.2e0, 'vehicle-mile'),
  ('mobile_onroad_alternative', 'Passenger Cars', 'CH4', 0.3e0, 'vehicle-mile'), ('mobile_onroad_alternative', 'Passenger Cars', 'N2O', 0.5e0, 'vehicle-mile'), ('mobile_nonroad', 'Ships', 'CH4', 0.1e0, 'gallon'), ('mobile_nonroad', 'Ships', 'N2O', 0.2e0, 'gallon'),
  ('steam_heat', 'Steam and Heat', 'CO2', 1e0, 'mmBtu'), ('steam_heat', 'Steam and Heat', 'CH4', 2e0, 'mmBtu'), ('steam_heat', 'Steam and Heat', 'N2O', 3e0, 'mmBtu'), ('scope3_transportation', 'Passenger Car', 'CO2', 1e0, 'vehicle-mile'),
  ('scope3_transportation', 'Passenger Car', 'CH4', 2e0, 'vehicle-mile'), ('scope3_transportation', 'Passenger Car', 'N2O', 3e0, 'vehicle-mile'), ('scope3_waste', 'Aluminum', 'CO2E', 1e0, 'short ton material'), ('scope3_waste', 'Aluminum', 'CO2E', 2e0, 'short ton material'),
  ('scope3_waste', 'Aluminum', 'CO2E', 3e0, 'short ton material'), ('scope3_waste', 'Aluminum', 'CO2E', NULL, 'short ton material'), ('scope3_travel_commuting', 'Bus', 'CO2', 1e0, 'passenger-mile'), ('scope3_travel_commuting', 'Bus', 'CH4', 2e0, 'passenger-mile'),
  ('scope3_travel_commuting', 'Bus', 'N2O', 3e0, 'passenger-mile'), ('gwp', 'Carbon dioxide', 'CO2', 1e0, 'kg CO2'), ('gwp', 'Old gas', 'Old gas', 5e0, 'kg Old gas'), ('blended_refrigerant_gwp', 'R-401A', 'R-401A', 1130e0, 'kg R-401A')
) AS fixed(table_code, activity_name, gas, factor_value, denominator_unit)
"""
GRID = "(VALUES ('CO2', NULL, 'MWh'), ('CH4', 2e0, 'MWh'), ('N2O', 3e0, 'MWh'), ('CO2', 4e0, 'MWh'), ('CH4', 5e0, 'MWh'), ('N2O', 6e0, 'MWh'), ('GRID_LOSS', 0.04e0, 'electricity')) AS grid(gas, given, denominator_unit)"


@query("workbook_factors", f"SELECT 'hub-2024-' || n_regionkey || '.xlsx' AS source_file, table_code, activity_name, gas, factor_value, denominator_unit FROM (SELECT DISTINCT n_regionkey FROM nation), {FIXED} "
       f"UNION ALL SELECT 'hub-2024-' || n_regionkey || '.xlsx', 'electricity', n_name, gas, coalesce(given, n_nationkey + 0.5e0), denominator_unit FROM nation, {GRID}")  # fmt: skip
def workbook_factors(spark, sf):
    found = op.factors(spark, office.cells(workbooks(spark, sf)))
    return found.select("source_file", "table_code", "activity_name", "gas", F.col("factor_value").cast("double").alias("factor_value"), "denominator_unit")


@query("scope_fingerprint", "SELECT l_orderkey, sha256('{\"dataset_ids\":[' || array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') || '],\"doc_ids\":' || CASE WHEN count(*) > 4 THEN 'null' ELSE '[' || array_to_string(list_sort(list_distinct(list(l_partkey))), ',') || ']' END || ',\"user_id\":' || l_orderkey || '}') AS fingerprint FROM lineitem GROUP BY l_orderkey")
def scope_fingerprint(spark, sf):
    """An order's lines as its datasets, its parts as its documents; orders of more than four lines see every document."""
    scope = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("sets"), F.collect_set("l_partkey").alias("docs"), F.count(F.lit(1)).alias("n"))  # the lines of one order
    return scope.select("l_orderkey", cursors.scope_fingerprint(F.col("l_orderkey"), F.col("sets"), F.when(F.col("n") <= 4, F.col("docs"))).alias("fingerprint"))


@query("signed_cursor", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'at ' || o_custkey WHEN 'F' THEN 'expired' ELSE 'signature' END AS outcome FROM orders")
def signed_cursor(spark, sf):
    """A cursor for every order, asked for in time, too late, or under another key, by the order's status."""

    @F.pandas_udf("string")
    def outcome(order: pd.Series, at: pd.Series, status: pd.Series) -> pd.Series:
        key, other = cursors.signing_key("one"), cursors.signing_key("two")

        def one(o: int, a: int, s: str) -> str:
            cursor = cursors.encode(key, "orders", {"order": o}, {"at": a}, 0)
            try:
                return f"at {cursors.decode(key if s in 'OF' else other, cursor, 'orders', {'order': o}, cursors.LIFETIME if s == 'F' else 1)['at']}"
            except cursors.CursorError as e:
                return str(e)

        return pd.Series([one(int(o), int(a), s) for o, a, s in zip(order, at, status, strict=True)])

    return table(spark, sf, "orders").select("o_orderkey", outcome("o_orderkey", "o_custkey", "o_orderstatus").alias("outcome"))


@query("import_tree")
def import_tree(spark, sf):
    """The folder of the tables themselves as a tree of files."""
    return office.file_tree(spark, sf, "*.parquet")


@query(
    "word_verdict",
    "SELECT l_orderkey, l_linenumber, retention, issues, CASE WHEN len(issues) = 0 THEN 'PASSED' ELSE 'CONTENT_VALIDATION_FAILED' END AS status FROM ("
    "SELECT l_orderkey, l_linenumber, round(kept, 6) AS retention, list_filter(["
    "CASE WHEN kept < 0.97 THEN 'WORD_TEXT_RETENTION_LOW' END, CASE WHEN l_linenumber > 5 THEN 'WORD_TABLE_COUNT_MISMATCH' END, "
    "CASE WHEN l_linenumber = 7 THEN 'WORD_TABLE_IR_FAILED' END, CASE WHEN l_quantity > 40 AND l_returnflag = 'R' THEN 'WORD_IMAGE_ASSETS_NOT_PERSISTED' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT *, CASE WHEN l_partkey > 0 THEN least(1e0, greatest(l_partkey - 5 * (l_linenumber // 4), 0) / l_partkey) ELSE 1e0 END AS kept FROM lineitem))",
)
def word_verdict(spark, sf):
    """Line items as parsed files: characters, tables and images by their part, number and quantity."""
    n, zero = F.col("l_linenumber"), F.lit(0)
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_chars"), (F.col("l_partkey") - 5 * F.floor(n / 4)).alias("output_chars"), zero.alias("source_formulas"), zero.alias("output_formulas"),
        n.alias("source_tables"), F.least(n, F.lit(5)).alias("output_tables"), zero.alias("source_nested_tables"), zero.alias("output_nested_tables"), F.when(n == 7, 1).alias("table_failures"),
        (F.col("l_quantity") > 40).cast("int").alias("source_images"), (F.col("l_quantity") > 40).cast("int").alias("output_images"), (F.col("l_returnflag") != "R").alias("images_stored"),
    )
    return assets.word_verdict(rows).select("l_orderkey", "l_linenumber", "retention", "issues", "status")


@query(
    "image_policy",
    f"WITH {CHUNKS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS occurrence, chunk_index + 1 AS page, 'img/' || chunk_index || '.png' AS source_ref, "
    "CASE length(content) % 3 WHEN 0 THEN 'chart' WHEN 1 THEN 'seal' ELSE 'unknown' END AS class, CASE WHEN length(content) % 3 = 1 THEN 'NOT_REQUIRED' WHEN length(content) < 12 THEN 'INVALID' WHEN length(content) < 60 THEN 'REQUIRED' ELSE 'COMPLETE' END AS status FROM chunks",
)
def image_policy(spark, sf):
    """Documents with an image below each line, classed by the line's length; short and long lines describe theirs."""
    lines = chunks(spark, sf).withColumn("n", F.length("content"))
    alt = F.when(F.col("n") % 3 == 0, "Chart of it").when(F.col("n") % 3 == 1, "SEAL").otherwise("it")
    piece = F.format_string("<!-- ODL_PAGE:%d -->\n![%s](img/%d.png)", F.col("chunk_index") + 1, alt, "chunk_index")
    texts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", piece.alias("t")))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))  # the lines of one document
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    described = lines.withColumn("occurrence", place).where("n < 12 or n >= 60").select("doc_id", "occurrence", (F.col("chunk_index") + 1).alias("source_page"), F.regexp_replace("content", "\\s", "_").alias("summary"))
    return assets.image_policy(assets.images(texts), described).select("doc_id", "occurrence", "page", "source_ref", "class", "status")


def paragraph_tables(spark, sf):
    """Every page's paragraphs as the rows of a table: every third page's with plain headers, the others' with headers over two rows and columns."""
    texts = F.regexp_extract_all(F.regexp_replace("html", "&[A-Za-z]+;", "+"), F.lit("<p>([^<|]+)"), 1)
    rows = F.transform(texts, lambda t, i: F.concat(F.lit("<tr><td>"), (i + 1).cast("string"), F.lit("</td><td>"), F.length(t).cast("string"), F.lit("</td><td>"), t, F.lit("</td></tr>")))
    plain = F.lit("<tr><th>no</th><th>chars</th><th>text</th></tr>")
    spanned = F.lit("<tr><th rowspan=2>no</th><th colspan=2>paragraph</th></tr><tr><th>chars</th><th>text</th></tr>")
    made = F.concat(F.lit("<table>"), F.when(F.col("page_id") % 3 == 0, plain).otherwise(spanned), F.array_join(rows, ""), F.lit("</table>"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), made.alias("text"))


@query(
    "table_texts",
    """WITH found AS (
  SELECT page_id AS doc_id, list_transform(regexp_extract_all(regexp_replace(html, '&[A-Za-z]+;', '+', 'g'), '<p>([^<|]+)', 1), lambda t: [CAST(length(t) AS VARCHAR), trim(regexp_replace(t, '\\s+', ' ', 'g'))]) AS ts FROM pages
), lines AS (
  SELECT doc_id, ts, list_transform(generate_series(1, len(ts)), lambda i: '- 行' || i || '：no：' || i || ' | chars：' || ts[i][1] || CASE WHEN ts[i][2] <> '' THEN ' | text：' || ts[i][2] ELSE '' END) AS ls FROM found
)
SELECT doc_id, 'table-001' AS table_id, CAST(len(ts) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS rows, 3 AS columns, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS header_rows, CASE WHEN doc_id % 3 = 0 THEN [] ELSE ['colspan', 'multi_header', 'rowspan'] END AS reasons, doc_id % 3 > 0 AS complex,
       sha256(CASE WHEN doc_id % 3 = 0 THEN '表头：' || chr(10) || '- no' || chr(10) || '- chars' || chr(10) || '- text' ELSE '表头：' || chr(10) || '- no' || chr(10) || '- paragraph：chars、text' END
       || CASE WHEN len(ls) > 0 THEN chr(10) || '数据：' || chr(10) || array_to_string(ls, chr(10)) ELSE CASE WHEN doc_id % 3 = 0 THEN chr(10) || '内容：no；chars；text' ELSE chr(10) || '内容：no；paragraph；chars；text' END END) AS text_hash FROM lines""",
)
def table_texts(spark, sf):
    """Retrieval texts of the tables of paragraphs: header groups, and a line for every row."""
    from fathomline.operators import grid

    found = grid.retrieval_texts(grid.html_cells(paragraph_tables(spark, sf)))
    return found.select("doc_id", "table_id", "rows", "columns", "header_rows", "reasons", "complex", F.sha2("text", 256).alias("text_hash"))
