"""Factor workbooks: classification by content, and the twelve logical tables of a factor sheet in long form.

Cells become rows of an array by a grouped map; blocks, headers, notes and merged leading cells are windows over one
sheet of one file; the gases of a row come from a join with a literal table of rules. Nothing loops over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sheet, templates, table names and headers as published in such workbooks.
HUB_SHEET = "Emission Factors Hub"
HUB_TEMPLATE = "EPA_GHG_EMISSION_FACTORS_HUB"
MODEL_TEMPLATE = "GHG_PRODUCT_UNCERTAINTY_TEMPLATE"
MODEL_SHEETS = ("Instruction", "Notes", "Info", "Calculations")
MODEL_COLUMNS = 82
TABLES = {
    1: "stationary_combustion", 2: "mobile_combustion_co2", 3: "mobile_onroad_gasoline", 4: "mobile_onroad_alternative", 5: "mobile_nonroad", 6: "electricity",
    7: "steam_heat", 8: "scope3_transportation", 9: "scope3_waste", 10: "scope3_travel_commuting", 11: "gwp", 12: "blended_refrigerant_gwp",
}
HEADERS = {
    1: ["fuel type"], 2: ["fuel type"], 3: ["vehicle type"], 4: ["vehicle type"], 5: ["vehicle type"], 6: ["egrid subregion"], 7: ["co2 factor"], 8: ["vehicle type"],
    9: ["material"], 10: ["vehicle type"], 11: ["industrial designation", "gas"], 12: ["ashrae"],
}
HEADER_WITHIN, NOTE_CHARS = 7, 16_000
COLUMNS = (
    "edition_year int, table_code string, scope string, category string, activity_name string, fuel_type string, vehicle_type string, material_type string, treatment_method string, "
    "region_code string, region_name string, model_year_raw string, gas string, factor_value decimal(38,12), numerator_unit string, denominator_unit string, factor_basis string, "
    "lifecycle_boundary string, applicability string, source_sheet string, source_row int, source_file string, source_note string"
)

_KG, _G, _LB = ("kg CO2", "g CH4", "g N2O"), ("g CH4", "g N2O"), ("lb CO2", "lb CH4", "lb N2O")
_THREE, _TWO = ("CO2", "CH4", "N2O"), ("CH4", "N2O")


def _rules() -> list[tuple]:
    """(table, column, gas, numerator, denominator, basis, boundary, scope); a denominator of None is worked out from the row."""

    def run(table, first, gases, units, *rest):
        return [(table, first + k, g, u, *rest) for k, (g, u) in enumerate(zip(gases, units, strict=True))]

    burnt, driven, made = "COMBUSTION_ONLY", "TANK_TO_WHEEL", "GENERATION_COMBUSTION_ONLY"
    return [
        (1, 2, "HEAT_CONTENT", "mmBtu", None, "HHV", burnt, None),
        *run(1, 3, _THREE, _KG, "mmBtu", "HHV", burnt, None),
        *run(1, 6, _THREE, _KG, None, "HHV", burnt, None),
        (2, 2, "CO2", "kg CO2", None, None, driven, None),
        *run(3, 3, _TWO, _G, "vehicle-mile", None, driven, None),
        *run(4, 4, _TWO, _G, "vehicle-mile", None, driven, None),
        *run(5, 3, _TWO, _G, "gallon", None, driven, None),
        *run(6, 3, _THREE, _LB, "MWh", "TOTAL_OUTPUT", made, None),
        *run(6, 6, _THREE, _LB, "MWh", "NON_BASELOAD", made, None),
        (6, 9, "GRID_LOSS", "ratio", "electricity", "T_AND_D_LOSS", None, None),
        *run(7, 2, _THREE, _KG, "mmBtu", "PURCHASED_STEAM_HEAT", burnt, None),
        *(r for t in (8, 10) for r in run(t, 2, _THREE, _KG, None, "DISTANCE_BASED", driven, "SCOPE_3")),
        *((9, c, "CO2E", "metric ton CO2e", "short ton material", "WASTE_TYPE_SPECIFIC", None, "SCOPE_3") for c in range(2, 8)),
        (11, 2, None, "kg CO2e", None, "100_YEAR_GWP", None, None),
        (12, 2, None, "kg CO2e", None, "100_YEAR_GWP", None, None),
    ]


def decimal_cell(text: Column) -> Column:
    """A cell as decimal(38,12); blanks, NA, N/A and - are null, as is what isn't a number. Leading comparison marks go."""
    bare = F.regexp_replace(F.regexp_replace(text, "^[<>~≈≥≤]+\\s*", ""), ",", "")
    return F.when(F.upper(text).isin("", "NA", "N/A", "-"), None).otherwise(bare.try_cast("decimal(38,12)"))


def folded(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "))


def edition_year(file: Column) -> Column:
    """The four-digit year of this century in a file's name."""
    return F.regexp_extract(F.element_at(F.split(file, "/"), -1), "(?<!\\d)(20\\d{2})(?!\\d)", 1).try_cast("int")


def profiles(cells: DataFrame) -> DataFrame:
    """One row a workbook: template, version, sheets, formulas, tables, and why it isn't accepted (null if it is)."""
    number = F.regexp_extract(folded(F.col("value")), "(?i)^Table\\s+(\\d+)$", 1).try_cast("int")
    hub = F.col("sheet") == HUB_SHEET
    per_file = cells.groupBy("file").agg(
        F.max("problem").alias("problem"),
        F.array_sort(F.collect_set("sheet")).alias("sheet_names"),  # sheets of one file
        F.count_if(F.col("formula")).alias("formula_count"),
        F.array_sort(F.collect_set(F.when(hub, number))).alias("tables"),  # numbers of one file
        F.coalesce(F.max(F.when(F.col("sheet") == "Calculations", F.col("col"))), F.lit(0)).alias("width"),
    )
    has_hub = F.array_contains("sheet_names", HUB_SHEET)
    is_model = F.size(F.array_except(F.array(*map(F.lit, MODEL_SHEETS)), "sheet_names")) == 0
    year = edition_year(F.col("file"))
    problem = F.coalesce(
        F.when(F.col("problem").isNotNull(), "UNREADABLE"),
        F.when(has_hub & (F.col("tables") != F.array(*map(F.lit, TABLES))), "TABLES_DIFFER"),
        F.when(has_hub & year.isNull(), "NO_EDITION_YEAR"),
        F.when(~has_hub & is_model & (F.col("width") < MODEL_COLUMNS), "COLUMNS_MISSING"),
        F.when(~has_hub & ~is_model, "UNKNOWN_TEMPLATE"),
    )
    template = F.when(has_hub, HUB_TEMPLATE).when(is_model, MODEL_TEMPLATE)
    version = F.when(has_hub, year.cast("string")).when(is_model, "v1")
    return per_file.select("file", template.alias("template_code"), version.alias("version_label"), F.when(has_hub, year).alias("edition_year"), "sheet_names", F.when(has_hub, F.size("tables")).when(is_model, 4).otherwise(0).alias("table_count"), "formula_count", problem.alias("problem"))


def _native_unit(category: Column) -> Column:
    text = F.lower(category)
    return F.when(text.contains("gas"), "scf").when(text.contains("liquid") | text.contains("petroleum"), "gallon").otherwise("short ton")


def block_rows(cells: DataFrame) -> DataFrame:
    """Rows of the factor sheet below their block's header: file, row, number, c (cells from the leftmost column), heads, note."""
    hub = cells.where(F.col("sheet") == HUB_SHEET).select("file", "row", "col", folded(F.col("value")).alias("text")).where("text <> ''")
    placed = hub.withColumn("at", F.col("col") - F.min("col").over(Window.partitionBy("file")))
    held = placed.groupBy("file", "row").agg(F.map_from_entries(F.collect_list(F.struct("at", "text"))).alias("held"))  # one row of a sheet
    width = F.greatest(F.array_max(F.map_keys("held")), F.lit(11))
    rows = held.select("file", "row", F.transform(F.sequence(F.lit(0), width), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(""))).alias("c"))

    down = Window.partitionBy("file").orderBy("row")
    marker = F.regexp_extract(F.col("c")[0], "(?i)^Table\\s+(\\d+)$", 1).try_cast("int")
    rows = rows.withColumn("marker", marker).withColumn("number", F.last("marker", ignorenulls=True).over(down)).where("number is not null")
    block = Window.partitionBy("file", "number")
    needles = F.create_map(*(x for n, v in HEADERS.items() for x in (F.lit(n), F.array(*map(F.lit, v)))))
    heads = F.exists("c", lambda x: F.exists(needles[F.col("number")], lambda n: F.lower(x).startswith(n)))
    start = F.max(F.when(F.col("marker").isNotNull(), F.col("row"))).over(block)
    rows = rows.withColumn("start", start).withColumn("head", F.min(F.when(heads & (F.col("row") > F.col("start")) & (F.col("row") <= F.col("start") + HEADER_WITHIN), F.col("row"))).over(block))
    rows = rows.withColumn("heads", F.max(F.when(F.col("row") == F.col("head"), F.col("c"))).over(block))
    rows = rows.where(F.col("row") > F.col("head") + F.col("number").isin(1, 6).cast("int"))

    filled = F.filter("c", lambda x: x != "")
    rows = rows.withColumn("line", F.concat_ws(" ", filled))
    noted = F.min(F.when(F.col("line").rlike("^(Source:|Notes:|Note:|https?://)"), F.col("row"))).over(block)
    ends = F.min(F.when(F.col("c")[1].rlike("^(Source:|Notes:|Note:)"), F.col("row"))).over(block)
    rows = rows.withColumns({"noted": noted, "ends": ends})
    notes = rows.where("row >= noted").groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))  # notes of one block
    notes = notes.select("file", "number", F.substring(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 1, NOTE_CHARS).alias("note"))
    return rows.where("ends is null or row < ends").select("file", "row", "number", "c", "heads").join(notes, ["file", "number"], "left")


def factors(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """Every factor of the twelve tables, one row for each (row, gas, basis); cells without a number give no row, except that waste
    methods that don't apply are kept as such. Columns are those of COLUMNS."""
    rows = block_rows(cells)
    c = [F.col("c")[k] for k in range(10)]
    is_ = lambda *n: F.col("number").isin(*n)
    down = Window.partitionBy("file", "number").orderBy("row")
    numbers = F.exists(F.slice("c", 3, 7), lambda x: decimal_cell(x).isNotNull())
    rows = rows.withColumn("any_number", numbers)

    def carried(text: Column) -> Column:
        return F.last(F.when(text != "", text), ignorenulls=True).over(down)

    category = F.last(F.when(is_(1) & (c[1] != "") & ~F.col("any_number"), c[1]), ignorenulls=True).over(down)
    rows = rows.withColumns({"category": category, "vehicle": F.when(is_(3, 4, 5), carried(c[1])), "fuel": F.when(is_(4), carried(c[2])).when(is_(5), c[2])})
    lead = (c[1] != "") & (~is_(1) | F.col("any_number"))
    whole = (
        F.when(is_(3), F.col("vehicle").isNotNull() & (c[2] != ""))
        .when(is_(4), F.col("vehicle").isNotNull() & F.col("fuel").isNotNull() & (c[3] != ""))
        .when(is_(5), F.col("vehicle").isNotNull() & (c[2] != ""))
        .when(is_(6), lead & (c[2] != ""))
        .otherwise(lead)
    )
    rules = spark.createDataFrame(_rules(), "number int, at int, gas string, numerator string, denominator string, basis string, boundary string, scope string")
    cell = F.element_at("c", F.col("at") + 1)
    second = is_(11) & decimal_cell(c[3]).isNotNull()
    value = F.when(second, decimal_cell(c[3])).otherwise(decimal_cell(cell))
    gas = F.when(second, c[2]).when(is_(11, 12), c[1]).otherwise(F.col("gas"))
    method = F.when(is_(9), F.try_element_at("heads", F.col("at") + 1))
    long = rows.where(whole).join(F.broadcast(rules), "number").withColumns({"value": value, "gas": gas, "method": method})  # the rules are a literal
    long = long.where((F.col("value").isNotNull() & (F.col("gas") != "") & ~is_(9)) | (is_(9) & (F.coalesce("method", F.lit("")) != "") & (cell != "")))
    activity = F.when(is_(3, 4, 5), F.col("vehicle")).when(is_(6), c[2]).otherwise(c[1])
    denominator = (
        F.when(F.col("denominator").isNotNull(), F.col("denominator"))
        .when(is_(1), _native_unit(F.coalesce("category", F.lit(""))))
        .when(is_(2), c[3])
        .when(is_(8, 10), c[5])
        .otherwise(F.concat(F.lit("kg "), "gas"))
    )
    out = {
        "edition_year": edition_year(F.col("file")),
        "table_code": F.create_map(*(F.lit(x) for pair in TABLES.items() for x in pair))[F.col("number")],
        "scope": F.col("scope"),
        "category": F.when(is_(1), F.col("category")).when(is_(12) & (c[3] != ""), c[3]),
        "activity_name": activity,
        "fuel_type": F.when(is_(1, 2), c[1]).when(is_(4, 5), F.col("fuel")),
        "vehicle_type": F.when(is_(3, 4, 5), F.col("vehicle")).when(is_(8, 10), c[1]),
        "material_type": F.when(is_(9), c[1]),
        "treatment_method": F.col("method"),
        "region_code": F.when(is_(6), c[1]),
        "region_name": F.when(is_(6), c[2]),
        "model_year_raw": F.when(is_(3), c[2]).when(is_(4), c[3]),
        "gas": F.col("gas"),
        "factor_value": F.col("value"),
        "numerator_unit": F.col("numerator"),
        "denominator_unit": denominator,
        "factor_basis": F.when(is_(11) & c[2].startswith(">"), "100_YEAR_GWP_LOWER_BOUND").otherwise(F.col("basis")),
        "lifecycle_boundary": F.col("boundary"),
        "applicability": F.when(F.col("value").isNull(), "NOT_APPLICABLE").otherwise("AVAILABLE"),
        "source_sheet": F.lit(HUB_SHEET),
        "source_row": F.col("row"),
        "source_file": F.col("file"),
        "source_note": F.when(F.col("note") != "", F.col("note")),
    }
    return long.select(*(v.alias(k) for k, v in out.items()))
