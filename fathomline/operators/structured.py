"""Structured lookup: catalogue, typed predicates over factor tables, cell cleaning, unpivoting and decimal formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a lookup's row count.
LEAST_ROWS, MOST_ROWS = 1, 200


def all_of(predicates: list[Column]) -> Column:
    """AND of any number of predicates; none means true."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_like(columns: list[str], pattern: str) -> Column:
    """Case-insensitive LIKE over several columns; the caller's % and _ stay wildcards, null columns count as empty."""
    return reduce(lambda a, b: a | b, (F.lower(F.coalesce(c, F.lit(""))).like(pattern.lower()) for c in columns))


def factor_lookup(factors: DataFrame, *, year: int | None = None, table: str | None = None, gas: str | None = None, activity: str | None = None, limit: int = 50) -> DataFrame:
    """Rows that meet every given predicate, newest edition first; ``limit`` is clamped to [1, 200]."""
    predicates = []
    if year is not None:
        predicates.append(F.col("edition_year") == year)
    if table is not None:
        predicates.append(F.col("table_code") == table)
    if gas is not None:
        predicates.append(F.lower("gas") == gas.lower())
    if activity:
        predicates.append(any_like(["activity_name", "fuel_type"], f"%{activity}%"))
    order = [F.desc_nulls_last("edition_year"), *(F.asc_nulls_last(c) for c in ("table_code", "activity_name", "gas", "source_row"))]
    found = factors.where(all_of(predicates)).orderBy(*order).limit(max(LEAST_ROWS, min(MOST_ROWS, limit)))
    return found.withColumn("factor_value", F.col("factor_value").cast("decimal(20,6)").cast("string"))


def first_factors(questions: DataFrame, factors: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` factors of each question among those equal in ``by``, with ``place``.

    The columns ``by`` alone decide what a question gets, so that ``factors`` are cut to ``k`` of each of their values first, and
    questions meet at most that many rows.
    """
    order = [F.asc_nulls_last(c) for c in ("table_code", "activity_name", "source_row")]
    few = factors.select(*by, "table_code", "activity_name", "source_row")
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return questions.join(few, by).withColumn("place", place).where(F.col("place") <= k)


def catalogue(factors: DataFrame) -> DataFrame:
    """The logical tables: one row for each (edition year, table), with its rows and activities."""
    return factors.groupBy("edition_year", "table_code").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("activity_name").alias("n_activities"))


def visible_tables(tables: DataFrame, editions: DataFrame) -> DataFrame:
    """Catalogue rows of the newest edition of each table, or of the editions asked for."""
    return tables.join(editions, ["edition_year", "table_code"], "left_semi")


def number_cell(cell: Column) -> Column:
    """A numeric table cell: NA, N/A and - are null, comparison marks in front and thousands separators go; else null."""
    text = F.trim(cell)
    missing = F.upper(text).isin("", "NA", "N/A", "-")
    return F.when(missing, None).otherwise(F.regexp_replace(F.regexp_replace(text, "^[<>~≈≥≤]+\\s*", ""), ",", "").try_cast("double"))


def unpivot_gases(wide: DataFrame, ids: list[str], gases: list[str]) -> DataFrame:
    """Long form (gas, factor_value) of one column a gas; empty cells give no row."""
    return wide.unpivot(ids, gases, "gas", "factor_value").where("factor_value is not null")


def fill_down(rows: DataFrame, column: str, partition: list[str], order: list[str]) -> DataFrame:
    """Merged leading cells carried forward: the last value at or above each row."""
    above = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(above))


def native_unit(category: Column) -> Column:
    """The unit a fuel's category implies; gas is tested before liquid."""
    text = F.lower(category)
    return F.when(text.contains("gas"), "scf").when(text.contains("liquid") | text.contains("petroleum") | text.contains("oil"), "gallon").otherwise("short ton")


def decimal_divide(a: Column, b: Column, places: int = 6) -> Column:
    """a / b with ``places`` decimals, half to even; null where b is 0."""
    return F.bround(a.cast("decimal(20,6)") / F.nullif(b.cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)")), places)


def formula(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The report formulas over (a, b) by key: sum, quotient, scaled quotient, percentage and weighted sum, six decimals."""
    x, y = F.sum(F.col(a).cast("decimal(20,6)")), F.sum(F.col(b).cast("decimal(20,6)"))
    summed = rows.groupBy(*keys).agg(x.alias("sum_a"), y.alias("sum_b"), F.sum((F.col(a).cast("decimal(18,4)") * F.col(b).cast("decimal(18,4)")).cast("decimal(38,6)")).alias("weighted"))
    ratio = F.col("sum_a").cast("double") / F.nullif(F.col("sum_b").cast("double"), F.lit(0.0))
    return summed.select(*keys, F.col("sum_a").cast("double").alias("total"), F.round(ratio, 6).alias("quotient"), F.round(ratio * 1000, 6).alias("scaled"), F.round(ratio * 100, 6).alias("percentage"), F.col("weighted").cast("double").alias("weighted_sum"))


def newest_edition(versions: DataFrame, key: str, year: str, sequence: str) -> DataFrame:
    """The promoted version of each asset: highest year, later publication among equals; rows without a year never win."""
    order = F.struct(year, sequence)
    return versions.where(F.col(year).isNotNull()).groupBy(key).agg(F.max(order).alias("best")).select(key, F.col(f"best.{year}").alias(year), F.col(f"best.{sequence}").alias(sequence))


def insert_absent(existing: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those defaults whose key it lacks."""
    return existing.unionByName(defaults.join(existing, keys, "left_anti"))


def alias_matches(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The longest alias that occurs in each question (ties: the alias itself). ``aliases`` is a dictionary of proven small size.

    Question words and word pairs are joined with the aliases by equality, so that no question meets every alias.
    """
    words = F.split(F.lower("question"), "[^a-z0-9]+")
    grams = F.array_distinct(F.concat(words, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))))
    hits = questions.select("question_id", F.explode(grams).alias("alias")).join(aliases, "alias")
    best = Window.partitionBy("question_id").orderBy(F.desc(F.length("alias")), "alias")
    return hits.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
