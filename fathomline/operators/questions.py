"""Questions to factor queries: what a question names by aliases, years, gases and key words, and the factors that answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that make a question one about factors, gases in the order they are tried, key words of tables in order.
FACTOR_WORDS = ("排放因子", "因子", "gwp", "emission factor")
GASES = ("CO2E", "CO2", "CH4", "N2O", "HFC", "PFC", "SF6")
TABLES = (
    (("电力", "egrid"), "electricity"), (("废弃物", "废物"), "scope3_waste"), (("通勤", "商务旅行"), "scope3_travel_commuting"), (("运输", "物流"), "scope3_transportation"),
    (("制冷剂",), "blended_refrigerant_gwp"), (("固定燃烧", "燃料", "无烟煤", "烟煤", "天然气"), "stationary_combustion"), (("gwp",), "gwp"),
)
WITHOUT_ACTIVITY = ("gwp", "electricity")
YEAR = "(?<![0-9])(20[0-9]{2})(?![0-9])"
#: First characters of a term by which questions and terms meet.
KEY = 4


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def named(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id, field_name and canonical_value: for each field, what the longest alias inside the question stands for (ties by term, then value).

    ``aliases``: term, field_name, canonical_value; of any number. Both sides meet by a term's first characters, which
    a question has at one of its places; whether the whole term is inside is looked up after that.
    """
    text = F.lower("question")
    terms = aliases.select(F.lower("term").alias("term"), "field_name", "canonical_value").where(F.length("term") > 0).withColumn("key", F.left("term", F.lit(KEY)))
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    keys = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(KEY)), lambda n: F.substring(text, i, n)))))
    asked = questions.select("question_id", text.alias("text"))
    hits = questions.select("question_id", F.explode(keys).alias("key")).join(terms, "key").join(asked, "question_id").where(F.expr("contains(text, term)"))
    best = Window.partitionBy("question_id", "field_name").orderBy(F.desc(F.length("term")), "term", "canonical_value")
    return hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("question_id", "field_name", "canonical_value")


def parsed(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id, edition_year, table_code, activity and gas of the questions that ask for factors (question_id, question).

    One without an activity counts only where its table needs none.
    """
    text = F.lower("question")
    about = questions.where(_any(text, FACTOR_WORDS))
    found = named(about, aliases).where(F.col("field_name").isin("activity_name", "gas")).groupBy("question_id").pivot("field_name", ["activity_name", "gas"]).agg(F.first("canonical_value"))
    gas, code = F.col("gas"), F.lit(None).cast("string")
    for g in GASES:
        gas = F.coalesce(gas, F.when(text.contains(g.lower()), g))
    for words, name in TABLES:
        code = F.coalesce(code, F.when(_any(text, words), name))
    year = F.nullif(F.regexp_extract("question", YEAR, 1), F.lit("")).cast("int")
    rows = about.join(found, "question_id", "left").select("question_id", year.alias("edition_year"), code.alias("table_code"), F.col("activity_name").alias("activity"), gas.alias("gas"))
    return rows.where(F.col("activity").isNotNull() | F.coalesce(F.col("table_code").isin(*WITHOUT_ACTIVITY), F.lit(False)))


def answers(asked: DataFrame, factors: DataFrame, limit: int = 20) -> DataFrame:
    """``factors`` (activity_name, table_code, gas, edition_year, source_row and more) that fit each parsed question, the first ``limit`` in order.

    A question without a year, table or gas takes any. Questions with an activity meet factors by it, the others by their table.
    """
    q = asked.select("question_id", *(F.col(c).alias(f"_{c}") for c in ("edition_year", "table_code", "activity", "gas")))

    def free(wanted: str, have: str) -> Column:
        return F.col(wanted).isNull() | (F.col(wanted) == F.col(have))

    by_activity = q.where("_activity is not null").join(factors, F.col("_activity") == F.col("activity_name")).where(free("_table_code", "table_code"))
    by_table = q.where("_activity is null").join(factors, F.col("_table_code") == F.col("table_code"))
    both = by_activity.unionByName(by_table).where(free("_gas", "gas") & free("_edition_year", "edition_year"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc_nulls_last("edition_year"), "table_code", "activity_name", "source_row"))
    return both.withColumn("place", place).where(F.col("place") <= limit).drop("_edition_year", "_table_code", "_activity", "_gas")
