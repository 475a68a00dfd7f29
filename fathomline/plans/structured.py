"""Queries of the structured side: factor tables, catalogue, formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.catalog import query
from fathomline.operators import structured as op
from fathomline.sources import sinks
from fathomline.sources.tables import FACTORS_SQL, chunks, CHUNKS_SQL, factors, table

COLUMNS = "edition_year, table_code, activity_name, fuel_type, gas, CAST(factor_value AS VARCHAR) AS factor_value, quantity, source_row"


@query("scan_parquet", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(sum(value) FILTER (WHERE value > 50), 2) AS total_high FROM events GROUP BY event_type")
def scan_parquet(spark, sf):
    high = F.sum(F.when(F.col("value") > 50, F.col("value")))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(high, 2).alias("total_high"))


@query("factor_catalog", f"WITH {FACTORS_SQL} SELECT edition_year, table_code, count(*) AS n_rows, count(DISTINCT activity_name) AS n_activities FROM factors GROUP BY ALL")
def factor_catalog(spark, sf):
    return op.catalogue(factors(spark, sf))


@query("factor_query", f"WITH {FACTORS_SQL} SELECT {COLUMNS} FROM factors WHERE lower(gas) = 'r' AND table_code = 'F' AND (lower(activity_name) LIKE '%brass%' OR lower(activity_name) LIKE '%eco%' OR lower(fuel_type) LIKE '%eco%') ORDER BY edition_year DESC NULLS LAST, table_code NULLS LAST, activity_name NULLS LAST, gas NULLS LAST, source_row LIMIT 100")
def factor_query(spark, sf):
    return op.factor_lookup(factors(spark, sf), table="F", gas="r", activity="eco", limit=100)


@query("multi_like", f"WITH {FACTORS_SQL} SELECT source_row, activity_name, fuel_type FROM factors WHERE lower(coalesce(activity_name, '')) LIKE '%#3%' OR lower(coalesce(fuel_type, '')) LIKE '%#3%' OR lower(coalesce(gas, '')) LIKE '%#3%'")
def multi_like(spark, sf):
    return factors(spark, sf).where(op.any_like(["activity_name", "fuel_type", "gas"], "%#3%")).select("source_row", "activity_name", "fuel_type")


@query("sink_roundtrip", "SELECT l_returnflag AS table_code, l_orderkey, l_linenumber, l_quantity FROM lineitem")
def sink_roundtrip(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("table_code"), "l_orderkey", "l_linenumber", "l_quantity")
    return sinks.roundtrip(rows, ["table_code"])


@query(
    "factor_unpivot",
    "SELECT o_custkey, gas, round(sum(v), 2) AS factor_value FROM (SELECT o_custkey, o_orderstatus AS gas, o_totalprice AS v FROM orders) WHERE gas IN ('F', 'O', 'P') GROUP BY o_custkey, gas HAVING sum(v) IS NOT NULL",
)
def factor_unpivot(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))
    return op.unpivot_gases(wide, ["o_custkey"], ["F", "O", "P"])


@query(
    "num_clean",
    "SELECT event_id, CASE WHEN upper(trim(cell)) IN ('', 'NA', 'N/A', '-') THEN NULL ELSE TRY_CAST(replace(regexp_replace(trim(cell), '^[<>~≈≥≤]+\\s*', ''), ',', '') AS DOUBLE) END AS number "
    "FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '<' || value WHEN 2 THEN ' 1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') WHEN 3 THEN '-' ELSE 'n=' || value END AS cell FROM events)",
)
def num_clean(spark, sf):
    n = F.col("event_id") % 5
    cell = F.when(n == 0, "N/A").when(n == 1, F.concat(F.lit("<"), F.col("value").cast("string"))).when(n == 2, F.concat(F.lit(" 1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))).when(n == 3, "-").otherwise(F.concat(F.lit("n="), F.col("value").cast("string")))
    return table(spark, sf, "events").select("event_id", op.number_cell(cell).alias("number"))


@query(
    "fill_forward",
    "SELECT event_id, user_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mark FROM (SELECT *, CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN event_type END AS mark FROM events)",
)
def fill_forward(spark, sf):
    mark = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 7 == 0), F.col("event_type"))
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", mark.alias("mark"))
    return op.fill_down(rows, "mark", ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "mark")


@query("native_unit", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'gas') THEN 'scf' WHEN contains(lower(p_name), 'liquid') OR contains(lower(p_name), 'petroleum') OR contains(lower(p_name), 'oil') THEN 'gallon' ELSE 'short ton' END AS unit FROM part")
def native_unit(spark, sf):
    return table(spark, sf, "part").select("p_partkey", op.native_unit(F.col("p_name")).alias("unit"))


FORMULA_SQL = f"""
WITH {FACTORS_SQL}, sums AS (
  SELECT edition_year, gas, CAST(sum(factor_value) AS DOUBLE) AS a, CAST(sum(quantity) AS DOUBLE) AS b,
         CAST(sum(CAST(CAST(factor_value AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(18,4)) AS DECIMAL(38,6))) AS DOUBLE) AS w FROM factors GROUP BY edition_year, gas
)
SELECT edition_year, gas, a AS total, round(a / nullif(b, 0), 6) AS quotient, round(a / nullif(b, 0) * 1000, 6) AS scaled, round(a / nullif(b, 0) * 100, 6) AS percentage, w AS weighted_sum FROM sums
"""


@query("formula_batch", FORMULA_SQL)
def formula_batch(spark, sf):
    return op.formula(factors(spark, sf), ["edition_year", "gas"], "factor_value", "quantity")


@query("formula_sum", f"WITH {FACTORS_SQL} SELECT table_code, CAST(sum(factor_value) AS DOUBLE) AS total FROM factors GROUP BY table_code")
def formula_sum(spark, sf):
    return factors(spark, sf).groupBy("table_code").agg(F.sum("factor_value").cast("double").alias("total"))


@query("formula_percent", f"WITH {FACTORS_SQL} SELECT table_code, round(100 * CAST(sum(CASE WHEN gas = 'R' THEN factor_value ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(factor_value) AS DOUBLE), 0), 6) AS percentage FROM factors GROUP BY table_code")
def formula_percent(spark, sf):
    part = F.sum(F.when(F.col("gas") == "R", F.col("factor_value")).otherwise(F.lit(0).cast("decimal(20,6)"))).cast("double")
    return factors(spark, sf).groupBy("table_code").agg(F.round(100 * part / F.nullif(F.sum("factor_value").cast("double"), F.lit(0.0)), 6).alias("percentage"))


@query("asset_promote", "SELECT o_custkey AS asset, max(yr) AS edition_year, max(o_orderkey) FILTER (WHERE yr = top) AS publish_seq FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS INTEGER) AS top FROM orders WHERE o_orderstatus <> 'P') GROUP BY o_custkey")
def asset_promote(spark, sf):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    versions = table(spark, sf, "orders").select(F.col("o_custkey").alias("asset"), year.alias("edition_year"), F.col("o_orderkey").alias("publish_seq"))
    return op.newest_edition(versions, "asset", "edition_year", "publish_seq")


@query("alias_seed", "SELECT n_name AS alias, 'seen' AS origin FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_name, 'default' FROM nation WHERE n_regionkey >= 2")
def alias_seed(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_name", "alias")
    have = nation.where("n_regionkey < 2").select("alias", F.lit("seen").alias("origin"))
    return op.insert_absent(have, nation.select("alias", F.lit("default").alias("origin")), ["alias"])


ALIAS_SQL = f"""
WITH aliases AS (
  SELECT lower(p_name) AS alias, min(p_type) AS activity FROM part GROUP BY 1 UNION SELECT 'the', 'ARTICLE' UNION SELECT 'of the', 'PHRASE' UNION SELECT 'and the', 'PHRASE'
), words AS (
  SELECT item_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, unnest(list_concat(w, list_transform(generate_series(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 1], ' ')))) AS alias FROM words
), hits AS (
  SELECT item_id, alias, activity, row_number() OVER (PARTITION BY item_id ORDER BY length(alias) DESC, alias) AS place FROM grams JOIN aliases USING (alias)
)
SELECT item_id AS question_id, alias, activity FROM hits WHERE place = 1
"""


def _aliases(spark, sf):
    part = table(spark, sf, "part").groupBy(F.lower("p_name").alias("alias")).agg(F.min("p_type").alias("activity"))
    return part.unionByName(spark.createDataFrame([("the", "ARTICLE"), ("of the", "PHRASE"), ("and the", "PHRASE")], "alias string, activity string"))


@query("nlq_alias", ALIAS_SQL)
def nlq_alias(spark, sf):
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return op.alias_matches(questions, _aliases(spark, sf))


@query("nlq_factor", f"WITH {FACTORS_SQL}, q AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 2 = 0 THEN 'R' ELSE 'A' END AS gas, CAST(1993 + c_custkey % 6 AS INTEGER) AS edition_year FROM customer WHERE c_custkey % 50 = 0), "
       "hits AS (SELECT question_id, f.source_row, row_number() OVER (PARTITION BY question_id ORDER BY f.table_code, f.activity_name, f.source_row) AS place FROM q JOIN factors f ON f.gas = q.gas AND f.edition_year = q.edition_year) SELECT question_id, source_row, CAST(place AS INTEGER) AS place FROM hits WHERE place <= 5")  # fmt: skip
def nlq_factor(spark, sf):
    """Each question's first five factors. Questions with the same gas and year have the same ones, so that every gas and year is cut to five before the join."""
    q = table(spark, sf, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("question_id"), F.when(F.col("c_custkey") % 2 == 0, "R").otherwise("A").alias("gas"), (1993 + F.col("c_custkey") % 6).cast("int").alias("edition_year"))
    return op.first_factors(q, factors(spark, sf), ["gas", "edition_year"], 5).select("question_id", "source_row", "place")


ASKED = """CASE item_id % 6 WHEN 1 THEN concat(text, ' emission factor 2021') WHEN 2 THEN concat('因子 20231 CO2 ', text) WHEN 3 THEN concat(text, ' GWP CH4 1999 2019') WHEN 4 THEN concat('emission factor 电力 ', text) WHEN 5 THEN concat(upper(text), ' 排放因子 运输') ELSE text END"""
NLQ_SQL = f"""
WITH {FACTORS_SQL}, aliases AS (
  SELECT lower(p_name) AS term, 'activity_name' AS field_name, min(p_type) AS canonical_value FROM part GROUP BY lower(p_name)
  UNION ALL VALUES ('the', 'activity_name', 'ECONOMY'), ('of the', 'activity_name', 'STANDARD'), ('una', 'activity_name', 'SMALL'), ('la', 'gas', 'R'), ('and the', 'gas', 'A'), ('der', 'gas', 'N')
), asked AS (
  SELECT item_id AS question_id, {ASKED} AS question, lower({ASKED}) AS t FROM benchmark
), hits AS (
  SELECT question_id, field_name, canonical_value, row_number() OVER (PARTITION BY question_id, field_name ORDER BY length(term) DESC, term, canonical_value) AS n FROM asked JOIN aliases ON contains(t, term)
), parsed AS (
  SELECT q.question_id, CAST(nullif(regexp_extract(question, '(?:^|[^0-9])(20[0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INTEGER) AS edition_year,
         CASE WHEN contains(t, '电力') THEN 'electricity' WHEN contains(t, '运输') THEN 'scope3_transportation' WHEN contains(t, 'gwp') THEN 'gwp' END AS table_code, a.canonical_value AS activity,
         coalesce(g.canonical_value, CASE WHEN contains(t, 'co2e') THEN 'CO2E' WHEN contains(t, 'co2') THEN 'CO2' WHEN contains(t, 'ch4') THEN 'CH4' END) AS gas
  FROM asked q LEFT JOIN hits a ON a.question_id = q.question_id AND a.field_name = 'activity_name' AND a.n = 1 LEFT JOIN hits g ON g.question_id = q.question_id AND g.field_name = 'gas' AND g.n = 1
  WHERE contains(t, '因子') OR contains(t, 'gwp') OR contains(t, 'emission factor')
), good AS (
  SELECT * FROM parsed WHERE activity IS NOT NULL OR table_code IN ('gwp', 'electricity')
)
"""


def asked_factors(spark, sf):
    """Every benchmark text as a question, with what makes some of them ask for factors added by a stated rule."""
    from fathomline.operators import questions

    words = [("the", "activity_name", "ECONOMY"), ("of the", "activity_name", "STANDARD"), ("una", "activity_name", "SMALL"), ("la", "gas", "R"), ("and the", "gas", "A"), ("der", "gas", "N")]
    names = table(spark, sf, "part").groupBy(F.lower("p_name").alias("term")).agg(F.lit("activity_name").alias("field_name"), F.min("p_type").alias("canonical_value"))
    aliases = names.unionByName(spark.createDataFrame(words, "term string, field_name string, canonical_value string"))
    return questions.parsed(table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.expr(ASKED).alias("question")), aliases)


@query("nlq_parse", f"{NLQ_SQL} SELECT question_id, edition_year, table_code, activity, gas FROM good")
def nlq_parse(spark, sf):
    return asked_factors(spark, sf)


@query("nlq_answer", f"""{NLQ_SQL}, fits AS (
  SELECT g.question_id, f.source_row, row_number() OVER (PARTITION BY g.question_id ORDER BY f.edition_year DESC, f.table_code, f.activity_name, f.source_row) AS place FROM good g JOIN factors f
    ON (g.activity IS NULL OR g.activity = f.activity_name) AND (g.table_code IS NULL OR g.table_code = f.table_code) AND (g.gas IS NULL OR g.gas = f.gas)
  WHERE g.table_code IS NULL OR g.activity IS NULL
) SELECT question_id, source_row, CAST(place AS INTEGER) AS place FROM fits WHERE place <= 20""")  # fmt: skip
def nlq_answer(spark, sf):
    """The factors that answer each question. The tables have no editions of this century, so that years are left out of what is asked."""
    from fathomline.operators import questions

    asked = asked_factors(spark, sf).withColumn("edition_year", F.lit(None).cast("int"))
    return questions.answers(asked, factors(spark, sf)).select("question_id", "source_row", "place")


@query("factor_context", f"WITH {FACTORS_SQL} SELECT source_row, concat_ws(' | ', activity_name, gas, fuel_type, edition_year) AS line FROM factors")
def factor_context(spark, sf):
    return factors(spark, sf).select("source_row", F.concat_ws(" | ", "activity_name", "gas", "fuel_type", F.col("edition_year").cast("string")).alias("line"))


@query("limit_guard", f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS n_chunks, sum(length(content)) AS n_chars, CASE WHEN count(*) > 40 THEN 'TOO_MANY_PARTS' WHEN sum(length(content)) > 8000 THEN 'TOO_LONG' ELSE 'OK' END AS state FROM chunks GROUP BY doc_id")
def limit_guard(spark, sf):
    parts, chars = F.count(F.lit(1)), F.sum(F.length("content"))
    return chunks(spark, sf).groupBy("doc_id").agg(parts.alias("n_chunks"), chars.alias("n_chars"), F.when(parts > 40, "TOO_MANY_PARTS").when(chars > 8000, "TOO_LONG").otherwise("OK").alias("state"))
