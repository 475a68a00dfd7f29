"""Tables: explicit schemas, and the engine's own views (chunks, route hits, factors) over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _TEXT, _DOUBLE, _INT = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


SCHEMAS = {
    "documents": _schema(("doc_id", _LONG), ("text", _TEXT), ("lang", _TEXT), ("source", _TEXT), ("n_chars", _LONG)),
    "labels": _schema(("doc_id", _LONG), ("quality", _INT), ("toxic", _INT)),
    "benchmark": _schema(("item_id", _LONG), ("text", _TEXT)),
    "embeddings": _schema(("vec_id", _LONG), ("embedding", T.ArrayType(T.FloatType())), ("label", _INT)),
    "pages": _schema(("page_id", _LONG), ("url", _TEXT), ("html", _TEXT)),
    "conversations": _schema(("conv_id", _LONG), ("turn", _INT), ("role", _TEXT), ("text", _TEXT)),
}


class SchemaDrift(ValueError):
    """A stored table lacks a declared column or holds it as another kind; it is refused, not repaired."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stored table ``name``, checked against its declared schema where there is one. Nothing is inferred from text."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SCHEMAS:
        check_schema(found, SCHEMAS[name], name)
    return found


def check_schema(found: DataFrame, wanted: T.StructType, name: str) -> None:
    have = {f.name: f.dataType for f in found.schema}
    whole = (T.IntegerType, T.LongType, T.ShortType)
    for f in wanted:
        if f.name not in have:
            raise SchemaDrift(f"{name} has no column {f.name}")
        kind = have[f.name]
        if kind != f.dataType and not (isinstance(kind, whole) and isinstance(f.dataType, whole)) and not isinstance(f.dataType, T.ArrayType):
            raise SchemaDrift(f"{name}.{f.name} is {kind.simpleString()}, not {f.dataType.simpleString()}")


def dataset_of(source) -> F.Column:
    """The dataset number in a source name such as src12."""
    return F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each non-empty line of a document: chunk_id (doc:index), doc_id, dataset_id, chunk_index, content."""
    lines = table(spark, sf_dir, "documents").select("doc_id", dataset_of("source").alias("dataset_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return lines.where("content <> ''").select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "dataset_id", "chunk_index", "content")


def ready_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that may be shown: those labelled with quality 1. The label stands in for the parse verdict."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


#: The same views as common table expressions for the oracles.
CHUNKS_SQL = """
lines AS (
  SELECT doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS dataset_id,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS chunk_index,
         unnest(string_split(text, chr(10))) AS content
  FROM documents
), chunks AS (
  SELECT doc_id || ':' || chunk_index AS chunk_id, doc_id, dataset_id, chunk_index, content FROM lines WHERE content <> ''
)
"""


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items seen as a factor table: edition year, activity, gas, region, value and units, decimal(20,6)."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = item.join(part, item.l_partkey == part.p_partkey)
    return joined.select(
        F.year("l_shipdate").alias("edition_year"), F.col("l_linestatus").alias("table_code"), F.col("p_type").alias("activity_name"), F.col("p_brand").alias("fuel_type"),
        F.col("l_returnflag").alias("gas"), F.col("l_extendedprice").cast("decimal(20,6)").alias("factor_value"),
        F.col("l_quantity").cast("decimal(20,6)").alias("quantity"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_row"),
    )


FACTORS_SQL = """
factors AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS edition_year, l_linestatus AS table_code, p_type AS activity_name, p_brand AS fuel_type, l_returnflag AS gas,
         CAST(l_extendedprice AS DECIMAL(20,6)) AS factor_value, CAST(l_quantity AS DECIMAL(20,6)) AS quantity,
         l_orderkey || '-' || l_linenumber AS source_row
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""
