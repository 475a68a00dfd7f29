"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its target share of the output's bytes over its share of the input's. The number
of copies of a document is the inverse of the Poisson distribution with that mean at a uniform number made from a hash of
(seed, document), so that a document's count depends on nothing but itself and its source's rate. Documents are exploded
by their counts and shuffled globally by a hash of (seed, document, copy).

Rates join by source with the hot source's rows where they are: the rates are broadcast while the sources are few
(checked, see BROADCAST_SOURCES), and beyond that joined on (source, salt).

Defined results: null is a source of its own; null and empty texts count no bytes, and a source without any bytes has
the rate 0 unless no source has bytes, when all rates are ``scale``; rows of equal id and source get equal counts and keys, and
are dealt apart; a row without an id has a draw and keys by its place in the table; ties in the shuffle key are in no order; an
empty table gives no rows; columns that clash with those added are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import text_bytes

SEED = "mix-1"
#: Default target: shares of the sources proportional to their bytes to this power, which lifts small sources.
TEMPERATURE = 0.5
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Steps of the inversion beyond the mean: mean + 12 deviations + 40 lies past any 52-bit uniform number.
DEVIATIONS, BEYOND = 12, 40


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    text = F.concat_ws(":", F.lit(SEED), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k with u < P(X <= k), X being Poisson with ``mean``; 0 for a mean of 0.

    Means above 500 are sums of equal parts of a quarter of a thousand each, as exp(-mean) would vanish: the parts use
    the digits of further hashes, see ``copies``.
    """
    steps = F.sequence(F.lit(1), (mean + F.lit(float(DEVIATIONS)) * F.sqrt(mean)).cast("int") + F.lit(BEYOND))
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["cdf"] + p).alias("cdf"), (a["k"] + F.when(u >= a["cdf"], 1).otherwise(0)).alias("k"))

    return F.aggregate(steps, zero, step, lambda a: a["k"])


#: Largest mean that one inversion takes.
LARGEST_MEAN = 500.0


def copies(rate: Column, key: Column | None = None) -> Column:
    """How often the document with ``key`` (its doc_id) is repeated at ``rate``."""
    key = F.col("doc_id").cast("string") if key is None else key
    one = poisson_inverse(uniform(key), rate)
    parts = F.ceil(rate / F.lit(LARGEST_MEAN)).cast("int")
    many = F.aggregate(
        F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), F.lit(0),
        lambda a, k: a + poisson_inverse(uniform(key, k.cast("string")), rate / parts),
    )
    return F.when(rate <= LARGEST_MEAN, one).otherwise(many)


def source_rates(documents: DataFrame, weights: dict[str | None, float] | None = None, scale: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """source_key and rate: the mean repetitions that bring each source to its target share of ``scale`` times the input's bytes."""
    sizes = documents.groupBy("source").agg(F.sum(text_bytes(F.col("text"))).alias("bytes")).withColumn("bytes", F.col("bytes").cast("double"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("bytes", F.lit(temperature)))
    else:
        known = [(k, float(v)) for k, v in weights.items()]
        given = documents.sparkSession.createDataFrame(known, "given string, weight double")
        sizes = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("given")), "left").na.fill({"weight": 0.0}).drop("given")
    total = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight")).otherwise(0.0)).alias("all_weight"))
    rate = F.when(F.col("all_bytes") == 0, F.lit(scale)).when((F.col("bytes") == 0) | (F.col("all_weight") == 0), 0.0)
    rate = rate.otherwise(F.lit(scale) * F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.when(F.col("bytes") > 0, F.col("bytes")))
    return sizes.crossJoin(F.broadcast(total)).select(F.col("source").alias("source_key"), rate.alias("rate"))  # the total is one row


def mix(documents: DataFrame, weights: dict[str | None, float] | None = None, scale: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """Every document as often as drawn, in random order: its columns, then replica (from 0), n_copies and shuffle_key."""
    rates = source_rates(documents, weights, scale, temperature)
    clash = [c for c in documents.columns if c in ("source_key", "rate", "replica", "n_copies", "shuffle_key", "salt", "salt_key", "mix_row", "mix_key")]
    rows = documents.drop(*clash)
    columns = rows.columns
    rows = rows.withColumn("mix_row", F.monotonically_increasing_id())
    rows = rows.withColumn("mix_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("mix_row").cast("string"))))
    many = rates.limit(BROADCAST_SOURCES + 1).count() > BROADCAST_SOURCES
    if many:
        salted = rates.withColumn("salt_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = F.col("source").eqNullSafe(F.col("source_key")) & (F.col("salt") == F.col("salt_key"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("mix_row"), F.lit(SALTS)).cast("int")).join(salted, on)
    else:
        joined = rows.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("source_key")))
    drawn = joined.withColumn("n_copies", copies(F.col("rate"), F.col("mix_key"))).where("n_copies > 0")
    spread = drawn.select(*columns, "mix_row", "mix_key", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("replica"))
    key = F.md5(F.concat_ws(":", F.lit(SEED + "-order"), F.col("mix_key"), F.col("replica").cast("string")).cast("binary"))
    keyed = spread.withColumn("shuffle_key", key)
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(parts, "shuffle_key", "mix_row").sortWithinPartitions("shuffle_key").select(*columns, "replica", "n_copies", "shuffle_key")
