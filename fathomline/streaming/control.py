"""Control plane of messages, as batch operators and as Structured Streaming queries over the same functions.

Messages carry (doc_id, version, attempt, ok, terminal, seq). Locks of a transactional queue have no counterpart: one
streaming query is the only writer, and a lease token fences whoever held the work before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds before each further attempt; the last repeats. Attempts after which a message is dead.
RETRY_DELAYS = (30, 120, 600, 1800)
MOST_ATTEMPTS = 5


def retry_delay(attempt: Column, delays: tuple[int, ...] = RETRY_DELAYS) -> Column:
    listed = F.array(*map(F.lit, delays))
    return F.element_at(listed, F.greatest(F.least(attempt, F.lit(len(delays))), F.lit(1)))


def route(messages: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """``route``: DONE, RETRY, or DEAD for terminal errors and used-up attempts."""
    where = F.when(F.col("ok"), "DONE").when(F.col("terminal") | (F.col("attempt") >= most), "DEAD").otherwise("RETRY")
    return messages.withColumn("route", where)


def fresh(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """Messages whose version is the document's and whose document isn't finished; unknown documents are stale."""
    return messages.join(documents.select("doc_id", F.col("version").alias("current"), "status"), "doc_id").where("version = current and status not in ('READY', 'REJECTED')").drop("current", "status")


def due(outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """Claimable rows: pending and due, or claimed with an expired lease; oldest first."""
    ready = ((F.col("state") == "PENDING") & (F.col("available_at") <= now)) | ((F.col("state") == "CLAIMED") & (F.col("lease_until") <= now))
    return outbox.where(ready).orderBy("available_at", "id").limit(limit)


def renew(leases: DataFrame, renewals: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Renewals by token: applied if the token is the holder's and the lease has not run out."""
    both = leases.join(renewals.select("id", F.col("token").alias("asked")), "id")
    ok = (F.col("token") == F.col("asked")) & (F.col("lease_until") > now)
    return both.select("id", ok.alias("renewed"), F.when(ok, now + F.expr(f"interval {seconds} seconds")).otherwise(F.col("lease_until")).alias("lease_until"))


def transition(rows: DataFrame, allowed: dict[str, tuple[str, ...]], to: Column) -> DataFrame:
    """Guarded status updates: applied only from the statuses allowed for the target."""
    ok = F.lit(False)
    for target, sources in allowed.items():
        ok = ok | ((to == target) & F.col("status").isin(*sources))
    return rows.withColumn("changed", ok).withColumn("status", F.when(ok, to).otherwise(F.col("status")))


CLAIM_STATE = "version long, attempts int, lease_until double"
#: Days behind the newest message after which a document's claims are forgotten, and messages are too late; longer than any delay.
CLAIM_DAYS = 7


def claim(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Claims by document with attempts and leases in state: a message is taken if its version isn't older, the lease has
    run out, and attempts are left; a newer version starts anew. The state goes CLAIM_DAYS after the document's last message."""
    if state.hasTimedOut:
        state.remove()
        return
    version, attempts, until = state.get if state.exists else (-1, 0, float("-inf"))
    out, newest = [], float("-inf")
    for frame in frames:
        for m in frame.sort_values(["ts", "seq"]).itertuples():
            now = m.ts.timestamp()
            newest = max(newest, now)
            if m.version > version:
                version, attempts, until = m.version, 0, float("-inf")
            taken = m.version == version and now >= until and attempts < MOST_ATTEMPTS
            if taken:
                attempts, until = attempts + 1, now + RETRY_DELAYS[min(attempts, len(RETRY_DELAYS) - 1)]
            out.append((key[0], m.seq, taken, attempts))
    state.update((int(version), int(attempts), float(until)))
    state.setTimeoutTimestamp(int(newest * 1000) + CLAIM_DAYS * 86_400_000)
    yield pd.DataFrame(out, columns=["doc_id", "seq", "taken", "attempts"])


def claim_stream(messages: DataFrame) -> DataFrame:
    """``claim`` over a stream with columns doc_id, version, seq and ts. Time is the messages' own; those too late give no row."""
    return messages.withWatermark("ts", f"{CLAIM_DAYS} days").groupBy("doc_id").applyInPandasWithState(claim, "doc_id long, seq long, taken boolean, attempts int", CLAIM_STATE, "append", "EventTimeTimeout")


#: Micro-batches after which an upserted table's changes are merged into a whole version.
MERGE_EVERY = 16


def upsert_stream(stream: DataFrame, key: list[str], sequence: str, target: str, checkpoint: str):
    """Latest-wins upsert of a stream into a table: a micro-batch writes its own newest row of each key, as changes.

    Every MERGE_EVERY micro-batches, changes are merged into a whole version (``v...``), and what the version before has
    already covered is deleted, so that a reader has that many micro-batches to finish. A rerun of a micro-batch writes
    the same files again. Returns the started query; read the table with ``newest_version``.
    """
    from fathomline.sources.sinks import latest

    def role(column: str) -> dict[str, str]:  # kept in the files' schema, for the reader
        return {"upsert": "key" if column in key else "sequence" if column == sequence else "value"}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = latest(batch, key, sequence).select(*(F.col(c).alias(c, metadata=role(c)) for c in batch.columns))
        changes.write.mode("overwrite").parquet(f"{target}/d{number:010d}")
        if number % MERGE_EVERY < MERGE_EVERY - 1:
            return
        names = _parts(spark, target)
        base = max((n for n in names if n[0] == "v" and int(n[1:]) < number), default=None)
        _merged(spark, target, [n for n in names if n == base or n[0] == "d" and int(n[1:]) <= number]).write.mode("overwrite").parquet(f"{target}/v{number:010d}")
        fs = _file_system(spark, target)
        for n in names:
            if base and n != base and int(n[1:]) <= int(base[1:]):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}"), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _file_system(spark, target: str):
    return spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())


def _parts(spark, target: str) -> list[str]:
    """Names of the finished versions and changes of a table, found through Hadoop's file system."""
    path, fs = spark._jvm.org.apache.hadoop.fs.Path(target), _file_system(spark, target)
    if not fs.exists(path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]


def _merged(spark, target: str, names: list[str]) -> DataFrame:
    """The newest row of each key in a version and the changes since; later changes win over rows of the same sequence."""
    base = max((n for n in names if n[0] == "v"), default="v-1")
    used = [n for n in names if n == base or n[0] == "d" and int(n[1:]) > int(base[1:])]
    parts = [spark.read.parquet(f"{target}/{n}").withColumn("_at", F.lit(int(n[1:]))) for n in used]
    both = reduce(DataFrame.unionByName, parts)
    fields = parts[0].drop("_at").schema.fields
    by = {f.name: f.metadata["upsert"] for f in fields}
    last = Window.partitionBy(*(c for c, r in by.items() if r == "key")).orderBy(*(F.desc(c) for c, r in by.items() if r == "sequence"), F.desc("_at"))
    best = both.withColumn("_place", F.row_number().over(last)).where("_place = 1")
    return best.select(*(F.col(f.name).alias(f.name, metadata=f.metadata) for f in fields))


def newest_version(spark, target: str) -> DataFrame | None:
    """The table that ``upsert_stream`` writes, as of its last finished micro-batch; None before the first."""
    names = _parts(spark, target)
    return _merged(spark, target, names) if names else None
