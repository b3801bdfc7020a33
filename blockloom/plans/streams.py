"""Streaming twins as queries: each runs a stream over the event log to its end and returns what it published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.sources.scratch import fresh_path
from blockloom.sources.versioned import VersionedTable
from blockloom.streaming import twins

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a stream of its files."""
    return spark.readStream.schema(fx.raw(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


def drain(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all there is now, with its checkpoint in the shared folder."""
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    run.awaitTermination()


@query("stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, d):
    """Counters maintained by signed changes, exactly once per batch."""
    path = fresh_path(spark, "stream")
    table = VersionedTable(spark, f"{path}/table")
    drain(events(spark, d).select("event_type", F.lit(1).cast("long").alias("delta")), path, twins.maintain_counts(table, ["event_type"]))
    return table.read()


@query(
    "stream_fold",
    "SELECT user_id % 3 AS volume, event_id % 257 AS page, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL",
)
def stream_fold(spark, d):
    """Pages after a stream of writes, last writer wins, each batch one version."""
    path = fresh_path(spark, "stream")
    table = VersionedTable(spark, f"{path}/table")
    writes = events(spark, d).select((F.col("user_id") % 3).alias("volume"), (F.col("event_id") % 257).alias("page"), F.col("event_id").alias("seq"), "event_type")
    drain(writes, path, twins.fold_writes(table, ["volume", "page"], "seq"))
    return table.read()


@query(
    "stream_state_changes",
    """SELECT disk, event_id, event_type FROM (SELECT user_id % 4 AS disk, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS before FROM events)
        WHERE before IS NULL OR before <> event_type""",
)
def stream_state_changes(spark, d):
    """State changes per disk, with the last state kept between batches."""
    path = fresh_path(spark, "stream")
    rows = events(spark, d).select((F.col("user_id") % 4).alias("disk"), "event_id", "event_type")
    drain(twins.state_changes(rows, "disk", "event_id", "event_type"), path, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
    return spark.read.parquet(f"{path}/out").select("disk", "event_id", "event_type")


@query("stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 6 hours, ts)) // 1000000 AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """An extension: event-time windows of six hours with a watermark, complete at the stream's end."""
    path = fresh_path(spark, "stream")
    timed = events(spark, d).select(F.col("ts").cast("timestamp").alias("at"), "event_type").withWatermark("at", "1 day")
    counts = timed.groupBy(F.window("at", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    flat = counts.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n")
    drain(flat, path, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out"), "complete")
    return spark.read.parquet(f"{path}/out")
