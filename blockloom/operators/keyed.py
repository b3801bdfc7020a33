"""Ordered keyed tables: lookups, scans, rank paging, batched changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_lookup(df: DataFrame, key: str, value: int) -> DataFrame:
    return df.filter(F.col(key) == value)


def multi_get(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row per requested key (key, ordinal), nulls where it is absent."""
    return keys.join(df, key, "left")


def scan_after(df: DataFrame, key: str, start: int, limit: int) -> DataFrame:
    return df.filter(F.col(key) >= start).orderBy(key).limit(limit)


def range_scan(df: DataFrame, key: str, start: int, end: int, limit: int | None = None) -> DataFrame:
    """Rows of the half-open range, the first ``limit`` of them by key if given."""
    if end < start:
        raise ValueError("reversed range")
    found = df.filter((F.col(key) >= start) & (F.col(key) < end))
    return found if limit is None else found.orderBy(key).limit(limit)


def leaf_budget_scan(df: DataFrame, key: str, start: int, limit: int, leaf_bits: int, max_leaves: int) -> DataFrame:
    """At most ``limit`` rows out of the first ``max_leaves`` leaf groups that have a row from ``start`` on."""
    rows = df.filter(F.col(key) >= start).withColumn("leaf", F.shiftright(F.col(key), leaf_bits))
    leaves = rows.select("leaf").distinct().orderBy("leaf").limit(max_leaves)
    return rows.join(F.broadcast(leaves), "leaf", "left_semi").orderBy(key).limit(limit)


def rank_page(df: DataFrame, key: str, skip: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(skip).limit(limit)


def rank_of_key(df: DataFrame, key: str, values: list[int]) -> DataFrame:
    """Keys strictly below each value, in one pass."""
    counts = [F.struct(F.lit(v).cast("long").alias("key"), F.count_if(F.col(key) < v).alias("rank")) for v in values]
    return df.agg(F.array(*counts).alias("r")).select(F.inline("r"))


TRIM_WIDTH = 1 << 20


def after_trims(live: DataFrame, trims: DataFrame, width: int = TRIM_WIDTH) -> DataFrame:
    """Pages (volume_id, page, seq) that no later trim (tv, tfirst, tlast, ts) of their volume covers: a join on ranges of ``width`` pages."""
    spread = trims.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("tfirst") / width), F.floor(F.col("tlast") / width))))
    covers = (F.col("volume_id") == F.col("tv")) & (F.floor(F.col("page") / width) == F.col("bucket")) & F.col("page").between(F.col("tfirst"), F.col("tlast"))
    return live.join(spread, covers & (F.col("ts") > F.col("seq")), "left_anti")


def keyset_page(df: DataFrame, key: str, cursor: int, limit: int) -> DataFrame:
    """A page after the cursor with ``has_more`` from one row of look-ahead; the limit is kept within 1 and 128."""
    limit = max(1, min(128, limit))
    ahead = df.filter(F.col(key) > cursor).orderBy(key).limit(limit + 1)
    rows = ahead.withColumn("nth", F.row_number().over(Window.orderBy(key)))  # at most limit + 1 rows
    more = F.max("nth").over(Window.partitionBy()) > limit
    return rows.withColumn("has_more", more).filter(F.col("nth") <= limit).drop("nth")


def apply_upserts(base: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """Base after a batch of (key, op, value), op upsert or delete; ``changed`` marks rows with a new value.

    An equal value is no change; deleting an absent key does nothing.
    """
    new = updates.select(key, F.col("op"), F.col(value).alias("new"))
    both = base.select(key, F.col(value).alias("old")).join(new, key, "full")
    kept = both.filter("op is null or op <> 'delete'")
    upsert = F.col("op") == "upsert"
    return kept.select(
        key, F.when(upsert, F.col("new")).otherwise(F.col("old")).alias(value), (F.coalesce(upsert, F.lit(False)) & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed")
    )


def range_delete(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    if end < start:
        raise ValueError("reversed range")
    return df.filter((F.col(key) < start) | (F.col(key) >= end))


def last_per_key(log: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """Last-writer-wins fold of a log, pre-aggregated before its shuffle."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(order, *values), order).alias("last"))
    return last.select(*keys, *[F.col(f"last.{v}").alias(v) for v in (order, *values)])


def islands(df: DataFrame, order: str, partition: list[str] | None = None, gap: Column | None = None) -> DataFrame:
    """Runs of consecutive values of ``order``: (partition, first, last, n); further runs where ``gap`` differs."""
    place = F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(order))
    run = F.col(order) - place if gap is None else gap - place
    return df.withColumn("run", run).groupBy(*(partition or []), "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")
