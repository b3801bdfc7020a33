"""Appending rows to fixed-size objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack_slots(rows: DataFrame, pool: str, order: str, slots: int, run_rows: int = 1 << 20) -> DataFrame:
    """Add object_ordinal, slot and sealed (the object is full) by position in the pool.

    A pool may hold most rows, so positions come in two steps: within runs of
    neighbouring keys, and from the number of rows before each run.
    """
    runs = rows.withColumn("run", F.floor(F.col(order) / run_rows).cast("long"))
    before = runs.groupBy(pool, "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(pool).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(pool)
    before = before.select(pool, "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all"))
    at = F.row_number().over(Window.partitionBy(pool, "run").orderBy(order)) - 1
    placed = runs.withColumn("at", at.cast("long")).join(before, [pool, "run"]).withColumn("at", F.col("at") + F.col("before"))
    ordinal = F.floor(F.col("at") / slots).cast("long")
    return placed.select(order, pool, ordinal.alias("object_ordinal"), (F.col("at") % slots).alias("slot"), ((ordinal + 1) * slots <= F.col("all")).alias("sealed"))
