"""Set algebra over single-column frames of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return _sides(a, b, key).filter("in_a is null or in_b is null").select(key)


def _sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), key, "full")


def predicates(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All set predicates of a and b in one pass."""
    only_a, only_b = F.count_if(F.col("in_b").isNull()), F.count_if(F.col("in_a").isNull())
    common = F.count_if(F.col("in_a") & F.col("in_b"))
    return _sides(a, b, key).agg(
        (only_a == 0).alias("subset"),
        (only_b == 0).alias("superset"),
        ((only_a == 0) & (only_b > 0)).alias("proper_subset"),
        ((only_b == 0) & (only_a > 0)).alias("proper_superset"),
        (common > 0).alias("overlaps"),
        ((only_a == 0) & (only_b == 0)).alias("equal"),
    )


def net_changes(baseline: DataFrame, ops: DataFrame, key: str, order: str, add: str) -> DataFrame:
    """What a log of additions and removals changes in the end: an item added and removed again is no change."""
    last = ops.groupBy(key).agg(F.max_by(add, order).alias("there_now"))
    found = last.join(baseline.withColumn("was", F.lit(True)), key, "left").withColumn("was", F.coalesce("was", F.lit(False)))
    return found.filter("there_now <> was").select(key, F.when(F.col("there_now"), "added").otherwise("removed").alias("change"))


def carry_over(fresh: DataFrame, cached: DataFrame, key: str, identity: list[str], value: str) -> DataFrame:
    """Fresh rows with the cached value where the whole identity is the same; nulls equal nulls."""
    old = cached.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in identity], value)
    same = fresh[key] == F.col("__key")
    for c in identity:
        same = same & fresh[c].eqNullSafe(F.col(f"__{c}"))
    return fresh.join(old, same, "left").drop("__key", *[f"__{c}" for c in identity])
