"""Versions of a keyed table: differences, restores, layered reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) between two versions: added, removed or changed."""
    a, b = old.select(key, F.col(value).alias("was"), F.lit(1).alias("a")), new.select(key, F.col(value).alias("now"), F.lit(1).alias("b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def layered(layers: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """The value of the first layer that has the key; a null value there hides those below."""
    every = None
    for k, layer in enumerate(layers):
        rows = layer.select(*key, F.lit(k).alias("layer"), value)
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(*key).agg(F.min(F.struct("layer", value)).alias("top")).select(*key, F.col("top.layer").alias("layer"), F.col(f"top.{value}").alias(value))
