"""Interval joins, runs and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators import runs


def buckets(start: Column, end: Column, width: int) -> Column:
    """Buckets of ``width`` that the half-open interval touches."""
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of overlapping half-open intervals (lstart, lend), (rstart, rend): an equality join on buckets, each pair once."""
    a = left.withColumn("bucket", F.explode(buckets(F.col("lstart"), F.col("lend"), width)))
    b = right.withColumn("bucket", F.explode(buckets(F.col("rstart"), F.col("rend"), width)))
    first = F.floor(F.greatest("lstart", "rstart") / width)
    return a.join(b, "bucket").filter((F.col("lstart") < F.col("rend")) & (F.col("rstart") < F.col("lend")) & (F.col("bucket") == first)).drop("bucket")


def classify(left: DataFrame, key: str, ranges: DataFrame, kinds: list[str], default: str, width: int) -> DataFrame:
    """(key, kind): the strongest kind, first in ``kinds``, of the ranges that an interval overlaps."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    best = overlap_join(left, ranges, width).groupBy(key).agg(F.min_by("kind", rank).alias("kind"))
    return left.select(key).join(best, key, "left").withColumn("kind", F.coalesce("kind", F.lit(default)))


def map_points(points: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """Translate ``vcn`` by the run that holds it (vcn, length, lcn); null in a hole."""
    spread = runs.select(F.col("vcn").alias("run_vcn"), "length", F.col("lcn").alias("run_lcn"), F.explode(buckets(F.col("vcn"), F.col("vcn") + F.col("length"), width)).alias("bucket"))
    inside = (F.col("vcn") >= F.col("run_vcn")) & (F.col("vcn") < F.col("run_vcn") + F.col("length"))
    found = points.withColumn("bucket", F.floor(F.col("vcn") / width)).alias("p").join(spread.alias("r"), (F.col("p.bucket") == F.col("r.bucket")) & inside, "left")
    return found.withColumn("lcn", F.col("run_lcn") + F.col("vcn") - F.col("run_vcn")).drop("bucket", "run_vcn", "run_lcn", "length")


def overlaps_before(ranges: DataFrame, start: str, end: str, key: str, partition: list[str], width: int = runs.WIDTH) -> DataFrame:
    """Whether each range starts before the end of some range that starts earlier."""
    found = runs.running(ranges, partition, [start, key], "end_before", F.col(end), F.max, width, inclusive=False)
    return found.withColumn("overlaps", F.coalesce(F.col(start) < F.col("end_before"), F.lit(False))).drop("end_before")


def bits(bitmap: DataFrame, index: str, byte: str) -> DataFrame:
    """(cluster, used) of a bitmap, eight clusters a byte, the lowest bit first."""
    rows = bitmap.select(F.col(index), F.col(byte), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return rows.select((F.col(index) * 8 + F.col("bit")).alias("cluster"), F.expr(f"bit_get(cast({byte} as long), bit) = 1").alias("used"))


def peak_active(requests: DataFrame, key: str, start: str, end: str, width: int = runs.WIDTH) -> DataFrame:
    """Most requests active at once, per key; one that ends when another starts is over."""
    steps = requests.select(key, F.inline(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("step")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("step")))))
    return runs.running(steps, [key], ["t", "step"], "active", F.col("step"), F.sum, width).groupBy(key).agg(F.max("active").alias("max_active"))
