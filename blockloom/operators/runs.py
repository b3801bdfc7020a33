"""Ordered windows over a few large groups, in runs.

A window over a handful of keys is one task each.  Here the order is cut into
runs of a width; each run is a window of its own, and what it needs of the runs
before it comes from a table with one row a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16
RUN, BEFORE = "run_number", "before_run"


def run_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width)


def _joined(rows: DataFrame, per_run: DataFrame, keys: list[str]) -> DataFrame:
    same = F.col(f"a.{RUN}").eqNullSafe(F.col(f"b.{RUN}"))
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return rows.alias("a").join(per_run.alias("b"), same).select("a.*", f"b.{BEFORE}")


def with_previous(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Add columns of the names in ``values``: their expression in the row before, by ``order`` within ``keys``; null in the first."""
    run = rows.withColumn(RUN, run_of(order[0], width))
    value = F.struct(*(v.alias(k) for k, v in values.items()))
    last = run.groupBy(*keys, RUN).agg(F.max_by(value, F.struct(*order)).alias("last"))
    w = Window.partitionBy(*keys).orderBy(RUN)
    last = last.withColumn(BEFORE, F.lag("last").over(w)).drop("last")
    inside = F.lag(value).over(Window.partitionBy(*keys, RUN).orderBy(*order))
    found = _joined(run.withColumn("inside_run", inside), last, keys)
    found = found.withColumn("previous_row", F.coalesce("inside_run", BEFORE))
    return found.select(*rows.columns, *(F.col(f"previous_row.{k}").alias(k) for k in values))


def running(rows: DataFrame, keys: list[str], order: list[str], name: str, value: Column, total: Callable = F.sum, width: int = WIDTH, inclusive: bool = True) -> DataFrame:
    """Add ``name``: ``total`` (sum, min or max) of ``value`` over the rows up to this one, or up to the one before."""
    run = rows.withColumn(RUN, run_of(order[0], width)).withColumn("run_value", value)
    per_run = run.groupBy(*keys, RUN).agg(total("run_value").alias("whole"))
    w = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
    per_run = per_run.withColumn(BEFORE, total("whole").over(w)).drop("whole")
    w = Window.partitionBy(*keys, RUN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    found = _joined(run.withColumn("inside_run", total("run_value").over(w)), per_run, keys)
    both = F.array_compact(F.array("inside_run", BEFORE))
    merged = F.aggregate(both, F.lit(None).cast(found.schema["inside_run"].dataType), lambda a, x: F.when(a.isNull(), x).otherwise({F.sum: a + x, F.min: F.least(a, x), F.max: F.greatest(a, x)}[total]))
    return found.withColumn(name, merged).select(*rows.columns, name)
