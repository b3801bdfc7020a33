"""Integer arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(x: Column, by: int) -> Column:
    """Integer division, exact for any BIGINT."""
    return F.call_function("div", x, F.lit(by))


def ceil_div(x: Column, by: int) -> Column:
    return int_div(x + (by - 1), by)


def align_down(x: Column, to: int) -> Column:
    return x - x % to


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def saturating_sub(x: Column, y: Column) -> Column:
    return F.greatest(x - y, F.lit(0))
