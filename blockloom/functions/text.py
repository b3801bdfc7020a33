"""Text and date forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a meaning in HTML, the ampersand first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def escape_html(value: Column) -> Column:
    """The text with HTML's special characters as references; null is empty."""
    out = F.coalesce(value, F.lit(""))
    for character, reference in ESCAPES:
        out = F.replace(out, F.lit(character), F.lit(reference))
    return out


def shown_time(ts: Column) -> Column:
    """(date, time, full) of a timestamp; a dash and a notice for a null."""
    date, time = F.date_format(ts, "yyyy/MM/dd"), F.date_format(ts, "HH:mm:ss")
    none = F.struct(F.lit("—").alias("date"), F.lit("—").alias("time"), F.lit("unavailable").alias("full"))
    return F.when(ts.isNull(), none).otherwise(F.struct(date.alias("date"), time.alias("time"), F.concat_ws(" ", date, time).alias("full")))
