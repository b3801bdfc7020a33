"""Append-only logs: parsing, validation by prefix or as a whole, replay, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators import runs
from blockloom.operators.views import first_match

LONGEST_LINE = 12_000


def parse_segments(lines: DataFrame, schema: str, longest: int = LONGEST_LINE) -> DataFrame:
    """Rows of JSON lines (segment, line_no, line) by the activity log's rule, with ``ok``.

    A line that is too long ends its segment; a malformed line, or one whose
    sequence does not increase, is skipped.
    """
    order = Window.partitionBy("segment").orderBy("line_no")
    ended = F.max((F.length("line") > longest).cast("int")).over(order)
    rows = lines.withColumn("ended", ended == 1).withColumn("row", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    before = F.max(F.when(~F.col("ended"), F.col("row.sequence"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    good = ~F.col("ended") & F.col("row.sequence").isNotNull() & F.coalesce(F.col("row.sequence") > before, F.lit(True))
    return rows.withColumn("ok", F.coalesce(good, F.lit(False)))


def valid_prefix(log: DataFrame, keys: list[str], order: str, ok: Column, width: int = runs.WIDTH) -> DataFrame:
    """The records before the first bad one of each key."""
    sound = F.coalesce(ok, F.lit(False)).cast("int")
    return runs.running(log, keys, [order], "prefix_ok", sound, F.min, width).filter("prefix_ok = 1").drop("prefix_ok")


def whole_or_nothing(log: DataFrame, keys: list[str], seq: str, ok: Column) -> DataFrame:
    """Per key: whether every record is good and the sequence has no gap; any damage invalidates all."""
    n = F.count(F.lit(1))
    sound = F.bool_and(F.coalesce(ok, F.lit(False))) & (F.min(seq) == 1) & (F.max(seq) == n) & (F.count_distinct(seq) == n)
    return log.groupBy(*keys).agg(n.alias("records"), sound.alias("valid"))


def changes(log: DataFrame, keys: list[str], order: str, state: list[str], width: int = runs.WIDTH) -> DataFrame:
    """Records whose state differs from the one before of the same key."""
    now = F.struct(*state)
    found = runs.with_previous(log, keys, [order], {"state_before": now}, width)
    return found.filter(F.col("state_before").isNull() | (now != F.col("state_before"))).drop("state_before")


# Statuses of log rows by ending of the action, in the order they are tested after the error level.
SUCCESS = "[.](confirmed|completed|deleted|removed|unchanged|verified)$"
REUSED = ("object.reused", "upload.reused")


def outcome(action: Column, level: Column, kind: Column) -> Column:
    """Status shown for a log row.  A failed action or the error level comes first; replica rows have statuses of their own."""
    level, replica = F.lower(level), F.coalesce(kind == "replica", F.lit(False))
    return first_match(
        [
            ((level == "error") | action.rlike("[.]failed$"), "failed"),
            (action.rlike("[.]interrupted$"), "interrupted"),
            (level == "warning", "warning"),
            (action.rlike("[.]paused$"), "paused"),
            (action.rlike("[.]cancelled$"), "cancelled"),
            (replica & (action == "prepared"), "to_confirm"),
            (replica & action.isin("applied", "unchanged"), "success"),
            (action.isin(*REUSED), "reused"),
            (action.rlike(SUCCESS), "success"),
            (action.rlike("[.]started$"), "started"),
        ],
        "record",
    )


LEAST_BATCH, MOST_BATCH = 128, 512


def batch_after(steps: str) -> Column:
    """Batch size after (ms, waiting) steps in order: back to the least while foreground work waits, else halved by slow steps and doubled by fast ones."""
    least, most = F.lit(LEAST_BATCH).cast("long"), F.lit(MOST_BATCH).cast("long")
    return F.aggregate(
        steps,
        least,
        lambda a, s: F.when(s["waiting"], least).when(s["ms"] > 100, F.greatest(F.shiftright(a, 1), least)).when(s["ms"] <= 25, F.least(a * 2, most)).otherwise(a),
    )


def budget(batch: Column, maximum: Column, waiting: Column) -> Column:
    """What one step may take: the batch within the caller's maximum and a cap that is lower while foreground work waits."""
    return F.greatest(F.least(batch, maximum, F.when(waiting, LEAST_BATCH).otherwise(MOST_BATCH)), F.lit(1)).cast("long")
