"""Replay of write-ahead logs by their rules, without walking them: conditions on a whole log are aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sound_logs(log: DataFrame, key: str, checkpoint: str) -> DataFrame:
    """(key, records, valid) of directory logs (key, seq, kind, mutation, checkpoint, sum_ok, upserted, removed).

    Records count from 1 without a gap and name the checkpoint.  A begin has a
    mutation and no entries; each is followed by the commit of that mutation
    before the same may begin again, and none is open at the end.  A patch has no
    mutation.  Any damage invalidates the whole log.
    """
    turn = F.row_number().over(Window.partitionBy(key, "mutation").orderBy("seq"))  # two records for most mutations
    begin, commit, patch = (F.col("kind") == k for k in ("begin", "commit", "patch"))
    named = F.col("mutation").isNotNull()
    form = (begin & named & F.col("upserted").isNull() & F.col("removed").isNull()) | (commit & named) | (patch & ~named)
    in_turn = ~named | F.when(F.col("turn") % 2 == 1, begin).otherwise(commit)
    good = F.col("sum_ok") & (F.col("checkpoint") == checkpoint) & form & in_turn
    n = F.count(F.lit(1))
    sound = F.bool_and(F.coalesce(good, F.lit(False))) & (F.min("seq") == 1) & (F.max("seq") == n) & (F.count_distinct("seq") == n)
    closed = F.count_if(begin) == F.count_if(commit)
    return log.withColumn("turn", turn).groupBy(key).agg(n.alias("records"), (sound & closed).alias("valid"))


def entries_after(log: DataFrame, keys: list[str], first: str, then: str, last: str) -> DataFrame:
    """(keys, item) that are in after records (keys, seq, first, then), each applied in that order: those last touched by ``last``."""
    touched = log.select(
        *keys, "seq", F.inline(F.array(F.struct(F.lit(0).alias("phase"), F.col(first).alias("item")), F.struct(F.lit(1).alias("phase"), F.col(then).alias("item"))))
    ).filter("item is not null")
    phase = {first: 0, then: 1}[last]
    final = touched.groupBy(*keys, "item").agg(F.max_by("phase", F.struct("seq", "phase")).alias("phase"))
    return final.filter(F.col("phase") == phase).drop("phase")


def sound_chain(log: DataFrame, key: str) -> DataFrame:
    """(key, valid): every record names the state that the one before left, the first one the checkpoint's."""
    after = log.select(key, (F.col("seq") + 1).alias("seq"), F.col("after").alias("expected"))
    linked = log.join(after, [key, "seq"], "left").withColumn("ok", F.col("before") == F.coalesce("expected", F.lit("t0")))
    n = F.count(F.lit(1))
    return linked.groupBy(key).agg((F.bool_and(F.coalesce("ok", F.lit(False))) & F.bool_and("sum_ok") & (F.min("seq") == 1) & (F.max("seq") == n)).alias("valid"))


MOST_IN_PAGE = 128


def receipt_logs(pages: DataFrame, key: str, epoch: int) -> DataFrame:
    """(key, n_pages, n_objects, uncertain, broken) of receipt logs (key, idx, epoch, link_ok, n, oid, is_member).

    A page of another epoch ends the log; one with a bad link or count ends it
    with an uncertain tail.  Before that, an object that the job does not add, or
    one named twice, is an integrity error.
    """
    foreign = F.col("epoch") != epoch
    damaged = ~foreign & (~F.col("link_ok") | ~F.col("n").between(1, MOST_IN_PAGE))
    stop = pages.groupBy(key).agg(F.min(F.when(foreign | damaged, F.col("idx"))).alias("stop"), F.min(F.when(damaged, F.col("idx"))).alias("torn"))
    kept = pages.join(stop, key).withColumn("kept", F.col("stop").isNull() | (F.col("idx") < F.col("stop")))
    k = F.col("kept")
    return kept.groupBy(key).agg(
        F.count_if(k).alias("n_pages"),
        F.count_distinct(F.when(k, F.col("oid"))).alias("n_objects"),
        F.coalesce(F.max("torn") == F.max("stop"), F.lit(False)).alias("uncertain"),
        (F.coalesce(F.bool_or(k & ~F.col("is_member")), F.lit(False)) | (F.count_distinct(F.when(k, F.col("oid"))) < F.count_if(k))).alias("broken"),
    )
