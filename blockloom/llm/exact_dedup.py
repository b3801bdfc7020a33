"""Exact duplicates: frequent digests are settled map-side, the rest by one shuffle.

DataFrame functions only.  A Misra-Gries style sketch (the built-in frequent
items aggregate) names digests that may be frequent; their exact counts and
survivors are then counted, and those that really are frequent, at most
``tracked_top`` rows, are broadcast, so their copies never travel.  Every other
digest holds a bounded share of the rows and goes through an ordinary shuffle of
(id, digest), without texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import WS, Scratch, free_name, own_columns, quoted


def text_digest(text_col: str):
    """Lower-case hex SHA-256 of the text with runs of white space as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WS, " "), 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tracked: int = 2048,
    tracked_top: int = 256,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of equal texts stays (a null id is the
    smallest).  Rows that repeat both id and text count as copies of each other:
    exactly one of them is kept.  A null text equals the empty one.  An empty
    table gives an empty result; further columns of any name are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    rows = scratch.save(
        docs.select(F.col(quoted(id_col)).alias("id"), text_digest(quoted(text_col)).alias("text_sha256")).withColumn(
            "rid", F.monotonically_increasing_id()
        ),
        "digests",
    )
    total = rows.count()
    # frequent digests, in two levels so that no task merges the sketches of all others
    sketches = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {tracked})").alias("s")
    )
    candidates = (
        sketches.groupBy((F.col("part") * 0).alias("all"))  # grouped: an empty partition has no sketch to serialise
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {tracked_top})").alias("top"))
        .select(F.explode("top").alias("t"))
        .filter(F.col("t.count") >= max(16, total // (4 * tracked)))
        .select(F.col("t.item").alias("text_sha256"))
    )
    first = F.min(F.struct("id", "rid")).alias("first")
    winners = scratch.save(
        rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first).filter(F.col("group_size") >= 16),
        "winners",
    )
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # counted map-side first; only digests that come twice or more are joined back, and a hot one's rows can be split
    groups = rest.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first).filter(F.col("group_size") > 1)
    rare = rest.join(groups, "text_sha256", "left").select(
        "id", "text_sha256", "rid", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("first", F.struct("id", "rid")).alias("first")
    )
    return (
        frequent.select(*rare.columns)
        .unionByName(rare)
        .select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Where ids are unique, the ids of the copies to drop are enough, and Spark
    may broadcast them if they are few.  Where an id, null included, comes more
    than once, rows are told apart by their digests too, and of rows that repeat
    id and text one is kept.  Nulls count as empty texts, an empty table gives
    an empty one.
    """
    scratch = Scratch(docs.sparkSession, "exact-kept")
    at, sha, n = (free_name(docs, x) for x in ("kept_id", "kept_sha", "n_rows"))
    found = exact_dedup(docs, id_col, text_col).select(F.col(quoted(id_col)).alias(at), F.col("text_sha256").alias(sha), "kept")
    found = scratch.save(found, "decisions")
    if found.groupBy(at).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.join(found.filter(~F.col("kept")).select(at), docs[quoted(id_col)] == F.col(at), "left_anti")
    kept = found.groupBy(at, sha).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias(n)).filter("kept").drop("kept")
    rows = docs.join(kept, docs[quoted(id_col)].eqNullSafe(F.col(at)) & (text_digest(quoted(text_col)) == F.col(sha)))
    once = rows.filter(F.col(n) == 1).select(*own_columns(docs))
    return once.unionByName(rows.filter(F.col(n) > 1).dropDuplicates([at, sha]).select(*own_columns(docs)))
