"""Snapshot, replica and layered read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import versions as op

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


SECOND = "second AS (SELECT page, CASE WHEN page % 10 = 0 THEN sha256('new' || page) ELSE digest END AS digest FROM page_map WHERE page % 23 <> 0 UNION ALL SELECT page + 100000000, digest FROM page_map WHERE page % 31 = 0)"


def second(spark, d):
    """A later version: some pages rewritten, some unmapped, some new."""
    pages = fx.pages(spark, d).select("page", "digest")
    kept = pages.filter("page % 23 <> 0").withColumn("digest", F.when(F.col("page") % 10 == 0, F.sha2(F.concat(F.lit("new"), F.col("page").cast("string")), 256)).otherwise(F.col("digest")))
    return kept.unionByName(pages.filter("page % 31 = 0").withColumn("page", F.col("page") + 100000000))


@query(
    "replica_diff",
    fx.with_tables(
        "page_map",
        f"""WITH {SECOND} SELECT coalesce(a.page, b.page) AS page, CASE WHEN a.page IS NULL THEN 'added' WHEN b.page IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM page_map a FULL JOIN second b ON a.page = b.page WHERE a.digest IS DISTINCT FROM b.digest""",
    ),
)
def replica_diff(spark, d):
    return op.changed(fx.pages(spark, d).select("page", "digest"), second(spark, d), "page", "digest")


@query(
    "changed_pages",
    fx.with_tables("page_map", f"WITH {SECOND} SELECT b.page // 1024 AS segment, count(*) AS n FROM second b LEFT JOIN page_map a ON a.page = b.page WHERE a.digest IS DISTINCT FROM b.digest GROUP BY 1"),
)
def changed_pages(spark, d):
    """Pages to publish, by segment of 1024."""
    diff = op.changed(fx.pages(spark, d).select("page", "digest"), second(spark, d), "page", "digest").filter("change <> 'removed'")
    return diff.groupBy(F.floor(F.col("page") / 1024).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_restore",
    fx.with_tables("page_map", f"WITH {SECOND}, v AS (SELECT 1 AS version, page FROM page_map UNION ALL SELECT 2, page FROM second) SELECT version, count(*) AS pages, count(*) = count(DISTINCT page) AS exact FROM v GROUP BY version"),
)
def snapshot_restore(spark, d):
    """Pages of each restorable version and whether the copy is complete."""
    first = fx.pages(spark, d).select(F.lit(1).alias("version"), "page")
    v = first.unionByName(second(spark, d).select(F.lit(2).alias("version"), "page"))
    per_page = v.repartition(2 * fx.tasks(fx.raw(spark, d, "lineitem")), "page").groupBy("version", "page").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("version").agg(F.sum("n").alias("pages"), (F.sum("n") == F.count("page")).alias("exact"))


@query(
    "write_overlay",
    fx.with_tables(
        "page_map write_log",
        """WITH w AS (SELECT page, seq, digest, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS layer FROM write_log), l AS (SELECT page, layer, arg_max(coalesce(digest, ''), seq) AS digest FROM w GROUP BY ALL
        UNION ALL SELECT page, 2, digest FROM page_map) SELECT page, min(layer) AS layer, arg_min(digest, layer) AS digest FROM l GROUP BY page""",
    ),
)
def write_overlay(spark, d):
    """What a read sees: dirty pages above those being flushed above those stored."""
    w = fx.write_log(spark, d).withColumn("digest", F.coalesce("digest", F.lit("")))
    last = lambda rows: rows.groupBy("page").agg(F.max_by("digest", "seq").alias("digest"))
    stored = fx.pages(spark, d).select("page", "digest")
    return op.layered([last(w.filter("seq % 3 = 0")), last(w.filter("seq % 3 <> 0")), stored], ["page"], "digest")


@query(
    "disk_status",
    fx.with_tables(
        "activity commits",
        """SELECT disk_id, CASE WHEN arg_max(level, sequence) = 'error' THEN 'failed' WHEN arg_max(action, sequence) = 'sync.started' THEN 'syncing' WHEN arg_max(action, sequence) = 'object.uploading' THEN 'uploading'
        WHEN count(*) FILTER (action = 'object.completed') = 0 THEN 'unknown' ELSE 'synced' END AS status, arg_max(level, sequence) = 'error' OR arg_max(action, sequence) <> 'object.completed' AS needs_sync FROM activity GROUP BY disk_id""",
    ),
)
def disk_status(spark, d):
    """View state of each disk by precedence, and whether it must be synced again."""
    level, action = F.max_by("level", "sequence"), F.max_by("action", "sequence")
    status = F.when(level == "error", "failed").when(action == "sync.started", "syncing").when(action == "object.uploading", "uploading")
    status = status.when(F.count_if(F.col("action") == "object.completed") == 0, "unknown").otherwise("synced")
    return fx.activity(spark, d).groupBy("disk_id").agg(status.alias("status"), ((level == "error") | (action != "object.completed")).alias("needs_sync"))
