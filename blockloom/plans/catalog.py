"""Catalog queries: classification, overlay, summary, cube, block views."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import catalog as op
from blockloom.sources.scratch import fresh_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}
KEYS = ["missing", "state", "content_type"]

CLASSIFIED = """classified AS (SELECT *, CASE WHEN kind = 1 THEN list_extract(['data', 'ntfs_mft', 'ntfs_log', 'ntfs_usn', 'ntfs_metadata'], least(pool, 4) + 1)
    ELSE 'container_index' END AS content_type, list_extract(['local', 'pending', 'uploaded', 'synced'],
    CASE WHEN sync_state = 1 AND current_refs = 0 AND cloud_refs = 0 THEN 0 ELSE sync_state END + 1) AS state FROM objects_full)"""
VIEW = f"""{CLASSIFIED}, viewed AS (SELECT c.*, r.oid IS NOT NULL AS confirmed,
    CASE WHEN r.oid IS NOT NULL THEN 'uploaded' ELSE coalesce(transfer_state, state) END AS shown,
    state = 'pending' AND r.oid IS NULL AS is_pending
    FROM classified c LEFT JOIN receipts r ON c.oid = r.oid LEFT JOIN transfer t ON c.oid = t.oid)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def classified(spark, d):
    return op.classify(fx.objects_full(spark, d))


def viewed(spark, d):
    return op.overlay(classified(spark, d), fx.receipts(spark, d), fx.transfer(spark, d))


def saved_view(spark, d):
    """What pages of blocks show of the view, worked out once and kept in the shared folder for all that read it."""
    view = viewed(spark, d).select("extent", "oid", "shown", "content_type", "missing")
    path = fresh_path(spark, "view")
    view.write.parquet(path)
    return spark.read.schema(view.schema).parquet(path)


@query("classify_objects", fx.with_tables("objects_full", f"WITH {CLASSIFIED} SELECT oid, content_type, state FROM classified"))
def classify_objects(spark, d):
    return classified(spark, d).select("oid", "content_type", "state")


@query("runtime_state", fx.with_tables("objects_full receipts transfer", f"WITH {VIEW} SELECT oid, state, shown, is_pending FROM viewed"))
def runtime_state(spark, d):
    return viewed(spark, d).select("oid", "state", "shown", "is_pending")


@query(
    "block_summary",
    fx.with_tables(
        "objects_full receipts transfer",
        f"""WITH {VIEW} SELECT shown, content_type, missing, count(*) AS n_objects, count(*) * {fx.OBJECT_SIZE} AS n_bytes,
        count(*) FILTER (is_pending) AS pending_objects, count(*) FILTER (is_pending) * {fx.OBJECT_SIZE} AS pending_bytes
        FROM viewed GROUP BY ALL""",
    ),
)
def block_summary(spark, d):
    return op.summary(viewed(spark, d), fx.OBJECT_SIZE)


CUBE = "SELECT missing, state, content_type, count(*) AS n FROM classified GROUP BY GROUPING SETS ((missing, state, content_type), (missing, state), (missing, content_type), (missing))"


@query("block_cube", fx.with_tables("objects_full", f"WITH {CLASSIFIED} {CUBE}"))
def block_cube(spark, d):
    return op.cube(classified(spark, d))


@query(
    "cube_invariants",
    fx.with_tables(
        "objects_full",
        f"""WITH {CLASSIFIED}, cells AS ({CUBE}), sums AS (SELECT missing,
        CAST(sum(n) FILTER (state IS NULL AND content_type IS NULL) AS BIGINT) AS total, CAST(sum(n) FILTER (state IS NOT NULL AND content_type IS NULL) AS BIGINT) AS by_state,
        CAST(sum(n) FILTER (state IS NULL AND content_type IS NOT NULL) AS BIGINT) AS by_type, CAST(sum(n) FILTER (state IS NOT NULL AND content_type IS NOT NULL) AS BIGINT) AS by_pair
        FROM cells GROUP BY missing) SELECT *, total = by_state AND total = by_type AND total = by_pair AS consistent FROM sums""",
    ),
)
def cube_invariants(spark, d):
    return op.cube_violations(op.cube(classified(spark, d)))


@query(
    "incremental_cube",
    fx.with_tables(
        "objects_full receipts",
        f"""WITH {CLASSIFIED} SELECT missing, CASE WHEN r.oid IS NOT NULL THEN 'uploaded' ELSE state END AS state, content_type, count(*) AS n
        FROM classified c LEFT JOIN receipts r ON c.oid = r.oid GROUP BY ALL""",
    ),
)
def incremental_cube(spark, d):
    """Counters after confirmed uploads, from the old counters and the batch's signed changes."""
    base = classified(spark, d)
    before = base.join(fx.receipts(spark, d), "oid", "left_semi")
    changes = op.signed_changes(before, before.withColumn("state", F.lit("uploaded")), KEYS)
    return op.apply_changes(base.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), changes, KEYS)


@query(
    "prefix_counts",
    fx.with_tables(
        "objects_full",
        f"""WITH {CLASSIFIED}, n AS (SELECT state, content_type, count(*) AS n FROM classified WHERE NOT missing GROUP BY ALL)
        SELECT state, content_type, n, CAST(coalesce(sum(n) OVER (ORDER BY state, content_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM n""",
    ),
)
def prefix_counts(spark, d):
    """Objects in the categories before each one: a running sum over at most 24 rows."""
    from pyspark.sql import Window

    n = classified(spark, d).filter("not missing").groupBy("state", "content_type").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("state", "content_type").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))


BLOCKS = """blocks AS (SELECT b.extent, CASE WHEN b.extent = 0 THEN 'control' WHEN b.extent > m.n THEN 'reserved' WHEN o.oid IS NULL THEN 'free'
    WHEN o.kind = 2 THEN 'metadata' ELSE 'object' END AS block_kind, o.oid
    FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 10 FROM orders))) AS extent) b CROSS JOIN (SELECT max(o_orderkey) + 1 AS n FROM orders) m
    LEFT JOIN objects_full o ON o.extent = b.extent)"""


@query("block_view", fx.with_tables("objects_full", f"WITH {BLOCKS} SELECT * FROM blocks"))
def block_view(spark, d):
    """Every extent of the container and what it holds."""
    last = fx.raw(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    every = spark.range(0, last + 10).withColumnRenamed("id", "extent")
    found = every.join(fx.objects_full(spark, d).filter("extent is not null").select("extent", "oid", "kind"), "extent", "left")
    kind = F.when(F.col("extent") == 0, "control").when(F.col("extent") > last + 1, "reserved").when(F.col("oid").isNull(), "free")
    return found.select("extent", kind.when(F.col("kind") == 2, "metadata").otherwise("object").alias("block_kind"), "oid")


@query(
    "block_query",
    fx.with_tables(
        "objects_full receipts transfer",
        f"""WITH {VIEW}, hits AS (SELECT extent, oid, shown, content_type, count(*) OVER () AS total FROM viewed
        WHERE NOT missing AND shown = 'pending' AND content_type = 'data') SELECT * FROM hits ORDER BY extent LIMIT 64 OFFSET 32""",
    ),
)
def block_query(spark, d):
    """Third page of 32 blocks by state and content type, with the total: a paging query, limited by definition."""
    hits = saved_view(spark, d).filter("not missing and shown = 'pending' and content_type = 'data'")
    total = hits.agg(F.count(F.lit(1))).scalar()
    return hits.select("extent", "oid", "shown", "content_type").orderBy("extent").offset(32).limit(64).withColumn("total", total)


@query(
    "lazy_status",
    fx.with_tables(
        "objects_full",
        """SELECT count(*) FILTER (kind = 1) AS remote_total, count(*) FILTER (kind = 1 AND NOT missing) AS cached,
        count(*) FILTER (kind = 1 AND missing AND current_refs > 0) AS needed FROM objects_full""",
    ),
)
def lazy_status(spark, d):
    data = F.col("kind") == 1
    return fx.objects_full(spark, d).agg(
        F.count_if(data).alias("remote_total"), F.count_if(data & ~F.col("missing")).alias("cached"), F.count_if(data & F.col("missing") & (F.col("current_refs") > 0)).alias("needed")
    )


@query(
    "stage_metrics",
    fx.with_tables("activity", "SELECT action AS stage, count(*) AS steps, CAST(sum(bytes) AS BIGINT) AS n_bytes, arg_max(bytes, sequence) AS gauge FROM activity GROUP BY ROLLUP (action)"),
)
def stage_metrics(spark, d):
    """Counters add up by stage and in total; the gauge keeps its latest value."""
    return fx.activity(spark, d).rollup(F.col("action").alias("stage")).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("bytes").alias("n_bytes"), F.max_by("bytes", "sequence").alias("gauge")
    )


@query("request_counts", fx.with_tables("activity", "SELECT action AS operation, count(*) AS n FROM activity GROUP BY 1"))
def request_counts(spark, d):
    return fx.activity(spark, d).groupBy(F.col("action").alias("operation")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "transfer_progress",
    fx.with_tables(
        "activity",
        """SELECT disk_id, count(*) FILTER (action = 'object.completed') AS completed, count(*) FILTER (action = 'object.uploading') AS uploading,
        CAST(coalesce(sum(bytes) FILTER (action = 'object.completed'), 0) AS BIGINT) AS completed_bytes,
        CAST(coalesce(sum(bytes) FILTER (object_kind = 'metadata'), 0) AS BIGINT) AS metadata_bytes,
        CAST(coalesce(sum(bytes) FILTER (object_kind = 'data'), 0) AS BIGINT) AS data_bytes FROM activity GROUP BY 1""",
    ),
)
def transfer_progress(spark, d):
    done = F.col("action") == "object.completed"
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("bytes"))), F.lit(0)).cast("long")
    return fx.activity(spark, d).groupBy("disk_id").agg(
        F.count_if(done).alias("completed"),
        F.count_if(F.col("action") == "object.uploading").alias("uploading"),
        total(done).alias("completed_bytes"),
        total(F.col("object_kind") == "metadata").alias("metadata_bytes"),
        total(F.col("object_kind") == "data").alias("data_bytes"),
    )
