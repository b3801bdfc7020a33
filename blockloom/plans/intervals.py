"""Interval, run and bitmap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import intervals as op, keyed, runs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def spans(spark, d):
    """Pages as byte intervals."""
    return fx.pages(spark, d).select("page", (F.col("page") * 4096).alias("lstart"), ((F.col("page") + 1) * 4096).alias("lend"))


@query(
    "interval_classify",
    fx.with_tables(
        "page_map ranges",
        """SELECT p.page, coalesce(arg_min(r.kind, list_position(['log', 'usn', 'mft', 'metadata'], r.kind)), 'data') AS kind
        FROM page_map p LEFT JOIN ranges r ON p.page * 4096 < r.rend AND r.rstart < (p.page + 1) * 4096 GROUP BY p.page""",
    ),
)
def interval_classify(spark, d):
    return op.classify(spans(spark, d), "page", fx.ranges(spark, d), fx.KINDS, "data", 40960)


@query(
    "refresh_pages",
    fx.with_tables("write_log ranges", "SELECT DISTINCT volume_id, page FROM write_log w WHERE page < 4 OR EXISTS (SELECT 1 FROM ranges r WHERE r.kind IN ('mft', 'metadata') AND w.page * 4096 < r.rend AND r.rstart < (w.page + 1) * 4096)"),
)
def refresh_pages(spark, d):
    """Written pages that touch the boot area or a watched range."""
    wrote = fx.write_log(spark, d).select("volume_id", "page").distinct()
    at = wrote.select("volume_id", "page", (F.col("page") * 4096).alias("lstart"), ((F.col("page") + 1) * 4096).alias("lend"))
    hit = op.overlap_join(at, fx.ranges(spark, d).filter("kind in ('mft', 'metadata')"), 40960).select("volume_id", "page")
    return wrote.filter("page < 4").unionByName(hit).distinct()


RUNS = "runs AS (SELECT CAST(n_nationkey AS BIGINT) * 100 AS vcn, CAST(50 + (n_nationkey % 5) * 10 AS BIGINT) AS length, CAST(n_nationkey AS BIGINT) * 1000 + 7 AS lcn FROM nation)"


@query("extent_map", f"WITH {RUNS} SELECT event_id AS vcn, r.lcn + e.event_id - r.vcn AS lcn FROM events e LEFT JOIN runs r ON e.event_id >= r.vcn AND e.event_id < r.vcn + r.length")
def extent_map(spark, d):
    n = F.col("n_nationkey").cast("long")
    runs = fx.raw(spark, d, "nation").select((n * 100).alias("vcn"), (50 + (n % 5) * 10).alias("length"), (n * 1000 + 7).alias("lcn"))
    return op.map_points(fx.raw(spark, d, "events").select(F.col("event_id").alias("vcn")), runs, 100)


@query(
    "coalesce_runs",
    fx.with_tables("page_map", "SELECT oid, min(page) AS first, max(page) AS last, count(*) AS n FROM page_map GROUP BY oid, page - slot"),
)
def coalesce_runs(spark, d):
    """Pages of an object whose slots run on with them: one read each."""
    rows = fx.page_map(spark, d).withColumn("run", F.col("page") - F.col("slot"))
    return rows.groupBy("oid", "run").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


@query(
    "page_islands",
    fx.with_tables("page_map", "SELECT segment, min(page) AS first, max(page) AS last, count(*) AS n FROM (SELECT page, page >> 12 AS segment, page - row_number() OVER (PARTITION BY page >> 12 ORDER BY page) AS run FROM page_map) GROUP BY segment, run"),
)
def page_islands(spark, d):
    rows = fx.pages(spark, d).select("page", F.shiftright("page", 12).alias("segment"))
    return keyed.islands(rows, "page", ["segment"])


@query(
    "bitmap_free_runs",
    fx.with_tables(
        "bitmap",
        """SELECT segment, min(cluster) AS first, max(cluster) AS last, count(*) AS n, count(*) * 4096 AS n_bytes FROM (
        SELECT cluster, cluster // 512 AS segment, cluster - row_number() OVER (PARTITION BY cluster // 512 ORDER BY cluster) AS run FROM (
            SELECT byte_index * 8 + bit AS cluster, (b >> bit) & 1 AS used FROM bitmap, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS bit)) WHERE used = 0) GROUP BY segment, run""",
    ),
)
def bitmap_free_runs(spark, d):
    """Free cluster runs of an allocation bitmap, bounded by segments of 512 clusters."""
    free = op.bits(fx.bitmap(spark, d), "byte_index", "b").filter("not used").withColumn("segment", F.floor(F.col("cluster") / 512))
    return keyed.islands(free.select("segment", "cluster"), "cluster", ["segment"]).withColumn("n_bytes", F.col("n") * fx.PAGE)


@query(
    "range_overlap_check",
    fx.with_tables("ranges", "SELECT range_id, coalesce(rstart < max(rend) OVER (ORDER BY rstart, range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS overlaps FROM ranges"),
)
def range_overlap_check(spark, d):
    return op.overlaps_before(fx.ranges(spark, d), "rstart", "rend", "range_id", [], 1 << 22).select("range_id", "overlaps")


@query(
    "completed_prefix",
    """WITH s AS (SELECT user_id % 4 AS queue, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS seq, event_id % 83 <> 82 AS done FROM events)
        SELECT queue, coalesce(min(seq) FILTER (NOT done) - 1, max(seq)) AS completed_through, count(*) FILTER (done) AS n_done FROM s GROUP BY queue""",
)
def completed_prefix(spark, d):
    """How far each queue is complete without a gap, from the completed sequence numbers alone."""
    rows = fx.raw(spark, d, "events").select((F.col("user_id") % 4).alias("queue"), "event_id")
    rows = runs.running(rows, ["queue"], ["event_id"], "seq", F.lit(1).cast("long"))
    done = rows.filter("event_id % 83 <> 82").select("queue", "seq")
    # the first number that is not done ends the prefix: no order among the others matters
    gap = rows.groupBy("queue").agg(F.min(F.when(F.col("event_id") % 83 == 82, F.col("seq"))).alias("gap"), F.max("seq").alias("last"))
    n = done.groupBy("queue").agg(F.count(F.lit(1)).alias("n_done"))
    return gap.join(n, "queue", "left").select("queue", F.coalesce(F.col("gap") - 1, F.col("last")).alias("completed_through"), F.coalesce("n_done", F.lit(0)).cast("long").alias("n_done"))


@query(
    "rate_audit",
    """WITH r AS (SELECT user_id % 4 AS disk, event_id, epoch_us(ts) AS t, epoch_us(ts) + CAST(event_id % 7 AS BIGINT) * 60000000 AS t_end FROM events),
        g AS (SELECT disk, t - lag(t) OVER (PARTITION BY disk ORDER BY t, event_id) AS gap FROM r),
        p AS (SELECT disk, sum(step) OVER (PARTITION BY disk ORDER BY t, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active
              FROM (SELECT disk, t, 1 AS step FROM r UNION ALL SELECT disk, t_end, -1 FROM r))
        SELECT g.disk, count(*) AS n, min(gap) AS min_gap, count(*) FILTER (gap < 60000000) AS too_fast, (SELECT CAST(max(active) AS BIGINT) FROM p WHERE p.disk = g.disk) AS max_active FROM g GROUP BY g.disk""",
)
def rate_audit(spark, d):
    """Requests that follow too closely, and the most at once, per disk."""
    r = fx.raw(spark, d, "events").select((F.col("user_id") % 4).alias("disk"), "event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t"))
    r = r.withColumn("t_end", F.col("t") + F.col("event_id") % 7 * 60000000)
    hour = 3_600_000_000
    gaps = runs.with_previous(r, ["disk"], ["t", "event_id"], {"t_before": F.col("t")}, hour).withColumn("gap", F.col("t") - F.col("t_before"))
    gaps = gaps.groupBy("disk").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("min_gap"), F.count_if(F.col("gap") < 60000000).alias("too_fast"))
    return gaps.join(op.peak_active(r, "disk", "t", "t_end", hour), "disk")


@query(
    "conflict_pairs",
    fx.with_tables(
        "write_log",
        """WITH q AS (SELECT seq, seq // 16 AS batch, page, page + 1 + seq % 40 AS page_end FROM write_log)
        SELECT a.seq AS first_seq, b.seq AS second_seq FROM q a JOIN q b ON a.batch = b.batch AND a.seq < b.seq AND a.page < b.page_end AND b.page < a.page_end""",
    ),
)
def conflict_pairs(spark, d):
    """Operations of one admission batch (16 at most) that must keep their order."""
    q = fx.write_log(spark, d).select("seq", F.floor(F.col("seq") / 16).alias("batch"), "page", (F.col("page") + 1 + F.col("seq") % 40).alias("page_end"))
    a, b = q.alias("a"), q.alias("b")
    clash = (F.col("a.seq") < F.col("b.seq")) & (F.col("a.page") < F.col("b.page_end")) & (F.col("b.page") < F.col("a.page_end"))
    return a.join(b, F.col("a.batch") == F.col("b.batch")).filter(clash).select(F.col("a.seq").alias("first_seq"), F.col("b.seq").alias("second_seq"))
