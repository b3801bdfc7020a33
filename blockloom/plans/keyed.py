"""Queries over ordered keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import keyed as op

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


COLUMNS = "page, oid, slot"


def pages(spark, d):
    return fx.page_map(spark, d).select("page", "oid", "slot")


@query("point_lookup", fx.with_tables("page_map", f"SELECT {COLUMNS} FROM page_map WHERE page = 11"))
def point_lookup(spark, d):
    return op.point_lookup(pages(spark, d), "page", 11)


@query(
    "multi_get",
    fx.with_tables("page_map", f"SELECT k.page, k.ordinal, p.oid, p.slot FROM (SELECT e.event_id * 3 AS page, e.event_id AS ordinal FROM events e WHERE e.event_type = 'click') k LEFT JOIN page_map p ON k.page = p.page"),
)
def multi_get(spark, d):
    keys = fx.raw(spark, d, "events").filter("event_type = 'click'").select((F.col("event_id") * 3).alias("page"), F.col("event_id").alias("ordinal"))
    return op.multi_get(pages(spark, d), keys, "page").select("page", "ordinal", "oid", "slot")


@query("scan_after", fx.with_tables("page_map", f"SELECT {COLUMNS} FROM page_map WHERE page >= 1000 ORDER BY page LIMIT 100"))
def scan_after(spark, d):
    return op.scan_after(pages(spark, d), "page", 1000, 100)


@query("range_scan", fx.with_tables("page_map", f"SELECT {COLUMNS} FROM page_map WHERE page >= 2000 AND page < 6000"))
def range_scan(spark, d):
    return op.range_scan(pages(spark, d), "page", 2000, 6000)


@query(
    "leaf_budget_scan",
    fx.with_tables(
        "page_map",
        f"SELECT {COLUMNS} FROM (SELECT *, dense_rank() OVER (ORDER BY page >> 4) AS leaf FROM page_map WHERE page >= 333) WHERE leaf <= 5 ORDER BY page LIMIT 40",
    ),
)
def leaf_budget_scan(spark, d):
    return op.leaf_budget_scan(pages(spark, d), "page", 333, 40, 4, 5).select("page", "oid", "slot")


@query("rank_page", fx.with_tables("page_map", f"SELECT {COLUMNS} FROM page_map ORDER BY page LIMIT 50 OFFSET 500"))
def rank_page(spark, d):
    return op.rank_page(pages(spark, d), "page", 500, 50)


@query(
    "rank_of_key",
    fx.with_tables("page_map", "SELECT CAST(k AS BIGINT) AS key, (SELECT count(*) FROM page_map WHERE page < k) AS rank FROM (VALUES (0), (100), (4321), (1000000000)) v(k)"),
)
def rank_of_key(spark, d):
    return op.rank_of_key(pages(spark, d), "page", [0, 100, 4321, 1_000_000_000])


@query("cardinality", fx.with_tables("page_map", "SELECT count(*) AS n_pages, count(DISTINCT oid) AS n_objects FROM page_map"))
def cardinality(spark, d):
    return pages(spark, d).agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("oid").alias("n_objects"))


UPDATES = """updates AS (SELECT page, arg_max(op, seq) AS op, arg_max(digest, seq) AS digest FROM (
    SELECT page, CASE WHEN op = 'zero' THEN 'delete' ELSE 'upsert' END AS op, coalesce(digest, '') AS digest, seq FROM write_log) GROUP BY page)"""


@query(
    "apply_upserts",
    fx.with_tables(
        "page_map write_log",
        f"""WITH {UPDATES} SELECT coalesce(b.page, u.page) AS page, CASE WHEN u.op = 'upsert' THEN u.digest ELSE b.digest END AS digest,
        coalesce(u.op = 'upsert', FALSE) AND u.digest IS DISTINCT FROM b.digest AS changed
        FROM page_map b FULL JOIN updates u ON b.page = u.page WHERE u.op IS NULL OR u.op <> 'delete'""",
    ),
)
def apply_upserts(spark, d):
    log = fx.write_log(spark, d).select("page", "seq", F.when(F.col("op") == "zero", "delete").otherwise("upsert").alias("op"), F.coalesce("digest", F.lit("")).alias("digest"))
    return op.apply_upserts(fx.page_map(spark, d), op.last_per_key(log, ["page"], "seq", "op", "digest"), "page", "digest")


@query("range_delete", fx.with_tables("page_map", f"SELECT {COLUMNS} FROM page_map WHERE page < 3000 OR page >= 9000"))
def range_delete(spark, d):
    return op.range_delete(pages(spark, d), "page", 3000, 9000)


@query(
    "keyset_page",
    fx.with_tables("page_map", f"SELECT page, oid, slot, (SELECT count(*) FROM page_map WHERE page > 777) > 64 AS has_more FROM page_map WHERE page > 777 ORDER BY page LIMIT 64"),
)
def keyset_page(spark, d):
    return op.keyset_page(pages(spark, d), "page", 777, 64)


@query(
    "snapshot_list",
    fx.with_tables("commits", "SELECT volume, generation, root_id FROM commits WHERE volume = 3 ORDER BY generation, root_id LIMIT 16 OFFSET 16"),
)
def snapshot_list(spark, d):
    rows = fx.commits(spark, d).filter("volume = 3").select("volume", "generation", "root_id")
    return rows.orderBy("generation", "root_id").offset(16).limit(16)


@query(
    "volume_read",
    fx.with_tables(
        "page_map objects",
        """SELECT r.page, p.oid, p.slot, CASE WHEN p.oid IS NULL THEN 'hole' WHEN o.missing THEN 'hydrate' ELSE 'data' END AS residency
        FROM (SELECT unnest(range(100, 4196)) AS page) r LEFT JOIN page_map p ON r.page = p.page LEFT JOIN objects o ON p.oid = o.oid""",
    ),
)
def volume_read(spark, d):
    """Pages of a byte range: holes read as zeros, pages of missing objects must be fetched first."""
    wanted = spark.range(100, 4196).withColumnRenamed("id", "page")
    found = wanted.join(pages(spark, d), "page", "left").join(fx.objects(spark, d).select("oid", "missing"), "oid", "left")
    residency = F.when(F.col("oid").isNull(), "hole").when(F.col("missing"), "hydrate").otherwise("data")
    return found.select("page", "oid", "slot", residency.alias("residency"))


@query(
    "debug_pages",
    fx.with_tables(
        "page_map objects",
        """SELECT r.page, p.oid, p.slot, o.kind, o.sealed, r.page + 1 AS next_page FROM (SELECT unnest(range(64, 192)) AS page) r
        LEFT JOIN page_map p ON r.page = p.page LEFT JOIN objects o ON p.oid = o.oid""",
    ),
)
def debug_pages(spark, d):
    """Dense listing of 128 pages, nulls for holes."""
    every = spark.range(64, 192).withColumnRenamed("id", "page")
    found = every.join(pages(spark, d), "page", "left").join(fx.objects(spark, d).select("oid", "kind", "sealed"), "oid", "left")
    return found.select("page", "oid", "slot", "kind", "sealed", (F.col("page") + 1).alias("next_page"))


@query(
    "write_fold",
    fx.with_tables(
        "write_log",
        """WITH l AS (SELECT *, lag(digest) OVER w AS before, lag(op) OVER w AS op_before FROM write_log WINDOW w AS (PARTITION BY volume_id, page ORDER BY seq))
        SELECT volume_id, page, arg_max(coalesce(digest, ''), seq) AS digest, max(seq) AS seq, count(*) FILTER (op_before IS NULL OR digest IS DISTINCT FROM before) AS versions,
        count(*) FILTER (op_before IS NOT NULL AND digest IS NOT DISTINCT FROM before) AS repeated FROM l GROUP BY volume_id, page HAVING arg_max(op, seq) <> 'zero'""",
    ),
)
def write_fold(spark, d):
    """Pages after the write log: last writer wins, zeros unmap, equal contents make no version."""
    from pyspark.sql import Window

    w = Window.partitionBy("volume_id", "page").orderBy("seq")
    log = fx.write_log(spark, d).withColumn("fresh", F.lag("op").over(w).isNull() | ~F.col("digest").eqNullSafe(F.lag("digest").over(w)))
    folded = log.groupBy("volume_id", "page").agg(
        F.max_by(F.struct("op", "digest"), "seq").alias("last"), F.max("seq").alias("seq"), F.count_if("fresh").alias("versions"), F.count_if(~F.col("fresh")).alias("repeated")
    )
    return folded.filter("last.op <> 'zero'").select("volume_id", "page", F.col("last.digest").alias("digest"), "seq", "versions", "repeated")


@query(
    "trim_apply",
    fx.with_tables(
        "write_log",
        """WITH trims AS (SELECT 'v' || (n_nationkey % 3) AS volume_id, n_nationkey * 10 AS first, n_nationkey * 10 + 5 + n_regionkey AS last, n_nationkey * 100 AS seq FROM nation),
        live AS (SELECT volume_id, page, max(seq) AS seq FROM write_log WHERE op = 'write' GROUP BY ALL)
        SELECT volume_id, page, seq FROM live l WHERE NOT EXISTS (SELECT 1 FROM trims t WHERE t.volume_id = l.volume_id AND l.page BETWEEN t.first AND t.last AND t.seq > l.seq)""",
    ),
)
def trim_apply(spark, d):
    """Written pages that no later trim of their range removed."""
    n = F.col("n_nationkey").cast("long")
    trims = fx.raw(spark, d, "nation").select(
        F.concat(F.lit("v"), (n % 3).cast("string")).alias("tv"), (n * 10).alias("tfirst"), (n * 10 + 5 + F.col("n_regionkey").cast("long")).alias("tlast"), (n * 100).alias("ts")
    )
    live = fx.write_log(spark, d).filter("op = 'write'").groupBy("volume_id", "page").agg(F.max("seq").alias("seq"))
    return op.after_trims(live, trims)


@query(
    "pack_slots",
    fx.with_tables(
        "page_map objects",
        """SELECT page, pool, (n - 1) // 2015 AS object_ordinal, (n - 1) % 2015 AS slot, count(*) OVER (PARTITION BY pool, (n - 1) // 2015) = 2015 AS sealed
        FROM (SELECT p.page, o.pool, row_number() OVER (PARTITION BY o.pool ORDER BY p.page) AS n FROM page_map p JOIN objects o ON p.oid = o.oid)""",
    ),
)
def pack_slots(spark, d):
    """Pages appended to their pool's objects: 2015 slots each, full ones sealed."""
    from blockloom.operators.packing import pack_slots as pack

    rows = pages(spark, d).select("page", "oid").join(fx.objects(spark, d).select("oid", "pool"), "oid").select("page", "pool")
    return pack(rows, "pool", "page", 2015)


@query(
    "integrity_check",
    fx.with_tables("page_map", "SELECT page, CASE WHEN page % 53 = 0 THEN sha256('x' || page) WHEN page % 59 = 0 THEN NULL ELSE digest END IS NOT DISTINCT FROM sha256(CAST(page AS VARCHAR)) AS intact FROM page_map"),
)
def integrity_check(spark, d):
    """Whether each page's bytes have the digest stored for it; some digests are damaged, some lost."""
    page = F.col("page")
    stored = F.when(page % 53 == 0, F.sha2(F.concat(F.lit("x"), page.cast("string")), 256)).when(page % 59 != 0, F.col("digest"))
    return fx.page_map(spark, d).select("page", stored.eqNullSafe(F.sha2(page.cast("string"), 256)).alias("intact"))


@query(
    "page_math",
    f"""SELECT event_id, (event_id * 1000 + 4095) // 4096 AS pages_needed, (event_id * 1000) // 4096 * 4096 AS aligned, least(greatest(event_id % 300, 1), 128) AS clamped,
        greatest(event_id - 5000, 0) AS saturated, event_id >> 6 AS leaf, event_id & 63 AS slot FROM events""",
)
def page_math(spark, d):
    from blockloom.functions import numbers as nf

    e = F.col("event_id")
    return fx.raw(spark, d, "events").select(
        "event_id",
        nf.ceil_div(e * 1000, 4096).alias("pages_needed"),
        nf.align_down(e * 1000, 4096).alias("aligned"),
        nf.clamp(e % 300, 1, 128).alias("clamped"),
        nf.saturating_sub(e, F.lit(5000)).alias("saturated"),
        F.shiftright(e, 6).alias("leaf"),
        e.bitwiseAND(F.lit(63)).alias("slot"),
    )


@query(
    "allocation_range",
    """SELECT d AS depth, CASE WHEN l >> d < 2048 THEN NULL ELSE greatest(l - (l >> d), 1) END AS range_start, CASE WHEN l >> d < 2048 THEN NULL ELSE l - (l >> d) // 2 END AS range_end
        FROM (SELECT CAST(unnest(range(0, 40)) AS INTEGER) AS d, CAST(4611686018427387904 AS BIGINT) AS l)""",
)
def allocation_range(spark, d):
    """Id range of an allocation depth; null where what remains is too small."""
    depth = spark.range(0, 40, 1, 1).select(F.col("id").cast("int").alias("depth"))
    limit = F.lit(1 << 62)
    rem = F.expr(f"shiftright({1 << 62}L, depth)")
    big = rem >= 2048
    return depth.select("depth", F.when(big, F.greatest(limit - rem, F.lit(1))).alias("range_start"), F.when(big, limit - F.floor(rem / 2).cast("long")).alias("range_end"))
