"""State, label, gate and estimate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import views as op

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "block_colour",
    fx.with_tables("objects_full", "SELECT oid, CASE WHEN missing THEN 'missing' WHEN NOT sealed THEN 'open' WHEN oid % 19 = 0 THEN 'pinned' END AS colour FROM objects_full"),
)
def block_colour(spark, d):
    """The first of a user's tags, in order of priority, that a block has."""
    tag = lambda when, name: F.when(when, name)
    tags = F.array_compact(F.array(tag(F.col("oid") % 19 == 0, "pinned"), tag(F.col("missing"), "missing"), tag(~F.col("sealed"), "open")))
    return fx.objects_full(spark, d).select("oid", op.first_tag(tags, ["missing", "open", "pinned"]).alias("colour"))


@query(
    "action_labels",
    fx.with_tables("activity", "SELECT sequence, CASE action WHEN 'sync.started' THEN 'Sync started' WHEN 'sync.failed' THEN 'Sync failed' WHEN 'cleanup.deleted' THEN 'Old data deleted' ELSE action END AS label FROM activity"),
)
def action_labels(spark, d):
    names = {"sync.started": "Sync started", "sync.failed": "Sync failed", "cleanup.deleted": "Old data deleted"}
    return fx.activity(spark, d).select("sequence", op.labelled(F.col("action"), names).alias("label"))


DISKS = """disks AS (SELECT c_custkey AS disk, CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE (60 + c_custkey % 40) * 1048576 END AS BIGINT) AS cache_limit, c_custkey % 7 <> 0 AS online, c_custkey % 6 <> 0 AS ready,
    c_custkey % 11 = 0 AS restoring, CAST((c_custkey * 13 % 120) * 1048576 AS BIGINT) AS used, c_custkey % 3 AS readers FROM customer)"""


def disks(spark, d):
    """Disks with their cache settings."""
    k = F.col("c_custkey")
    return fx.raw(spark, d, "customer").select(
        k.alias("disk"),
        F.when(k % 5 == 0, 0).otherwise((60 + k % 40) * op.MIB).cast("long").alias("cache_limit"),
        (k % 7 != 0).alias("online"),
        (k % 6 != 0).alias("ready"),
        (k % 11 == 0).alias("restoring"),
        ((k * 13 % 120) * op.MIB).cast("long").alias("used"),
        (k % 3).alias("readers"),
    )


@query(
    "eviction_gate",
    f"""WITH {DISKS}, p AS (SELECT *, disk % 5 <> 4 AS available, disk * 7 % 40 AS pending FROM disks)
        SELECT disk, CASE WHEN cache_limit = 0 THEN 'unlimited' WHEN NOT online THEN 'offline' WHEN NOT ready THEN 'source_not_ready' WHEN NOT available THEN 'provider_unavailable'
        WHEN restoring THEN 'restore_incomplete' WHEN used <= cache_limit THEN 'within_limit' WHEN pending >= 32 THEN 'active_readers' END AS gate,
        CAST(greatest(0, least(greatest((greatest(used - cache_limit, 0) + {fx.OBJECT_SIZE - 1}) // {fx.OBJECT_SIZE}, 1), 8, 32 - pending)) AS BIGINT) AS step FROM p""",
)
def eviction_gate(spark, d):
    """Why a disk's cache is not trimmed, and how many objects the next step would take."""
    from blockloom.operators.references import eviction_count

    p = disks(spark, d).withColumns({"available": F.col("disk") % 5 != 4, "pending": F.col("disk") * 7 % 40})
    gate = op.eviction_gate(*(F.col(c) for c in ("cache_limit", "online", "ready", "available", "restoring", "used", "pending")))
    step = eviction_count(F.col("used"), F.col("cache_limit"), fx.OBJECT_SIZE, F.lit(8), F.col("pending"))
    return p.select("disk", gate.alias("gate"), step.alias("step"))


@query(
    "cache_limit_check",
    f"WITH {DISKS} SELECT disk, cache_limit, cache_limit = 0 OR (cache_limit BETWEEN 67108864 AND 8796093022208 AND cache_limit % 4194304 = 0) AS valid FROM disks",
)
def cache_limit_check(spark, d):
    return disks(spark, d).select("disk", "cache_limit", op.valid_cache_limit(F.col("cache_limit")).alias("valid"))


@query(
    "source_routing",
    fx.with_tables("objects", "SELECT oid, CASE WHEN NOT missing THEN 'local' WHEN oid % 4 = 0 THEN 'origin' WHEN oid % 7 <> 0 THEN 'own' ELSE 'error' END AS route FROM objects"),
)
def source_routing(spark, d):
    """Where the bytes of an object come from: here, the origin it was copied from, its own store, or nowhere."""
    route = op.first_match([(~F.col("missing"), "local"), (F.col("oid") % 4 == 0, "origin"), (F.col("oid") % 7 != 0, "own")], "error")
    return fx.objects(spark, d).select("oid", route.alias("route"))


@query(
    "restore_phase",
    """WITH j AS (SELECT event_id AS job, CASE event_id % 4 WHEN 0 THEN 'planning' WHEN 1 THEN 'fetching' ELSE 'building' END AS native, CASE WHEN event_id % 3 = 0 THEN 'data' ELSE 'index' END AS work FROM events)
        SELECT job, CASE WHEN native = 'building' THEN CASE WHEN work = 'data' THEN 'verifying' ELSE 'indexing' END ELSE 'downloading' END AS phase FROM j""",
)
def restore_phase(spark, d):
    """Phase shown for each restore from its native and work phases."""
    e = F.col("event_id")
    native = F.when(e % 4 == 0, "planning").when(e % 4 == 1, "fetching").otherwise("building")
    work = F.when(e % 3 == 0, "data").otherwise("index")
    return fx.raw(spark, d, "events").select(e.alias("job"), op.restore_phase(native, work).alias("phase"))


@query(
    "job_status",
    """WITH j AS (SELECT o_orderkey AS job, o_orderkey % 5 <> 4 AS preparing, o_custkey % 4 AS sealed, o_orderkey % 4 AS tails, o_orderkey % 11 = 0 AS seeding, o_custkey % 300 AS processed, o_orderkey % 200 AS changed FROM orders)
        SELECT job, CASE WHEN NOT preparing THEN 'ready' WHEN sealed < tails THEN 'sealing' WHEN seeding OR processed < changed THEN 'indexing' ELSE 'root' END AS stage FROM j""",
)
def job_status(spark, d):
    """Stage of each publication that is being prepared, from its cursors."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return fx.raw(spark, d, "orders").select(k.alias("job"), op.prepare_stage(k % 5 != 4, c % 4, k % 4, k % 11 == 0, c % 300, k % 200).alias("stage"))


@query(
    "maintenance_view",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'queued' END || ':' || CASE WHEN event_id % 2 = 0 THEN 'objects' ELSE 'bytes' END AS view,
        CASE WHEN event_id % 2 = 0 THEN event_id % 40 ELSE event_id % 40 * 8388608 END AS progress FROM events""",
)
def maintenance_view(spark, d):
    """Prefix by state and unit by kind of each maintenance task."""
    e, t, even = F.col("event_id"), F.col("event_type"), F.col("event_id") % 2 == 0
    prefix = F.when(t == "error", "failed").when(t == "view", "running").otherwise("queued")
    progress = F.when(even, e % 40).otherwise(e % 40 * fx.OBJECT_SIZE)
    return fx.raw(spark, d, "events").select("event_id", F.concat_ws(":", prefix, F.when(even, "objects").otherwise("bytes")).alias("view"), progress.alias("progress"))


@query(
    "releasable_pins",
    fx.with_tables(
        "commits",
        """SELECT volume, count(*) FILTER (root_id % 3 = 0 AND root_id % 4 <> 0) AS complete, count(*) FILTER (root_id % 3 <> 0 AND root_id % 13 = 0) AS replaced,
        count(*) FILTER ((root_id % 3 = 0 AND root_id % 4 <> 0) OR root_id % 13 = 0) AS releasable FROM commits GROUP BY volume""",
    ),
)
def releasable_pins(spark, d):
    """Reader pins that nothing needs: complete copies that are not fetched on demand, or sources that are gone."""
    done, lazy, gone = F.col("root_id") % 3 == 0, F.col("root_id") % 4 == 0, F.col("root_id") % 13 == 0
    return fx.commits(spark, d).groupBy("volume").agg(
        F.count_if(done & ~lazy).alias("complete"), F.count_if(~done & gone).alias("replaced"), F.count_if((done & ~lazy) | gone).alias("releasable")
    )


@query(
    "visible_snapshots",
    fx.with_tables("commits", "SELECT volume, root_id FROM commits WHERE root_id % 6 IN (0, 2)"),
)
def visible_snapshots(spark, d):
    """Snapshots shown to a user: not pinned, or pinned by the user."""
    pin = F.get(F.array(F.lit(""), F.lit("restore"), F.lit("user"), F.lit("replica"), F.lit("job"), F.lit("copy")), F.col("root_id") % 6)
    return fx.commits(spark, d).withColumn("pin", pin).filter(F.col("pin").isin("", "user")).select("volume", "root_id")


@query(
    "replica_view",
    """SELECT c_custkey AS disk, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'staged' END, CASE WHEN c_custkey % 3 = 0 THEN 'remote' END, 'current') AS candidate,
        c_custkey % 4 = 0 OR c_custkey % 3 = 0 AS changed, c_custkey % 4 = 0 AND c_custkey % 8 <> 0 AS ready FROM customer""",
)
def replica_view(spark, d):
    """Which version a replica would switch to, and whether it can now."""
    k = F.col("c_custkey")
    staged, remote = F.when(k % 4 == 0, "staged"), F.when(k % 3 == 0, "remote")
    return fx.raw(spark, d, "customer").select(
        k.alias("disk"), F.coalesce(staged, remote, F.lit("current")).alias("candidate"), F.coalesce(staged, remote).isNotNull().alias("changed"), (staged.isNotNull() & (k % 8 != 0)).alias("ready")
    )


@query(
    "change_tokens",
    fx.with_tables(
        "activity",
        "SELECT disk_id, run_id, max(sequence) || ':' || count(*) FILTER (level = 'error') || ':' || sum(bytes) // 4096 AS token FROM activity GROUP BY ALL",
    ),
)
def change_tokens(spark, d):
    """A token per disk and run that differs whenever what is shown differs."""
    text = lambda c: c.cast("string")
    return fx.activity(spark, d).groupBy("disk_id", "run_id").agg(
        F.concat_ws(":", text(F.max("sequence")), text(F.count_if(F.col("level") == "error")), text((F.sum("bytes") / 4096).cast("long"))).alias("token")
    )


@query(
    "volume_info",
    fx.with_tables(
        "page_map objects write_log",
        f"""SELECT (SELECT count(*) FROM page_map) AS allocated_pages, (SELECT count(DISTINCT oid) FROM page_map) AS used_objects, (SELECT max(extent) FROM objects) AS last_extent,
        (SELECT count(*) FILTER (missing) FROM objects) AS missing_objects, (SELECT count(DISTINCT page) * {fx.PAGE} FROM write_log) AS dirty_bytes""",
    ),
)
def volume_info(spark, d):
    pages, objects = fx.page_map(spark, d), fx.objects(spark, d)
    a = pages.agg(F.count(F.lit(1)).alias("allocated_pages"), F.count_distinct("oid").alias("used_objects"))
    b = objects.agg(F.max("extent").alias("last_extent"), F.count_if("missing").alias("missing_objects"))
    c = fx.write_log(spark, d).agg((F.count_distinct("page") * fx.PAGE).alias("dirty_bytes"))
    one = lambda df: df.select(F.struct("*")).scalar()
    return spark.range(1).select(one(a).alias("a"), one(b).alias("b"), one(c).alias("c")).select("a.*", "b.*", "c.*")


@query("cleanup_estimate", fx.with_tables("objects_full", f"SELECT pool, count(*) AS n, count(*) * {fx.OBJECT_SIZE} AS n_bytes FROM objects_full WHERE current_refs = 0 AND sealed AND sync_state = 3 GROUP BY pool"))
def cleanup_estimate(spark, d):
    """What deleting the unreferenced published objects would give back."""
    gone = fx.objects_full(spark, d).filter("current_refs = 0 and sealed and sync_state = 3")
    return gone.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * fx.OBJECT_SIZE).alias("n_bytes"))


@query(
    "free_bytes",
    fx.with_tables("bitmap", "SELECT byte_index // 64 AS segment, CAST(sum(8 - bit_count(b)) AS BIGINT) AS free_clusters, CAST(sum(8 - bit_count(b)) * 4096 AS BIGINT) AS n_bytes FROM bitmap GROUP BY 1"),
)
def free_bytes(spark, d):
    """Free space of each bitmap segment from the bits that are set."""
    free = F.sum(8 - F.bit_count("b")).cast("long")
    return fx.bitmap(spark, d).groupBy(F.floor(F.col("byte_index") / 64).alias("segment")).agg(free.alias("free_clusters"), (free * fx.PAGE).alias("n_bytes"))


@query(
    "next_extent",
    fx.with_tables("objects", "SELECT oid % 8 AS volume, coalesce(min(CASE WHEN missing AND oid % 1000 < 600 THEN oid END), max(oid) + 1) AS extent FROM objects GROUP BY 1"),
)
def next_extent(spark, d):
    """The lowest extent that may be used again, else the end of the file."""
    free = F.when(F.col("missing") & (F.col("oid") % 1000 < 600), F.col("oid"))
    return fx.objects(spark, d).groupBy((F.col("oid") % 8).alias("volume")).agg(F.coalesce(F.min(free), F.max("oid") + 1).alias("extent"))


@query(
    "blob_chains",
    """SELECT o_custkey AS blob, string_agg(CAST(o_orderkey AS VARCHAR), '>' ORDER BY o_orderkey) AS chain, count(*) AS frames FROM orders GROUP BY 1""",
)
def blob_chains(spark, d):
    """Frames of each blob in order of their place, as one string."""
    frames = F.array_sort(F.collect_list("o_orderkey"))
    return fx.raw(spark, d, "orders").groupBy(F.col("o_custkey").alias("blob")).agg(F.concat_ws(">", F.transform(frames, lambda x: x.cast("string"))).alias("chain"), F.count(F.lit(1)).alias("frames"))


@query("object_ids", fx.with_tables("objects", "SELECT oid, substr(sha256('vol' || oid || 'n'), 1, 16) AS prefix, oid AS from_id FROM objects"))
def object_ids(spark, d):
    """Ids made of a hash prefix and the number in little-endian bytes, and the number read back from them."""
    from blockloom.functions import binary

    k = F.col("oid")
    prefix = F.substring(F.sha2(F.concat(F.lit("vol"), k.cast("string"), F.lit("n")), 256), 1, 16)
    made = fx.objects(spark, d).select("oid", prefix.alias("prefix"), F.unhex(F.concat(prefix, binary.le_hex(k, 8))).alias("id"))
    return made.select("oid", "prefix", binary.le_number(F.col("id"), 9, 8).cast("long").alias("from_id"))
