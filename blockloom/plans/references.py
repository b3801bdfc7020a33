"""Join, reference count, reclamation and cache queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import keyed, references as op
from blockloom.sources.scratch import fresh_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("page_object_join", fx.with_tables("page_map objects", "SELECT p.page, p.oid, p.slot, o.kind, o.sealed, o.missing FROM page_map p JOIN objects o ON p.oid = o.oid"))
def page_object_join(spark, d):
    return fx.page_map(spark, d).select("page", "oid", "slot").join(fx.objects(spark, d).select("oid", "kind", "sealed", "missing"), "oid")


PLANTED_PAGES = "planted AS (SELECT page, CASE WHEN page % 29 = 0 THEN -oid WHEN page % 37 = 0 THEN oid + 5 ELSE oid END AS oid FROM page_map)"


@query("orphan_pages", fx.with_tables("page_map objects", f"WITH {PLANTED_PAGES} SELECT page, oid FROM planted WHERE oid NOT IN (SELECT oid FROM objects WHERE kind = 1)"))
def orphan_pages(spark, d):
    """Pages of a damaged mapping: some name no object, some one that holds no pages."""
    page, oid = F.col("page"), F.col("oid")
    planted = fx.pages(spark, d).select("page", F.when(page % 29 == 0, -oid).when(page % 37 == 0, oid + 5).otherwise(oid).alias("oid"))
    return op.orphans(planted, fx.objects(spark, d))


def moved(pages):
    """A second version of the mapping: every tenth page lies in another object, every 23rd is unmapped."""
    return pages.filter("page % 23 <> 0").select("page", F.when(F.col("page") % 10 == 0, F.col("oid") + 6).otherwise(F.col("oid")).alias("oid"))


MOVED = "moved AS (SELECT page, CASE WHEN page % 10 = 0 THEN oid + 6 ELSE oid END AS oid FROM page_map WHERE page % 23 <> 0)"


@query(
    "current_refs",
    fx.with_tables(
        "page_map",
        f"""WITH {MOVED}, c AS (SELECT o.oid AS was, n.oid AS now FROM page_map o FULL JOIN moved n ON o.page = n.page WHERE o.oid IS DISTINCT FROM n.oid)
        SELECT oid, CAST(sum(delta) AS BIGINT) AS delta FROM (SELECT was AS oid, -1 AS delta FROM c UNION ALL SELECT now, 1 FROM c) WHERE oid IS NOT NULL GROUP BY oid HAVING sum(delta) <> 0""",
    ),
)
def current_refs(spark, d):
    pages = fx.pages(spark, d).select("page", "oid")
    return op.reference_changes(pages, moved(pages), "page", "oid")


@query(
    "publication_counts",
    fx.with_tables(
        "page_map",
        f"""WITH {MOVED} SELECT oid, count(*) AS refs FROM moved GROUP BY oid""",
    ),
)
def publication_counts(spark, d):
    """Published counts after a change set: old counts plus signed changes, empty ones removed."""
    pages = fx.pages(spark, d).select("page", "oid")
    counts = pages.groupBy("oid").agg(F.count(F.lit(1)).alias("delta"))
    total = counts.unionByName(op.reference_changes(pages, moved(pages), "page", "oid")).groupBy("oid").agg(F.sum("delta").alias("refs")).filter("refs <> 0")
    return total.withColumn("refs", F.when(F.col("refs") < 0, F.raise_error(F.lit("negative count")).cast("long")).otherwise(F.col("refs")))


@query(
    "publication_delta",
    fx.with_tables(
        "page_map",
        """WITH o AS (SELECT DISTINCT oid FROM page_map WHERE page % 7 <> 0), n AS (SELECT DISTINCT oid FROM page_map WHERE page % 5 <> 0)
        SELECT oid, 'add' AS change FROM n WHERE oid NOT IN (SELECT oid FROM o) UNION ALL SELECT oid, 'remove' FROM o WHERE oid NOT IN (SELECT oid FROM n)""",
    ),
)
def publication_delta(spark, d):
    pages = fx.pages(spark, d).select("page", "oid")
    return op.delta(pages.filter("page % 7 <> 0"), pages.filter("page % 5 <> 0"), "oid")


@query(
    "job_objects",
    fx.with_tables("objects receipts", "SELECT o.oid, o.sealed, r.oid IS NOT NULL AS uploaded FROM objects o LEFT JOIN receipts r ON o.oid = r.oid WHERE sync_state = 1"),
)
def job_objects(spark, d):
    confirmed = fx.receipts(spark, d).withColumn("uploaded", F.lit(True))
    return fx.objects(spark, d).filter("sync_state = 1").select("oid", "sealed").join(confirmed, "oid", "left").withColumn("uploaded", F.coalesce("uploaded", F.lit(False)))


CLAIMS = "claims AS (SELECT DISTINCT 1 + (event_id * 5) % ((SELECT count(*) FROM orders) + 50) AS oid, CAST(event_id % 2 AS BIGINT) AS epoch FROM events WHERE event_type = 'signup')"


@query(
    "receipt_validate",
    fx.with_tables(
        "objects",
        f"""WITH {CLAIMS} SELECT c.oid, c.epoch, CASE WHEN c.epoch <> 0 THEN 'stale' WHEN o.oid IS NULL THEN 'unknown' WHEN NOT sealed THEN 'open' WHEN sync_state <> 1 THEN 'not_in_job' ELSE 'valid' END AS verdict
        FROM claims c LEFT JOIN objects o ON c.oid = o.oid""",
    ),
)
def receipt_validate(spark, d):
    """Every claimed receipt against the job's objects: stale epochs are ignored, the rest must match."""
    n = fx.raw(spark, d, "orders").agg(F.count(F.lit(1))).scalar()
    e = F.col("event_id")
    claims = fx.raw(spark, d, "events").filter("event_type = 'signup'").select((1 + (e * 5) % (n + 50)).alias("oid"), (e % 2).alias("epoch")).distinct()
    found = claims.join(fx.objects(spark, d).select("oid", "sealed", "sync_state"), "oid", "left")
    verdict = F.when(F.col("epoch") != 0, "stale").when(F.col("sync_state").isNull(), "unknown").when(~F.col("sealed"), "open").when(F.col("sync_state") != 1, "not_in_job")
    return found.select("oid", "epoch", verdict.otherwise("valid").alias("verdict"))


@query("source_counts", fx.with_tables("page_map", "SELECT oid, count(*) AS refs FROM (SELECT oid FROM page_map UNION ALL SELECT (o_orderkey + 1) // 8 AS oid FROM orders WHERE o_orderkey >= 7) GROUP BY oid"))
def source_counts(spark, d):
    """References of each object from pages and from the objects below it."""
    above = fx.raw(spark, d, "orders").filter("o_orderkey >= 7").select(F.floor((F.col("o_orderkey") + 1) / 8).alias("oid"))
    return fx.pages(spark, d).select("oid").unionByName(above).groupBy("oid").agg(F.count(F.lit(1)).alias("refs"))


EDGES = "edges AS (SELECT (o_orderkey + 1) // 8 AS parent, o_orderkey + 1 AS child FROM orders WHERE o_orderkey >= 7 AND o_orderkey % 17 <> 0)"
WALK = """walk AS (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS node, 0 AS depth UNION ALL SELECT e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node WHERE w.depth < 40)"""


def tree(spark, d):
    """Object dependency forest: eight below each object, some links cut."""
    edges = fx.raw(spark, d, "orders").filter("o_orderkey >= 7 and o_orderkey % 17 <> 0").select(F.floor((F.col("o_orderkey") + 1) / 8).alias("parent"), (F.col("o_orderkey") + 1).alias("child"))
    return edges, spark.range(1, 4).withColumnRenamed("id", "node")


@query("reachable_refs", f"WITH RECURSIVE {EDGES}, {WALK} SELECT node, CAST(depth AS INTEGER) AS depth, (SELECT count(*) FROM edges e WHERE e.parent = node) AS children FROM walk")
def reachable_refs(spark, d):
    """What can be reached from three roots, with the number of direct links of each."""
    edges, roots = tree(spark, d)
    children = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    return op.reachable(spark, edges, roots, fresh_path(spark, "walk")).join(children, "node", "left").withColumn("children", F.coalesce("children", F.lit(0)))


@query("restore_walk", fx.with_tables("objects", f"WITH {EDGES}, {WALK} SELECT depth, count(*) AS n, count(*) FILTER (missing) AS pending FROM walk JOIN objects ON oid = node GROUP BY depth", recursive=True))
def restore_walk(spark, d):
    """Objects of a restore by depth, and how many of them must still be fetched."""
    edges, roots = tree(spark, d)
    found = op.reachable(spark, edges, roots, fresh_path(spark, "walk")).join(fx.objects(spark, d).select(F.col("oid").alias("node"), "missing"), "node")
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("pending"))


@query(
    "tree_validate",
    """WITH n AS (SELECT o_orderkey + 1 AS id, (o_orderkey + 1) // 8 AS parent, CAST(floor(log(o_orderkey + 1.5) / log(8)) AS INTEGER) AS level, o_custkey % 50 AS base FROM orders)
        SELECT c.id, CASE WHEN p.id IS NULL THEN 'no_parent' WHEN p.level <> c.level - 1 THEN 'level' WHEN p.base > c.base THEN 'base' END AS violation
        FROM n c LEFT JOIN n p ON c.parent = p.id WHERE c.parent > 0 AND (p.id IS NULL OR p.level <> c.level - 1 OR p.base > c.base)""",
)
def tree_validate(spark, d):
    """Nodes whose parent is absent, at a wrong level or starts after them."""
    k = F.col("o_orderkey")
    level = F.floor(F.log(k + 1.5) / F.log(F.lit(8.0))).cast("int")
    n = fx.raw(spark, d, "orders").select((k + 1).alias("id"), F.floor((k + 1) / 8).alias("parent"), level.alias("level"), (F.col("o_custkey") % 50).alias("base"))
    p = n.select(F.col("id").alias("pid"), F.col("level").alias("plevel"), F.col("base").alias("pbase"))
    found = n.filter("parent > 0").join(p, F.col("parent") == F.col("pid"), "left")
    violation = F.when(F.col("pid").isNull(), "no_parent").when(F.col("plevel") != F.col("level") - 1, "level").when(F.col("pbase") > F.col("base"), "base")
    return found.select("id", violation.alias("violation")).filter("violation is not null")


PROTECTED = """protected AS (SELECT o.oid, CASE WHEN o.oid % 19 = 0 THEN 'pinned' WHEN current_refs > 0 THEN 'referenced' WHEN NOT sealed THEN 'tail' WHEN cloud_refs > 0 AND o.oid % 5 = 0 THEN 'published'
    WHEN o.oid % 29 = 0 THEN 'unknown' WHEN t.transfer_state = 'uploading' THEN 'transferring' END AS reason
    FROM objects_full o LEFT JOIN transfer t ON o.oid = t.oid WHERE kind = 1)"""


def protected(spark, d):
    """Page objects with the first reason that keeps them; counts of every 29th are unknown."""
    o = fx.objects_full(spark, d).filter("kind = 1").join(fx.transfer(spark, d), "oid", "left")
    known = F.when(F.col("oid") % 29 == 0, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return op.protection(
        o,
        [
            ("pinned", F.col("oid") % 19 == 0),
            ("referenced", F.col("current_refs") > 0),
            ("tail", ~F.col("sealed")),
            ("published", (F.col("cloud_refs") > 0) & (F.col("oid") % 5 == 0)),
            ("unknown", known),
            ("transferring", F.col("transfer_state").eqNullSafe("uploading")),
        ],
    )


@query("gc_candidates", fx.with_tables("objects_full transfer", f"WITH {PROTECTED} SELECT oid FROM protected WHERE reason IS NULL"))
def gc_candidates(spark, d):
    return protected(spark, d).filter("reason is null").select("oid")


@query("gc_protected", fx.with_tables("objects_full transfer", f"WITH {PROTECTED} SELECT reason, count(*) AS n FROM protected GROUP BY reason"))
def gc_protected(spark, d):
    return protected(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "partition_check",
    fx.with_tables(
        "objects_full transfer",
        f"""WITH {PROTECTED}, parts AS (SELECT oid, 'allowed' AS part FROM protected WHERE reason IS NULL AND oid % 97 <> 0 UNION ALL SELECT oid, 'kept' FROM protected WHERE reason IS NOT NULL
            UNION ALL SELECT oid, 'kept' FROM protected WHERE reason IS NULL AND oid % 89 = 0 UNION ALL SELECT oid + 1000000000, 'allowed' FROM protected WHERE oid % 83 = 0)
        SELECT CASE WHEN c.oid IS NULL THEN 'foreign' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'twice' ELSE 'exact' END AS verdict, count(*) AS n_objects
        FROM protected c FULL JOIN (SELECT oid, count(*) AS n FROM parts GROUP BY oid) p ON c.oid = p.oid GROUP BY 1""",
    ),
)
def partition_check(spark, d):
    """Whether allowed and protected objects together are the candidates, on parts that lack some, repeat some and hold foreign ones."""
    p = protected(spark, d)
    free, oid = F.col("reason").isNull(), F.col("oid")
    parts = [p.filter(free & (oid % 97 != 0)), p.filter(~free), p.filter(free & (oid % 89 == 0)), p.filter(oid % 83 == 0).withColumn("oid", oid + 1000000000)]
    every = parts[0].select("oid")
    for x in parts[1:]:
        every = every.unionByName(x.select("oid"))
    return op.partition_verdicts(p.select("oid"), every, "oid").groupBy("verdict").agg(F.count(F.lit(1)).alias("n_objects"))


COMPACT = """c AS (SELECT o.oid, o.oid % 8 AS volume, o.extent // 8 + 1 AS extent, o.sealed AND o.oid % 19 <> 0 AND t.transfer_state IS NULL AS movable
    FROM objects_full o LEFT JOIN transfer t ON o.oid = t.oid WHERE o.extent IS NOT NULL AND o.oid % 5 <> 2)"""


def compactable(spark, d):
    o = fx.objects_full(spark, d).filter("extent is not null and oid % 5 <> 2").join(fx.transfer(spark, d), "oid", "left")
    movable = F.col("sealed") & (F.col("oid") % 19 != 0) & F.col("transfer_state").isNull()
    return o.select("oid", (F.col("oid") % 8).alias("volume"), (F.floor(F.col("extent") / 8) + 1).alias("extent"), movable.alias("movable"))


@query("compact_plan", fx.with_tables("objects_full transfer", f"WITH {COMPACT} SELECT volume, count(*) AS n, count(*) FILTER (movable) AS movable, max(extent) AS highest FROM c GROUP BY volume"))
def compact_plan(spark, d):
    return compactable(spark, d).groupBy("volume").agg(F.count(F.lit(1)).alias("n"), F.count_if("movable").alias("movable"), F.max("extent").alias("highest"))


@query(
    "relocation_plan",
    fx.with_tables(
        "objects_full transfer",
        f"""WITH {COMPACT}, every AS (SELECT volume, unnest(range(1, max(extent) + 1)) AS e FROM c GROUP BY volume),
        free AS (SELECT volume, e, row_number() OVER (PARTITION BY volume ORDER BY e) AS k FROM every WHERE (volume, e) NOT IN (SELECT (volume, extent) FROM c)),
        m AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY extent DESC) AS k FROM c WHERE movable)
        SELECT m.volume, m.oid, m.extent AS from_extent, f.e AS to_extent FROM m JOIN free f ON m.volume = f.volume AND m.k = f.k WHERE f.e < m.extent""",
    ),
)
def relocation_plan(spark, d):
    c = compactable(spark, d)
    return op.relocations(c, "volume", F.col("movable"), c.groupBy("volume").agg(F.max("extent").alias("n")))


@query(
    "tail_truncate",
    fx.with_tables("objects", "SELECT oid % 8 AS volume, max(CASE WHEN oid % 100 < 80 THEN extent END) AS last_used, max(oid) - max(CASE WHEN oid % 100 < 80 THEN extent END) AS released FROM objects GROUP BY 1"),
)
def tail_truncate(spark, d):
    """Highest extent still in use per volume, and what the end of the file gives back."""
    last = F.max(F.when(F.col("oid") % 100 < 80, F.col("extent")))
    return fx.objects(spark, d).groupBy((F.col("oid") % 8).alias("volume")).agg(last.alias("last_used"), (F.max("oid") - last).alias("released"))


@query(
    "reusable_extents",
    fx.with_tables(
        "objects",
        """SELECT oid AS extent, oid % 1000 AS retired_seq FROM objects WHERE missing AND oid % 1000 < (SELECT min(500 + n_nationkey * 10) FROM nation WHERE n_regionkey <> 0) AND oid % 1000 <= 900""",
    ),
)
def reusable_extents(spark, d):
    """Free extents that no active reader can still see."""
    oldest = fx.raw(spark, d, "nation").filter("n_regionkey <> 0").agg(F.min(F.col("n_nationkey") * 10 + 500)).scalar()
    retired = F.col("oid") % 1000
    return fx.objects(spark, d).filter("missing").select(F.col("oid").alias("extent"), retired.alias("retired_seq")).filter((F.col("retired_seq") < oldest) & (F.col("retired_seq") <= 900))


READS = f"""reads AS (SELECT *, (tick // 32) % 8 AS disk FROM read_log), marked AS (SELECT *, off // {fx.OBJECT_SIZE} AS object,
    off = coalesce(lag(off + len) OVER w, 0) AS seq, off = coalesce(lag(off + len) OVER w, 0) AND coalesce(lag(off // {fx.OBJECT_SIZE}) OVER w = off // {fx.OBJECT_SIZE}, FALSE) AS again,
    CAST(coalesce(off <> lag(off + len) OVER w, TRUE) AS INTEGER) AS start FROM reads WINDOW w AS (PARTITION BY disk ORDER BY tick)),
    heat AS (SELECT disk, object, max(tick) AS last, count(*) FILTER (NOT again) AS frequency, arg_max(seq, tick) AS sequential FROM marked GROUP BY disk, object)"""


def reads(spark, d):
    return fx.read_log(spark, d).withColumn("disk", F.floor(F.col("tick") / 32) % 8)


def heat(spark, d):
    return op.heat(reads(spark, d), "disk", "tick", "off", "len", fx.OBJECT_SIZE)


@query("object_heat", fx.with_tables("read_log", f"WITH {READS} SELECT * FROM heat"))
def object_heat(spark, d):
    return heat(spark, d)


@query(
    "read_streaks",
    fx.with_tables(
        "read_log",
        f"""WITH r AS (SELECT (tick // 32) % 8 AS disk, tick, off, CASE WHEN tick % 5 = 4 THEN 4096 ELSE len END AS len FROM read_log),
        s AS (SELECT *, sum(start) OVER (PARTITION BY disk ORDER BY tick) AS streak FROM (
            SELECT *, CASE WHEN off = lag(off + len) OVER (PARTITION BY disk ORDER BY tick) THEN 0 ELSE 1 END AS start FROM r WHERE len >= 65536)),
        g AS (SELECT disk, min(tick) AS first_tick, count(*) AS reads, CAST(sum(len) AS BIGINT) AS n_bytes FROM s GROUP BY disk, streak)
        SELECT *, CAST(CASE WHEN reads >= 3 THEN least(8, 1 + least(n_bytes, 8 * {fx.OBJECT_SIZE}) // {fx.OBJECT_SIZE}) ELSE 0 END AS BIGINT) AS prefetch FROM g""",
    ),
)
def read_streaks(spark, d):
    """Streaks of adjoining reads and what to fetch ahead; some reads are shorter than 64 KiB and do not count."""
    short = reads(spark, d).withColumn("len", F.when(F.col("tick") % 5 == 4, F.lit(4096).cast("long")).otherwise(F.col("len")))
    found = op.streaks(short, "disk", "tick", "off", "len")
    return found.withColumn("prefetch", op.prefetch_objects(F.col("n_bytes"), F.col("reads"), fx.OBJECT_SIZE, 8))


CANDIDATES = f"""{READS}, warm AS (SELECT disk * 600 + object * 6 + 1 AS oid, max(last) AS last, CAST(sum(frequency) AS BIGINT) AS frequency, arg_max(sequential, last) AS sequential FROM heat GROUP BY 1),
    c AS (SELECT o.oid, coalesce(last, 0) AS last, coalesce(frequency, 0) AS frequency, NOT coalesce(sequential, FALSE) AS not_sequential
    FROM objects o LEFT JOIN warm w ON o.oid = w.oid WHERE kind = 1 AND sealed AND NOT missing AND o.oid % 19 <> 0)"""


def eviction(policy: str):
    def run(spark, d):
        """The next eight objects to evict from the cache: a top-k report by definition."""
        warm = heat(spark, d).groupBy((F.col("disk") * 600 + F.col("object") * 6 + 1).alias("oid")).agg(
            F.max("last").alias("last"), F.sum("frequency").alias("frequency"), F.max_by("sequential", "last").alias("sequential")
        )
        candidates = fx.objects(spark, d).filter("kind = 1 and sealed and not missing and oid % 19 <> 0").select("oid")
        return op.evict(candidates, warm, policy, 8)

    return run


for _name, _policy in (("evict_topk_lru", "lru"), ("evict_topk_lfu", "lfu"), ("evict_topk_seq", "sequential")):
    query(_name, fx.with_tables("objects read_log", f"WITH {CANDIDATES} SELECT * FROM c ORDER BY {', '.join(op.POLICIES[_policy])}, oid LIMIT 8"))(eviction(_policy))


@query(
    "evict_step",
    fx.with_tables(
        "objects read_log transfer",
        f"""WITH {READS}, warm AS (SELECT disk * 600 + object * 6 + 1 AS oid, max(last) AS last, CAST(sum(frequency) AS BIGINT) AS frequency, arg_max(sequential, last) AS sequential FROM heat GROUP BY 1),
        w AS (SELECT * FROM objects WHERE oid >= 601 ORDER BY oid LIMIT 128), n AS (SELECT CASE WHEN count(*) = 128 THEN max(oid) + 1 ELSE 1 END AS next_cursor FROM w)
        SELECT w.oid, coalesce(last, 0) AS last, coalesce(frequency, 0) AS frequency, NOT coalesce(sequential, FALSE) AS not_sequential, CAST(next_cursor AS BIGINT) AS next_cursor FROM w JOIN n ON TRUE LEFT JOIN warm ON w.oid = warm.oid
        LEFT JOIN transfer t ON w.oid = t.oid WHERE kind = 1 AND sealed AND NOT missing AND w.oid % 19 <> 0 AND w.oid % 53 <> 0 AND coalesce(transfer_state, '') <> 'uploading' ORDER BY frequency, last, w.oid LIMIT 8""",
    ),
)
def evict_step(spark, d):
    """One step of eviction by frequency from a cursor: pinned objects, tails and those being uploaded stay."""
    warm = heat(spark, d).groupBy((F.col("disk") * 600 + F.col("object") * 6 + 1).alias("oid")).agg(
        F.max("last").alias("last"), F.sum("frequency").alias("frequency"), F.max_by("sequential", "last").alias("sequential")
    )
    objects = fx.objects(spark, d).join(fx.transfer(spark, d), "oid", "left")
    eligible = F.expr("kind = 1 and sealed and not missing and oid % 19 <> 0 and oid % 53 <> 0 and coalesce(transfer_state, '') <> 'uploading'")
    return op.evict_step(objects, eligible, warm, "lfu", 601, 8)


@query(
    "cache_trim",
    fx.with_tables("read_log", f"WITH {READS} SELECT disk, object, last, frequency * 262144 AS n_bytes, sum(frequency * 262144) OVER (PARTITION BY disk ORDER BY last DESC, object) <= 67108864 AS kept FROM heat"),
)
def cache_trim(spark, d):
    """Entries by recency while their bytes fit the limit."""
    size = (F.col("frequency") * 262144).alias("n_bytes")
    rows = heat(spark, d).select("disk", "object", "last", size)
    return rows.withColumn("kept", F.sum("n_bytes").over(Window.partitionBy("disk").orderBy(F.desc("last"), "object")) <= 67108864)


@query(
    "lazy_needs",
    fx.with_tables("page_map objects", "SELECT o.oid, min(page) AS first_page, count(*) AS n_pages FROM page_map p JOIN objects o ON p.oid = o.oid WHERE page >= 1000 AND page < 5096 AND missing GROUP BY o.oid ORDER BY o.oid LIMIT 16"),
)
def lazy_needs(spark, d):
    """Objects to fetch before a range of 4096 pages can be read, sixteen at a time."""
    wanted = keyed.range_scan(fx.pages(spark, d).select("page", "oid"), "page", 1000, 5096)
    missing = wanted.join(fx.objects(spark, d).filter("missing").select("oid"), "oid")
    return missing.groupBy("oid").agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n_pages")).orderBy("oid").limit(16)


@query("snapshot_manifest", fx.with_tables("page_map objects", "SELECT o.oid, o.kind, o.sealed, count(*) AS pages FROM page_map p JOIN objects o ON p.oid = o.oid GROUP BY ALL"))
def snapshot_manifest(spark, d):
    used = fx.pages(spark, d).groupBy("oid").agg(F.count(F.lit(1)).alias("pages"))
    return used.join(fx.objects(spark, d).select("oid", "kind", "sealed"), "oid")


@query(
    "import_objects",
    fx.with_tables(
        "objects",
        """SELECT i.oid, CASE WHEN o.oid IS NULL THEN 'imported' WHEN i.sha = sha256(CAST(o.oid AS VARCHAR)) THEN 'present' ELSE 'collision' END AS outcome
        FROM (SELECT oid * 5 AS oid, CASE WHEN oid % 7 = 0 THEN 'bad' ELSE sha256(CAST(oid * 5 AS VARCHAR)) END AS sha FROM objects) i LEFT JOIN objects o ON i.oid = o.oid""",
    ),
)
def import_objects(spark, d):
    """Incoming objects: new ones are imported, equal ones are present already, others collide."""
    have = fx.objects(spark, d).select("oid", F.sha2(F.col("oid").cast("string"), 256).alias("have"))
    k = F.col("oid")
    come = fx.objects(spark, d).select((k * 5).alias("oid"), F.when(k % 7 == 0, "bad").otherwise(F.sha2((k * 5).cast("string"), 256)).alias("sha"))
    outcome = F.when(F.col("have").isNull(), "imported").when(F.col("have") == F.col("sha"), "present").otherwise("collision")
    return come.join(have, "oid", "left").select("oid", outcome.alias("outcome"))


@query(
    "commit_gate",
    fx.with_tables(
        "objects receipts",
        """SELECT pool, count(*) AS n_add, count(r.oid) AS n_receipts, count(*) = count(r.oid) AS ready, CASE WHEN count(r.oid) = 0 THEN 'prepared' WHEN count(*) = count(r.oid) THEN 'ready' ELSE 'uploading' END AS stage,
        (count(*) - count(r.oid)) * 8388608 AS remaining_bytes FROM objects o LEFT JOIN receipts r ON o.oid = r.oid WHERE sync_state = 1 GROUP BY pool""",
    ),
)
def commit_gate(spark, d):
    """A job may publish when every object it adds has its receipt."""
    add = fx.objects(spark, d).filter("sync_state = 1").select("oid", "pool").join(fx.receipts(spark, d).withColumn("r", F.lit(1)), "oid", "left")
    n, done = F.count(F.lit(1)), F.count("r")
    stage = F.when(done == 0, "prepared").when(n == done, "ready").otherwise("uploading")
    return add.groupBy("pool").agg(n.alias("n_add"), done.alias("n_receipts"), (n == done).alias("ready"), stage.alias("stage"), ((n - done) * fx.OBJECT_SIZE).alias("remaining_bytes"))
