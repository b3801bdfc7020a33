"""Queries over logs, views and byte formats whose rules go by the whole record: replay, filters, projections, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.functions import binary, crypto, text
from blockloom.operators import catalog as cat_op, references as ref_op, replay as op, runs
from blockloom.plans.catalog import VIEW, saved_view, viewed
from blockloom.plans.references import EDGES, tree
from blockloom.sources import transport
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


TRANSACTIONS = """e AS (SELECT user_id % 101 AS dir, event_id, row_number() OVER (PARTITION BY user_id % 101 ORDER BY event_id) AS seq FROM events),
    l AS (SELECT dir, seq, CASE WHEN seq % 4 = 1 THEN 'begin' WHEN seq % 4 = 2 AND event_id % 1999 <> 7 THEN 'commit' ELSE 'patch' END AS kind, CASE WHEN seq % 4 IN (1, 2) THEN seq // 4 END AS mutation,
        CASE WHEN event_id % 2503 = 9 THEN 'c0' ELSE 'c1' END AS checkpoint, event_id % 3001 <> 11 AS sum_ok,
        CASE WHEN seq % 4 <> 1 THEN 'f' || (event_id % 37) END AS upserted, CASE WHEN seq % 4 <> 1 AND event_id % 3 = 0 THEN 'f' || (event_id * 5 % 37) END AS removed FROM e),
    t AS (SELECT *, row_number() OVER (PARTITION BY dir, mutation ORDER BY seq) AS turn FROM l),
    v AS (SELECT dir, count(*) AS records, bool_and(sum_ok AND checkpoint = 'c1' AND ((kind = 'begin' AND mutation IS NOT NULL AND upserted IS NULL AND removed IS NULL) OR (kind = 'commit' AND mutation IS NOT NULL)
        OR (kind = 'patch' AND mutation IS NULL)) AND (mutation IS NULL OR CASE WHEN turn % 2 = 1 THEN kind = 'begin' ELSE kind = 'commit' END))
        AND min(seq) = 1 AND max(seq) = count(*) AND count(*) FILTER (kind = 'begin') = count(*) FILTER (kind = 'commit') AS valid FROM t GROUP BY dir)"""


def transactions(spark, d):
    """Directory logs with begins, commits and patches; some lack a commit, name another checkpoint or have a bad sum."""
    e, seq = F.col("event_id"), F.col("seq")
    rows = runs.running(fx.raw(spark, d, "events").select((F.col("user_id") % 101).alias("dir"), e), ["dir"], ["event_id"], "seq", F.lit(1).cast("long"))
    kind = F.when(seq % 4 == 1, "begin").when((seq % 4 == 2) & (e % 1999 != 7), "commit").otherwise("patch")
    name = lambda x: F.concat(F.lit("f"), x.cast("string"))
    return rows.select(
        "dir",
        "seq",
        kind.alias("kind"),
        F.when((seq % 4).isin(1, 2), F.floor(seq / 4)).alias("mutation"),
        F.when(e % 2503 == 9, "c0").otherwise("c1").alias("checkpoint"),
        (e % 3001 != 11).alias("sum_ok"),
        F.when(seq % 4 != 1, name(e % 37)).alias("upserted"),
        F.when((seq % 4 != 1) & (e % 3 == 0), name(e * 5 % 37)).alias("removed"),
    )


@query("wal_transactions", f"WITH {TRANSACTIONS} SELECT dir, records, valid FROM v")
def wal_transactions(spark, d):
    return op.sound_logs(transactions(spark, d), "dir", "c1")


@query(
    "wal_entries",
    f"""WITH {TRANSACTIONS}, x AS (SELECT dir, seq, 0 AS phase, upserted AS item FROM l UNION ALL SELECT dir, seq, 1, removed FROM l)
        SELECT dir, item FROM x WHERE item IS NOT NULL AND dir IN (SELECT dir FROM v WHERE valid) GROUP BY dir, item HAVING arg_max(phase, seq * 2 + phase) = 0""",
)
def wal_entries(spark, d):
    """Entries of sound directories: each record's upserts come before its removes."""
    log = transactions(spark, d)
    good = op.sound_logs(log, "dir", "c1").filter("valid").select("dir")
    return op.entries_after(log.join(good, "dir", "left_semi"), ["dir"], "upserted", "removed", "upserted")


CACHE = """e AS (SELECT user_id % 89 AS cache, event_id, row_number() OVER (PARTITION BY user_id % 89 ORDER BY event_id) AS seq FROM events),
    p AS (SELECT cache, seq, CASE WHEN event_id % 1511 = 3 THEN 'lost' ELSE 't' || (seq - 1) END AS before, 't' || seq AS after, event_id % 2111 <> 5 AS sum_ok, event_id % 6 AS set_id, event_id % 97 = 0 AS reset,
        'i' || (event_id % 61) AS removed, CASE WHEN event_id % 5 <> 0 THEN 'i' || (event_id * 7 % 61) END AS added FROM e),
    v AS (SELECT cache FROM p GROUP BY cache HAVING bool_and(before = 't' || (seq - 1)) AND bool_and(sum_ok))"""


@query(
    "cache_replay",
    f"""WITH {CACHE}, r AS (SELECT cache, set_id, max(seq) FILTER (reset) AS last FROM p GROUP BY ALL), k AS (SELECT p.* FROM p JOIN r ON p.cache = r.cache AND p.set_id = r.set_id WHERE p.seq >= coalesce(last, 0) AND p.cache IN (SELECT cache FROM v)),
        x AS (SELECT cache, set_id, seq, 0 AS phase, removed AS item FROM k UNION ALL SELECT cache, set_id, seq, 1, added FROM k)
        SELECT cache, set_id, item FROM x WHERE item IS NOT NULL GROUP BY ALL HAVING arg_max(phase, seq * 2 + phase) = 1""",
)
def cache_replay(spark, d):
    """Sets of sound caches after patches that remove, then add, some after a reset; a broken chain invalidates a cache."""
    e, seq = F.col("event_id"), F.col("seq")
    rows = runs.running(fx.raw(spark, d, "events").select((F.col("user_id") % 89).alias("cache"), e), ["cache"], ["event_id"], "seq", F.lit(1).cast("long"))
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    log = rows.select(
        "cache",
        "seq",
        F.when(e % 1511 == 3, "lost").otherwise(name("t", seq - 1)).alias("before"),
        name("t", seq).alias("after"),
        (e % 2111 != 5).alias("sum_ok"),
        (e % 6).alias("set_id"),
        (e % 97 == 0).alias("reset"),
        name("i", e % 61).alias("removed"),
        F.when(e % 5 != 0, name("i", e * 7 % 61)).alias("added"),
    )
    good = op.sound_chain(log, "cache").filter("valid").select("cache")
    resets = log.groupBy("cache", "set_id").agg(F.max(F.when(F.col("reset"), F.col("seq"))).alias("last"))
    kept = log.join(good, "cache", "left_semi").join(resets, ["cache", "set_id"]).filter(F.col("seq") >= F.coalesce("last", F.lit(0)))
    return op.entries_after(kept, ["cache", "set_id"], "removed", "added", "added")


@query(
    "receipt_rules",
    """WITH e AS (SELECT user_id % 499 AS job, event_id, row_number() OVER (PARTITION BY user_id % 499 ORDER BY event_id) - 1 AS idx FROM events),
        p AS (SELECT job, idx, CASE WHEN event_id % 29 = 1 THEN 1 ELSE 2 END AS epoch, event_id % 23 <> 3 AS link_ok, event_id % 140 AS n, event_id * 5 % 3000 AS oid, event_id % 41 <> 7 AS is_member FROM e),
        s AS (SELECT job, min(idx) FILTER (epoch <> 2 OR NOT link_ok OR n NOT BETWEEN 1 AND 128) AS stop, min(idx) FILTER (epoch = 2 AND (NOT link_ok OR n NOT BETWEEN 1 AND 128)) AS torn FROM p GROUP BY job)
        SELECT p.job, count(*) FILTER (stop IS NULL OR idx < stop) AS n_pages, count(DISTINCT oid) FILTER (stop IS NULL OR idx < stop) AS n_objects, coalesce(max(torn) = max(stop), FALSE) AS uncertain,
        coalesce(bool_or((stop IS NULL OR idx < stop) AND NOT is_member), FALSE) OR count(DISTINCT oid) FILTER (stop IS NULL OR idx < stop) < count(*) FILTER (stop IS NULL OR idx < stop) AS broken
        FROM p JOIN s ON p.job = s.job GROUP BY p.job""",
)
def receipt_rules(spark, d):
    """What receipt logs hold up to their end, whether the end is certain, and whether an object does not belong."""
    e = F.col("event_id")
    rows = runs.running(fx.raw(spark, d, "events").select((F.col("user_id") % 499).alias("job"), e), ["job"], ["event_id"], "idx", F.lit(1).cast("long"))
    pages = rows.select(
        "job", (F.col("idx") - 1).alias("idx"), F.when(e % 29 == 1, 1).otherwise(2).alias("epoch"), (e % 23 != 3).alias("link_ok"), (e % 140).alias("n"), (e * 5 % 3000).alias("oid"), (e % 41 != 7).alias("is_member")
    )
    return op.receipt_logs(pages, "job", 2)


# (name, state, content type, start, page, limit): none, one or both filters; limits outside 1 to 256; pages and starts.
REQUESTS = [
    ("dense", None, None, 5, None, 1000),
    ("dense_page", None, None, None, 3, 20),
    ("state", "pending", None, 10, None, None),
    ("runtime", "uploading", None, None, 1, 8),
    ("type", None, "container_index", 4, None, 0),
    ("both", "synced", "data", None, 2, 16),
]


def _requests_sql() -> str:
    parts = []
    for name, state, kind, start, page, limit in REQUESTS:
        size = max(1, min(256, 256 if limit is None else limit))
        first = start if start is not None else (page or 0) * size
        if state is None and kind is None:
            parts.append(
                f"SELECT '{name}' AS request, x.extent, oid, shown, content_type, total FROM (SELECT unnest(range({first}, {first + size})) AS extent) x CROSS JOIN (SELECT max(o_orderkey) + 10 AS total FROM orders) LEFT JOIN (SELECT * FROM viewed WHERE extent IS NOT NULL) v ON v.extent = x.extent WHERE x.extent < total"
            )
        else:
            when = " AND ".join(f"{c} = '{v}'" for c, v in (("shown", state), ("content_type", kind)) if v)
            parts.append(f"(SELECT '{name}' AS request, extent, oid, shown, content_type, count(*) OVER () AS total FROM viewed WHERE NOT missing AND {when} ORDER BY extent LIMIT {size} OFFSET {first})")
    return " UNION ALL ".join(parts)


@query("block_requests", fx.with_tables("objects_full receipts transfer", f"WITH {VIEW} {_requests_sql()}"))
def block_requests(spark, d):
    """Pages of blocks by every kind of request: paging queries, limited by definition."""
    view = saved_view(spark, d)
    total = fx.raw(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    found = None
    for name, state, kind, start, page, limit in REQUESTS:
        rows = cat_op.block_page(view, total + 10, state, kind, start, page, limit).withColumn("request", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "summary_totals",
    fx.with_tables(
        "objects_full receipts transfer write_log",
        f"""WITH {VIEW}, dirty AS (SELECT count(DISTINCT (volume_id, page)) AS n FROM write_log)
        SELECT count(*) AS objects, count(*) FILTER (NOT missing) AS resident_objects, count(*) FILTER (missing) AS missing_objects, {", ".join(f"count(*) FILTER (shown = '{s}') AS {s}_objects" for s in ("local", "pending", "uploaded", "synced", "uploading", "failed"))},
        count(*) FILTER (is_pending) AS pending_total, count(*) FILTER (is_pending) * {fx.OBJECT_SIZE} AS pending_bytes, count(*) FILTER (is_pending AND NOT missing) AS pending_resident, count(*) FILTER (is_pending AND missing) AS pending_missing,
        count(*) FILTER (sync_state = 1 AND NOT confirmed) AS job_remaining, max(n) AS dirty_pages, max(n) * {fx.PAGE} AS dirty_bytes FROM viewed, dirty""",
    ),
)
def summary_totals(spark, d):
    """One row of totals: shown states, pending objects by residence, what the job still has to confirm, dirty pages."""
    dirty = fx.write_log(spark, d).select("volume_id", "page").distinct().agg(F.count(F.lit(1)).alias("dirty_pages"))
    totals = cat_op.totals(viewed(spark, d), fx.OBJECT_SIZE)
    return totals.join(dirty, how="cross").withColumn("dirty_bytes", F.col("dirty_pages") * fx.PAGE)  # one row each


@query(
    "object_projection",
    fx.with_tables(
        "objects_full receipts transfer",
        f"""WITH {VIEW} SELECT extent AS block, oid, CASE WHEN kind = 1 THEN 'data' ELSE 'metadata' END AS object_kind, content_type, shown AS sync_state, sync_state >= 2 OR confirmed AS uploaded, sealed, current_refs % 2016 AS used_pages,
        current_refs % 2016 * 4096 AS used_bytes, current_refs + oid % 2 AS local_reference_count, current_refs AS current_reference_count, cloud_refs AS cloud_reference_count,
        CASE WHEN current_refs + oid % 2 = 0 THEN FALSE WHEN current_refs = 0 AND oid % 9 <> 0 THEN TRUE END AS snapshot_pinned, CASE WHEN oid % 7 = 0 THEN TRUE WHEN oid % 9 = 0 THEN FALSE END AS upload_pinned, CAST({fx.OBJECT_SIZE} AS BIGINT) AS length
        FROM viewed""",
    ),
)
def object_projection(spark, d):
    """An object as it is shown, with pins that may be unknown (null)."""
    oid = F.col("oid")
    rows = viewed(spark, d).withColumns({"refs": F.col("current_refs") + oid % 2, "used": F.col("current_refs") % 2016, "job": oid % 9 == 0, "counted": oid % 7 == 0})
    return cat_op.projection(rows, fx.PAGE, fx.OBJECT_SIZE)


@query(
    "page_dependencies",
    fx.with_tables(
        "page_map objects",
        """SELECT page, CASE WHEN page >= 50000 THEN 'capacity' WHEN slot >= 12 THEN 'slot' WHEN p.oid % 40 = 1 THEN 'itself' WHEN o.oid IS NULL THEN 'unknown_object' END AS violation
        FROM page_map p LEFT JOIN (SELECT oid FROM objects WHERE oid % 12 <> 1) o ON p.oid = o.oid WHERE page >= 50000 OR slot >= 12 OR p.oid % 40 = 1 OR o.oid IS NULL""",
    ),
)
def page_dependencies(spark, d):
    """Pages outside of the volume or the slots, or that name an object which the descriptor does not list."""
    table = fx.objects(spark, d).filter("oid % 12 <> 1").select("oid")
    return ref_op.dependency_violations(fx.page_map(spark, d).select("page", "oid", "slot"), table, 50_000, 12, F.col("oid") % 40 == 1).select("page", "violation")


CONFIG = """c AS (SELECT c_custkey AS id, hex('{"object_size":' || (c_custkey % 7 * 1048576) || '}') AS body FROM customer),
    h AS (SELECT id, CASE WHEN id % 11 = 5 THEN '4F44563350414745' ELSE '4F445634504C4E31' END || CASE WHEN id % 17 = 4 THEN 'FF0F0000' ELSE printf('%02X', length(body) // 2) || '000000' END || '00000000' || body || repeat('00', 4064 - 16 - length(body) // 2) AS head FROM c)"""


@query(
    "config_pages",
    f"""WITH {CONFIG} SELECT id, CASE WHEN id % 11 = 5 THEN 'format' WHEN id % 13 = 6 THEN 'checksum' WHEN id % 17 = 4 THEN 'length' ELSE 'ok' END AS verdict,
        CASE WHEN id % 11 <> 5 AND id % 13 <> 6 AND id % 17 <> 4 THEN CAST(json_extract(decode(unhex(body)), '$.object_size') AS BIGINT) END AS object_size FROM c""",
)
def config_pages(spark, d):
    """Configuration pages, some of another format, damaged or too long, and a field of the sound ones."""
    k = F.col("c_custkey")
    customers = fx.raw(spark, d, "customer").select("c_custkey")
    customers = customers.repartition(fx.tasks(customers, 1 << 15), "c_custkey")  # a row becomes a page, so a small file is much work
    body = F.concat(F.lit('{"object_size":'), (k % 7 * 1048576).cast("string"), F.lit("}")).cast("binary")
    size = F.when(k % 17 == 4, "FF0F0000").otherwise(binary.le_hex(F.octet_length(body), 4))
    head = F.concat(F.unhex(F.concat(F.when(k % 11 == 5, "4F44563350414745").otherwise(binary.CONFIG_MAGIC), size, F.lit("00000000"))), body)
    rows = customers.select(k.cast("long").alias("id"), F.rpad(head, F.lit(4064), F.lit(bytearray(1))).alias("head"))
    # each step's column is used several times by the next, so none is worked out twice
    digest = F.when(F.col("id") % 13 == 6, F.sha2(F.lit("damaged"), 256)).otherwise(F.sha2("head", 256))
    rows = rows.select("id", F.concat("head", F.unhex(digest)).alias("page"))
    rows = rows.withColumn("verdict", binary.config_verdict(F.col("page")))
    return rows.select("id", "verdict", F.when(F.col("verdict") == "ok", F.get_json_object(binary.config_text(F.col("page")), "$.object_size").cast("long")).alias("object_size"))


@query(
    "object_ranges",
    """WITH r AS (SELECT o_orderkey AS id, repeat(hex(o_orderstatus || o_orderkey), 20) AS used, o_orderkey % 150 AS start, 1 + o_custkey % 90 AS n FROM orders)
        SELECT id, n AS n_bytes, greatest(0, start + n - greatest(start, length(used) // 2)) AS zeros, sha256(unhex(substr(used || repeat('00', 400), 2 * start + 1, 2 * n))) AS digest FROM r""",
)
def object_ranges(spark, d):
    """Ranges of objects: what is used, then zeros."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    used = F.repeat(F.concat("o_orderstatus", k.cast("string")), F.lit(20)).cast("binary")
    rows = fx.raw(spark, d, "orders").select(k.alias("id"), used.alias("used"), (k % 150).alias("start"), (1 + c % 90).alias("n"))
    zeros = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.octet_length("used"))).cast("long")
    return rows.select("id", F.col("n").alias("n_bytes"), zeros.alias("zeros"), F.sha2(binary.ranged_read(F.col("used"), F.col("start"), F.col("n")), 256).alias("digest"))


@query(
    "listing_head",
    """WITH q AS (SELECT p_partkey AS id, '/d' || (p_partkey % 40) || '/f' || (p_partkey % 700) AS path FROM part), c AS (SELECT '/d' || (s_suppkey % 40) || '/f' || (s_suppkey * 3 % 700) AS path, max(s_suppkey % 3 <> 0) AS there FROM supplier GROUP BY 1),
        l AS (SELECT '/d' || (o_orderkey % 40) || '/f' || (o_orderkey * 7 % 700) AS path, max(o_custkey) AS length FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
        SELECT id, q.path, CASE WHEN c.path IS NOT NULL THEN CASE WHEN there THEN 'cache' ELSE 'cached_absence' END WHEN l.path IS NOT NULL THEN 'listing' ELSE 'absent' END AS found, CASE WHEN c.path IS NULL THEN length END AS length FROM q LEFT JOIN c ON q.path = c.path LEFT JOIN l ON q.path = l.path""",
)
def listing_head(spark, d):
    """Single paths, from what is cached about them or else from their directory's listing."""
    name = lambda k, m: F.concat(F.lit("/d"), (k % 40).cast("string"), F.lit("/f"), (k * m % 700).cast("string"))
    p, s, o = F.col("p_partkey"), F.col("s_suppkey"), F.col("o_orderkey")
    asked = fx.raw(spark, d, "part").select(p.alias("id"), name(p, 1).alias("path"))
    cached = fx.raw(spark, d, "supplier").groupBy(name(s, 3).alias("path")).agg(F.max(s % 3 != 0).alias("there"))
    listed = fx.raw(spark, d, "orders").filter(o % 3 != 1).groupBy(name(o, 7).alias("path")).agg(F.max("o_custkey").alias("length"))
    found = asked.join(cached, "path", "left").join(listed, "path", "left")
    where = F.when(F.col("there"), "cache").when(~F.col("there"), "cached_absence").when(F.col("length").isNotNull(), "listing").otherwise("absent")
    return found.select("id", "path", where.alias("found"), F.when(F.col("there").isNull(), F.col("length")).alias("length"))


@query(
    "quota_eligible",
    """SELECT c_custkey AS disk, c_custkey % 5 * 1000 > 0 AND c_custkey % 4 <> 0 AND coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 <> 1 END, c_custkey % 6 = 0 OR c_custkey % 9 = 0) AND greatest(c_custkey % 11 - 4, 0) > 0 AS eligible FROM customer""",
)
def quota_eligible(spark, d):
    """Disks that the loop which enforces limits takes up."""
    from blockloom.operators.views import quota_eligible as eligible

    k = F.col("c_custkey")
    ready = F.when(k % 3 != 0, k % 7 != 1)
    return fx.raw(spark, d, "customer").select(k.alias("disk"), eligible(k % 5 * 1000, k % 4 != 0, ready, k % 6 == 0, k % 9 == 0, F.greatest(k % 11 - 4, F.lit(0))).alias("eligible"))


@query(
    "escaped_texts",
    """SELECT event_id, replace(replace(replace(replace(replace(coalesce('<' || event_type || ' a="' || props || '" & ''b''>', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
        CASE WHEN event_id % 10 = 0 THEN '—' ELSE strftime(ts, '%Y/%m/%d') END AS day, CASE WHEN event_id % 10 = 0 THEN '—' ELSE strftime(ts, '%H:%M:%S') END AS clock FROM events""",
)
def escaped_texts(spark, d):
    """Texts and times as a page shows them."""
    e = F.col("event_id")
    raw = F.concat(F.lit("<"), "event_type", F.lit(' a="'), "props", F.lit("\" & 'b'>"))
    at = text.shown_time(F.when(e % 10 != 0, F.col("ts").cast("timestamp_ntz")))
    return fx.raw(spark, d, "events").select("event_id", text.escape_html(raw).alias("html"), at["date"].alias("day"), at["time"].alias("clock"))


@query(
    "partition_guids",
    """SELECT s_suppkey AS disk, i AS entry, substr(sha256(unhex(md5('disk' || s_suppkey) || printf('%02x', i) || '000000')), 1, 32) AS guid FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS i)""",
)
def partition_guids(spark, d):
    """Ids of a disk's partitions, from its own id and their places."""
    k = F.col("s_suppkey")
    rows = fx.raw(spark, d, "supplier").select(k.alias("disk"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("entry"))
    return rows.select("disk", "entry", binary.partition_guid(F.unhex(F.md5(F.concat(F.lit("disk"), F.col("disk").cast("string")))), F.col("entry")).alias("guid"))


@query("distinct_ranges", "SELECT rstart, rend, row_number() OVER (ORDER BY rstart, rend) AS place FROM (SELECT DISTINCT o_custkey % 300 * 4096 AS rstart, (o_custkey % 300 + 1 + o_orderkey % 2) * 4096 AS rend FROM orders)")
def distinct_ranges(spark, d):
    """Ranges in order, each once: at most 600 of them here, so one task orders them."""
    from pyspark.sql import Window

    c, k = F.col("o_custkey"), F.col("o_orderkey")
    rows = fx.raw(spark, d, "orders").select((c % 300 * 4096).alias("rstart"), ((c % 300 + 1 + k % 2) * 4096).alias("rend")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy("rstart", "rend")).cast("long"))


PAYLOAD = "(o_orderstatus || '-' || o_orderkey || '-' || o_custkey)"
PAD = ["36" * 61, "5c" * 61]  # fixed values: inner and outer padding of a keyed digest, after a key of three bytes


@query(
    "codec_digests",
    f"""SELECT o_orderkey AS id, substr(sha256(unhex(md5(CAST(o_orderkey AS VARCHAR)) || hex_le(o_orderkey % 60000) || '000000000000' || hex_le(o_custkey % 60000) || '000000000000' || hex({PAYLOAD}))), 1, 32) AS tag,
        md5(substr({PAYLOAD}, 1, 4)) AS first_part, sha256(unhex('5d5e5f{PAD[1]}' || sha256(unhex('373435{PAD[0]}' || hex({PAYLOAD}))))) AS signature FROM orders""".replace(
        "hex_le(o_orderkey % 60000)", "printf('%02x%02x', o_orderkey % 60000 % 256, o_orderkey % 60000 // 256)"
    ).replace("hex_le(o_custkey % 60000)", "printf('%02x%02x', o_custkey % 60000 % 256, o_custkey % 60000 // 256)"),
)
def codec_digests(spark, d):
    """Digests of payloads: bound to id, page and version; of their first part; keyed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    data = F.concat_ws("-", "o_orderstatus", k.cast("string"), c.cast("string")).cast("binary")
    rows = fx.raw(spark, d, "orders").select(k.alias("id"), "o_custkey", data.alias("data"))
    tag = binary.bound_tag(F.unhex(F.md5(F.col("id").cast("string"))), F.col("id") % 60000, F.col("o_custkey") % 60000, F.col("data"))
    return rows.select("id", tag.alias("tag"), crypto.part_digests(F.col("data"), 4)[0].alias("first_part"), crypto.sign(b"\x01\x02\x03")("data").alias("signature"))


@query("codec_round_trips", "SELECT o_orderkey AS id, TRUE AS framed, TRUE AS sealed, o_orderkey % 5 = 0 AS damaged FROM orders")
def codec_round_trips(spark, d):
    """Payloads after framing and compression, and after encryption bound to their id; every fifth frame is damaged on the way."""
    magic, key, iv = b"LOOMFRM1", F.lit(bytearray(b"k" * 16)), F.lit(bytearray(b"i" * 12))
    k = F.col("o_orderkey")
    rows = fx.raw(spark, d, "orders").select(k.alias("id"), F.repeat("o_orderpriority", F.lit(5)).cast("binary").alias("data"))
    rows = rows.withColumn("frame", transport.encode(magic)("data"))
    bad = F.when(F.col("id") % 5 == 0, F.concat(F.unhex(F.lit("00")), F.col("frame").substr(F.lit(2), F.octet_length("frame")))).otherwise(F.col("frame"))
    rows = rows.withColumn("back", transport.decode(magic)("frame")).withColumn("bad", transport.decode(magic)(bad))
    sealed = transport.decrypted(transport.encrypted(F.col("data"), key, iv, F.lit("id")), key, F.lit("id"))
    return rows.select("id", F.col("back.data").eqNullSafe(F.col("data")).alias("framed"), sealed.eqNullSafe(F.col("data")).alias("sealed"), F.col("bad.error").isNotNull().alias("damaged"))


@query(
    "retire_cascade",
    f"""WITH RECURSIVE {EDGES}, a(node) AS (SELECT unnest([1, 2, 3]) UNION SELECT e.child FROM a JOIN edges e ON e.parent = a.node), b(node) AS (SELECT unnest([1, 3]) UNION SELECT e.child FROM b JOIN edges e ON e.parent = b.node)
        SELECT CAST(a.node AS BIGINT) AS node, (SELECT count(*) FROM edges e JOIN a p ON e.parent = p.node WHERE e.child = a.node) + CAST(a.node <= 3 AS BIGINT) AS references_before, b.node IS NULL AS retired FROM a LEFT JOIN b ON a.node = b.node""",
)
def retire_cascade(spark, d):
    """References of the nodes below three roots, and those that go when one root is retired: what nothing else holds goes with it."""
    edges, roots = tree(spark, d)
    folder = fresh_path(spark, "cascade")
    before = ref_op.reachable(spark, edges, roots, f"{folder}/before").select("node")
    after = ref_op.reachable(spark, edges, roots.filter("node <> 2"), f"{folder}/after").select("node", F.lit(True).alias("stays"))
    held = edges.join(before, edges["parent"] == before["node"], "left_semi").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    roots = roots.select("node", F.lit(1).cast("long").alias("root"))
    found = before.join(held, "node", "left").join(roots, "node", "left").join(after, "node", "left")
    return found.select("node", (F.coalesce("n", F.lit(0)) + F.coalesce("root", F.lit(0))).alias("references_before"), F.col("stays").isNull().alias("retired"))
