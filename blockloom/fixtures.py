"""Catalog tables derived from the supplied star schema.

The supplied data holds no disk catalogs, so every domain table is a fixed,
deterministic function of it: integer arithmetic on keys only.  ``SQL`` states
each derivation for the SQL twins; the functions state it for Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions.numbers import int_div

OBJECT_SIZE = 8 * 1024 * 1024
PAGE = 4096


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame, most: int = 1 << 18) -> int:
    """In how many tasks to deal rows of a few numbers so that none has more than about ``most``; some eight for less, if it pays."""
    n = rows.count()
    return 1 + max(n // most, min(8, 8 * n // most))


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Object inventory: one immutable object per order."""
    k = F.col("o_orderkey")
    index = k % 6 == 5
    missing = ~index & (k % 11 == 0)
    return raw(spark, d, "orders").select(
        (k + 1).alias("oid"),
        F.when(index, 2).otherwise(1).alias("kind"),
        F.when(index, 0).otherwise((k % 6).cast("int")).alias("pool"),
        (int_div(k, 6) % 4).cast("int").alias("sync_state"),
        missing.alias("missing"),
        (k % 13 != 0).alias("sealed"),
        F.when(~missing, k + 1).alias("extent"),
    )


def _pages(lineitem: DataFrame, n: int) -> DataFrame:
    lines = lineitem.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    page = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lines.select(page.cast("long").alias("page"), (6 * F.col("p") + 1 + F.col("s") % 5).cast("long").alias("oid"))


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.sha2(F.col("page").cast("string"), 256))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Page to object mapping without slots: one page per (order, line)."""
    lineitem = raw(spark, d, "lineitem")
    return _digest(_pages(lineitem, tasks(lineitem)))


def page_map(spark: SparkSession, d: str) -> DataFrame:
    """Page to object mapping: one page per (order, line), slots in page order within an object."""
    lineitem = raw(spark, d, "lineitem")
    n = tasks(lineitem)
    slot = F.row_number().over(Window.partitionBy("oid").orderBy("page")) - 1
    return _digest(_pages(lineitem, n).repartition(n, "oid").withColumn("slot", slot.cast("long")))


def objects_full(spark: SparkSession, d: str) -> DataFrame:
    """Objects with their reference counts."""
    counts = pages(spark, d).groupBy("oid").agg(F.count(F.lit(1)).alias("n"))
    return (
        objects(spark, d)
        .join(counts, "oid", "left")
        .withColumn("current_refs", F.coalesce("n", F.lit(0)).cast("long"))
        .withColumn("cloud_refs", F.when(F.col("oid") % 3 == 0, 0).otherwise(1).cast("long"))
        .drop("n")
    )


def _order_count(spark: SparkSession, d: str):
    return raw(spark, d, "orders").agg(F.count(F.lit(1))).scalar()


def transfer(spark: SparkSession, d: str) -> DataFrame:
    """Latest transfer notice of each object: uploading or failed."""
    return (
        raw(spark, d, "events")
        .filter(F.col("event_type").isin("click", "error"))
        .select(
            (1 + (F.col("event_id") * 7) % _order_count(spark, d)).alias("oid"),
            F.when(F.col("event_type") == "click", "uploading").otherwise("failed").alias("state"),
            "event_id",
        )
        .groupBy("oid")
        .agg(F.max_by("state", "event_id").alias("transfer_state"))
    )


def receipts(spark: SparkSession, d: str) -> DataFrame:
    """Objects with a durable upload receipt: sealed and pending ones that were confirmed."""
    named = (
        raw(spark, d, "events")
        .filter("event_type = 'signup'")
        .select((1 + (F.col("event_id") * 5) % _order_count(spark, d)).alias("oid"))
        .distinct()
    )
    return named.join(objects(spark, d).filter("sync_state = 1 and sealed").select("oid"), "oid", "left_semi")


def write_log(spark: SparkSession, d: str) -> DataFrame:
    """Page writes in sequence; a signup writes zeros.  Contents repeat on purpose."""
    zero = F.col("event_type") == "signup"
    return raw(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("volume_id"),
        ((F.col("user_id") * 31 + F.col("event_id")) % 257).alias("page"),
        F.when(zero, "zero").otherwise("write").alias("op"),
        F.when(~zero, F.sha2(F.concat("event_type", (F.col("event_id") % 5).cast("string")), 256)).alias("digest"),
    )


def read_log(spark: SparkSession, d: str) -> DataFrame:
    """Reads of 256 KiB in streaks of four."""
    e = F.col("event_id")
    return raw(spark, d, "events").select(
        e.alias("tick"),
        ((int_div(e, 4) * 97) % 512 * 1048576 + (e % 4) * 262144).cast("long").alias("off"),
        F.lit(262144).cast("long").alias("len"),
    )


KINDS = ["log", "usn", "mft", "metadata"]  # by priority, the strongest first


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Byte ranges of special content; some overlap."""
    n = F.col("n_nationkey").cast("long")
    start = n * 40960
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (n % 4 + 1).cast("int"))
    return raw(spark, d, "nation").select(
        n.alias("range_id"), start.alias("rstart"), (start + 4096 * (1 + F.col("n_regionkey").cast("long") * 4)).alias("rend"), kind.alias("kind")
    )


def bitmap(spark: SparkSession, d: str) -> DataFrame:
    """Allocation bitmap, a byte a row."""
    k = F.col("p_partkey")
    return raw(spark, d, "part").select(k.cast("long").alias("byte_index"), ((k * 37 + F.col("p_size")) % 256).cast("int").alias("b"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Published versions: several volumes, with some equal generations."""
    k = F.col("o_orderkey")
    generation = int_div(k, 2)
    name = F.concat(F.lpad(generation.cast("string"), 20, "0"), F.lit("-r"), k.cast("string"), F.lit(".json"))
    return raw(spark, d, "orders").select((F.col("o_custkey") % 20).cast("long").alias("volume"), generation.alias("generation"), k.alias("root_id"), name.alias("name"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    """Activity journal rows."""
    e = F.col("event_type")
    action = (
        F.when(e == "view", "sync.started").when(e == "click", "object.uploading").when(e == "purchase", "object.completed").when(e == "signup", "cleanup.deleted").otherwise("sync.failed")
    )
    return raw(spark, d, "events").select(
        (F.col("event_id") + 1).alias("sequence"),
        F.concat(F.lit("disk-"), (F.col("user_id") % 4).cast("string")).alias("disk_id"),
        F.concat(F.lit("run-"), int_div(F.col("event_id"), 50).cast("string")).alias("run_id"),
        action.alias("action"),
        F.when(e == "error", "error").otherwise("info").alias("level"),
        (F.col("event_id") % 9 * 4096).alias("bytes"),
        F.when(F.col("event_id") % 4 == 0, "metadata").otherwise("data").alias("object_kind"),
    )


def wal(spark: SparkSession, d: str) -> DataFrame:
    """Directory write-ahead log: consecutive numbers per directory; a few records are damaged."""
    e = F.col("event_id")
    directory = F.concat(F.lit("d"), (F.col("user_id") % 23).cast("string"))
    return raw(spark, d, "events").select(
        directory.alias("dir"),
        F.row_number().over(Window.partitionBy(directory).orderBy("event_id")).cast("long").alias("seq"),
        F.when(F.col("event_type") == "signup", "remove").otherwise("upsert").alias("op"),
        F.concat(directory, F.lit("/f"), (e % 61).cast("string")).alias("path"),
        (e % 997 != 996).alias("checksum_ok"),
    )


# The same derivations in SQL; every name may be used by those after it.
SQL = {
    "objects": """SELECT o_orderkey + 1 AS oid, CASE WHEN o_orderkey % 6 = 5 THEN 2 ELSE 1 END AS kind,
        CASE WHEN o_orderkey % 6 = 5 THEN 0 ELSE CAST(o_orderkey % 6 AS INTEGER) END AS pool,
        CAST((o_orderkey // 6) % 4 AS INTEGER) AS sync_state,
        o_orderkey % 6 <> 5 AND o_orderkey % 11 = 0 AS missing, o_orderkey % 13 <> 0 AS sealed,
        CASE WHEN NOT (o_orderkey % 6 <> 5 AND o_orderkey % 11 = 0) THEN o_orderkey + 1 END AS extent FROM orders""",
    "page_map": """SELECT page, oid, row_number() OVER (PARTITION BY oid ORDER BY page) - 1 AS slot, sha256(CAST(page AS VARCHAR)) AS digest
        FROM (SELECT l_orderkey * 8 + l_linenumber AS page, 6 * min(l_partkey) + 1 + min(l_suppkey) % 5 AS oid
              FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "objects_full": """SELECT o.*, CAST(coalesce(n, 0) AS BIGINT) AS current_refs, CAST(CASE WHEN o.oid % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS cloud_refs
        FROM objects o LEFT JOIN (SELECT oid, count(*) AS n FROM page_map GROUP BY oid) c ON o.oid = c.oid""",
    "transfer": """SELECT oid, arg_max(state, event_id) AS transfer_state FROM (
        SELECT 1 + (event_id * 7) % (SELECT count(*) FROM orders) AS oid, CASE WHEN event_type = 'click' THEN 'uploading' ELSE 'failed' END AS state, event_id
        FROM events WHERE event_type IN ('click', 'error')) GROUP BY oid""",
    "receipts": """SELECT DISTINCT 1 + (event_id * 5) % (SELECT count(*) FROM orders) AS oid FROM events
        WHERE event_type = 'signup' AND 1 + (event_id * 5) % (SELECT count(*) FROM orders) IN (SELECT oid FROM objects WHERE sync_state = 1 AND sealed)""",
    "write_log": """SELECT event_id AS seq, 'v' || (user_id % 3) AS volume_id, (user_id * 31 + event_id) % 257 AS page,
        CASE WHEN event_type = 'signup' THEN 'zero' ELSE 'write' END AS op,
        CASE WHEN event_type <> 'signup' THEN sha256(event_type || (event_id % 5)) END AS digest FROM events""",
    "read_log": """SELECT event_id AS tick, ((event_id // 4) * 97) % 512 * 1048576 + (event_id % 4) * 262144 AS off, CAST(262144 AS BIGINT) AS len FROM events""",
    "ranges": """SELECT CAST(n_nationkey AS BIGINT) AS range_id, CAST(n_nationkey AS BIGINT) * 40960 AS rstart,
        CAST(n_nationkey AS BIGINT) * 40960 + 4096 * (1 + CAST(n_regionkey AS BIGINT) * 4) AS rend,
        list_extract(['log', 'usn', 'mft', 'metadata'], n_nationkey % 4 + 1) AS kind FROM nation""",
    "bitmap": """SELECT CAST(p_partkey AS BIGINT) AS byte_index, CAST((p_partkey * 37 + p_size) % 256 AS INTEGER) AS b FROM part""",
    "commits": """SELECT o_custkey % 20 AS volume, o_orderkey // 2 AS generation, o_orderkey AS root_id,
        lpad(CAST(o_orderkey // 2 AS VARCHAR), 20, '0') || '-r' || o_orderkey || '.json' AS name FROM orders""",
    "activity": """SELECT event_id + 1 AS sequence, 'disk-' || (user_id % 4) AS disk_id, 'run-' || (event_id // 50) AS run_id,
        CASE event_type WHEN 'view' THEN 'sync.started' WHEN 'click' THEN 'object.uploading' WHEN 'purchase' THEN 'object.completed'
            WHEN 'signup' THEN 'cleanup.deleted' ELSE 'sync.failed' END AS action,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, event_id % 9 * 4096 AS bytes,
        CASE WHEN event_id % 4 = 0 THEN 'metadata' ELSE 'data' END AS object_kind FROM events""",
    "wal": """SELECT 'd' || (user_id % 23) AS dir, row_number() OVER (PARTITION BY user_id % 23 ORDER BY event_id) AS seq,
        CASE WHEN event_type = 'signup' THEN 'remove' ELSE 'upsert' END AS op, 'd' || (user_id % 23) || '/f' || (event_id % 61) AS path,
        event_id % 997 <> 996 AS checksum_ok FROM events""",
}


NEEDS = {"objects_full": ["objects", "page_map"], "receipts": ["objects"]}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after WITH clauses of the named derived tables and those they need."""
    todo: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in todo:
                todo.append(need)
    clauses = [f"{n} AS ({SQL[n]})" for n in todo]
    text = body.strip()
    joined = ",\n".join(clauses)
    if text.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{joined},\n{text[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}\n{text}"
