"""Set, path, listing and commit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.functions import paths
from blockloom.operators import sets as op

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


A, B = "(SELECT DISTINCT oid FROM page_map WHERE page % 7 <> 0)", "(SELECT DISTINCT oid FROM page_map WHERE page % 5 <> 0)"


def both(spark, d):
    pages = fx.pages(spark, d).select("page", "oid")
    return pages.filter("page % 7 <> 0").select("oid").distinct(), pages.filter("page % 5 <> 0").select("oid").distinct()


@query("set_union", fx.with_tables("page_map", f"SELECT * FROM {A} UNION SELECT * FROM {B}"))
def set_union(spark, d):
    a, b = both(spark, d)
    return a.union(b).distinct()


@query("set_except", fx.with_tables("page_map", f"SELECT * FROM {A} EXCEPT SELECT * FROM {B}"))
def set_except(spark, d):
    a, b = both(spark, d)
    return a.exceptAll(b)


@query("set_intersect", fx.with_tables("page_map", f"SELECT * FROM {A} INTERSECT SELECT * FROM {B}"))
def set_intersect(spark, d):
    a, b = both(spark, d)
    return a.intersect(b)


@query("set_symdiff", fx.with_tables("page_map", f"(SELECT * FROM {A} EXCEPT SELECT * FROM {B}) UNION (SELECT * FROM {B} EXCEPT SELECT * FROM {A})"))
def set_symdiff(spark, d):
    return op.symmetric_difference(*both(spark, d), "oid")


@query(
    "set_predicates",
    fx.with_tables(
        "page_map",
        f"""WITH m AS (SELECT a.oid AS a, b.oid AS b FROM {A} a FULL JOIN {B} b ON a.oid = b.oid)
        SELECT count(*) FILTER (b IS NULL) = 0 AS subset, count(*) FILTER (a IS NULL) = 0 AS superset, count(*) FILTER (b IS NULL) = 0 AND count(*) FILTER (a IS NULL) > 0 AS proper_subset,
        count(*) FILTER (a IS NULL) = 0 AND count(*) FILTER (b IS NULL) > 0 AS proper_superset, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) > 0 AS overlaps,
        count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS equal FROM m""",
    ),
)
def set_predicates(spark, d):
    return op.predicates(*both(spark, d), "oid")


@query(
    "set_net_changes",
    fx.with_tables(
        "page_map",
        f"""WITH ops AS (SELECT 6 * (event_id % 977) + 1 AS oid, arg_max(event_type <> 'error', event_id) AS added FROM events GROUP BY 1)
        SELECT ops.oid, CASE WHEN added THEN 'added' ELSE 'removed' END AS change FROM ops LEFT JOIN {A} a ON ops.oid = a.oid WHERE added <> (a.oid IS NOT NULL)""",
    ),
)
def set_net_changes(spark, d):
    a, _ = both(spark, d)
    ops = fx.raw(spark, d, "events").select((6 * (F.col("event_id") % 977) + 1).alias("oid"), "event_id", (F.col("event_type") != "error").alias("add"))
    return op.net_changes(a, ops, "oid", "event_id", "add")


@query(
    "pending_deletes",
    fx.with_tables("page_map objects", f"(SELECT oid FROM objects WHERE sync_state = 2 UNION SELECT oid FROM {A}) EXCEPT SELECT oid FROM {B}"),
)
def pending_deletes(spark, d):
    """Deletions still due after a publication: those pending and those removed, less what the new version holds."""
    a, b = both(spark, d)
    pending = fx.objects(spark, d).filter("sync_state = 2").select("oid")
    return pending.union(a).distinct().join(b, "oid", "left_anti")


@query(
    "path_validate",
    """SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9_-]{2,128}$') AS name_ok, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z0-9_-]{2,128}$') AS fixed_ok, regexp_matches(p_brand, '^[A-Za-z0-9_-]{2,128}$') AS brand_ok FROM part""",
)
def path_validate(spark, d):
    name = F.col("p_name")
    return fx.raw(spark, d, "part").select(
        "p_partkey", paths.is_component(name).alias("name_ok"), paths.is_component(F.replace(name, F.lit(" "), F.lit("_"))).alias("fixed_ok"), paths.is_component(F.col("p_brand")).alias("brand_ok")
    )


@query(
    "object_path",
    fx.with_tables("objects", "SELECT oid, 'root' || (oid % 3) || '/objects/' || substr(sha256(CAST(oid AS VARCHAR)), 1, 2) || '/' || sha256(CAST(oid AS VARCHAR)) AS path FROM objects"),
)
def object_path(spark, d):
    k = F.col("oid")
    return fx.objects(spark, d).select("oid", paths.object_path(F.concat(F.lit("root"), (k % 3).cast("string")), F.sha2(k.cast("string"), 256)).alias("path"))


@query("path_parent", fx.with_tables("wal", "SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS parent FROM wal"))
def path_parent(spark, d):
    return fx.wal(spark, d).select("path").distinct().withColumn("parent", paths.parent(F.col("path")))


@query(
    "commit_parse",
    fx.with_tables("commits", r"SELECT name, CAST(regexp_extract(name, '^([0-9]{20})-([A-Za-z0-9_-]{2,128})[.]json$', 1) AS BIGINT) AS generation, regexp_extract(name, '^([0-9]{20})-([A-Za-z0-9_-]{2,128})[.]json$', 2) AS root FROM commits WHERE root_id % 9 <> 0"),
)
def commit_parse(spark, d):
    """Generation and root from commit names; names of another form have none and are left out."""
    name = F.when(F.col("root_id") % 9 == 0, F.concat(F.lit("x"), F.col("name"))).otherwise(F.col("name"))
    rows = fx.commits(spark, d).select(name.alias("name")).filter(F.col("name").rlike(paths.COMMIT))
    return rows.select("name", F.regexp_extract("name", paths.COMMIT, 1).cast("long").alias("generation"), F.regexp_extract("name", paths.COMMIT, 2).alias("root"))


@query(
    "latest_commit",
    fx.with_tables(
        "commits",
        """WITH g AS (SELECT volume, generation, count(DISTINCT root_id) AS roots FROM commits GROUP BY ALL)
        SELECT volume, max(generation) AS generation, arg_max(roots, generation) > 1 AS reader_conflict, bool_or(roots > 1) AS writer_conflict FROM g GROUP BY volume""",
    ),
)
def latest_commit(spark, d):
    """Newest generation of each volume; a reader fails on a conflict there, a writer on any."""
    g = fx.commits(spark, d).groupBy("volume", "generation").agg(F.count_distinct("root_id").alias("roots"))
    return g.groupBy("volume").agg(F.max("generation").alias("generation"), (F.max_by("roots", "generation") > 1).alias("reader_conflict"), F.bool_or(F.col("roots") > 1).alias("writer_conflict"))


@query(
    "list_disks",
    fx.with_tables(
        "commits",
        """WITH g AS (SELECT volume, generation, min(root_id) AS root_id, min(name) AS name, count(DISTINCT root_id) AS roots FROM commits GROUP BY volume, generation),
        n AS (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY generation DESC) AS k FROM g)
        SELECT volume, generation, roots > 1 AS conflict, CASE WHEN roots = 1 THEN root_id END AS root_id, CASE WHEN roots = 1 THEN name END AS name FROM n WHERE k = 1""",
    ),
)
def list_disks(spark, d):
    """The latest commit of each volume; where two roots share the newest generation none is chosen."""
    g = fx.commits(spark, d).groupBy("volume", "generation").agg(F.min(F.struct("root_id", "name")).alias("low"), F.max(F.struct("root_id", "name")).alias("high"))
    last = g.groupBy("volume").agg(F.max("generation").alias("generation"), F.max_by(F.struct("low", "high"), "generation").alias("c"))
    one = F.col("c.low.root_id") == F.col("c.high.root_id")
    return last.select("volume", "generation", (~one).alias("conflict"), F.when(one, F.col("c.low.root_id")).alias("root_id"), F.when(one, F.col("c.low.name")).alias("name"))


@query(
    "listing_order_check",
    """WITH l AS (SELECT p_partkey // 200 AS page, p_partkey AS pos, CASE WHEN p_partkey % 311 = 310 THEN 'zz' ELSE lpad(CAST(999999 - p_partkey AS VARCHAR), 6, '0') END AS name FROM part)
        SELECT page, count(*) AS n, count(*) FILTER (name >= before) AS violations FROM (SELECT *, lag(name) OVER (PARTITION BY page ORDER BY pos) AS before FROM l) GROUP BY page""",
)
def listing_order_check(spark, d):
    """Entries of a descending listing that do not come after their predecessor."""
    k = F.col("p_partkey")
    name = F.when(k % 311 == 310, "zz").otherwise(F.lpad((999999 - k).cast("string"), 6, "0"))
    rows = fx.raw(spark, d, "part").select(F.floor(k / 200).alias("page"), k.alias("pos"), name.alias("name"))
    before = F.lag("name").over(Window.partitionBy("page").orderBy("pos"))
    return rows.withColumn("before", before).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") >= F.col("before")).alias("violations"))


@query(
    "listing_merge",
    """SELECT n.p_partkey AS entry, n.p_size AS length, CASE WHEN c.p_partkey IS NOT NULL AND n.p_size % 10 <> 3 THEN sha256(CAST(c.p_partkey AS VARCHAR)) END AS sha
        FROM part n LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) c ON n.p_partkey = c.p_partkey""",
)
def listing_merge(spark, d):
    """A fresh listing keeps the digest known for an entry whose identity (id, length, checksum) is the same."""
    part = fx.raw(spark, d, "part")
    checksum = F.when(F.col("p_size") % 10 == 3, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
    fresh = part.select(F.col("p_partkey").alias("entry"), F.col("p_size").alias("length"), checksum.alias("checksum"))
    cached = part.filter("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("entry"), F.col("p_size").alias("length"), F.col("p_brand").alias("checksum"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha")
    )
    return op.carry_over(fresh, cached, "entry", ["length", "checksum"], "sha").select("entry", "length", "sha")


@query(
    "immutable_put",
    """WITH have AS (SELECT p_partkey AS path, p_size AS hash FROM part WHERE p_partkey % 2 = 0) SELECT n.p_partkey AS path,
        CASE WHEN h.path IS NULL THEN 'stored' WHEN h.hash = n.p_size + CAST(n.p_partkey % 5 = 0 AS INTEGER) THEN 'reused' ELSE 'conflict' END AS outcome FROM part n LEFT JOIN have h ON n.p_partkey = h.path""",
)
def immutable_put(spark, d):
    """Uploads by path: the same hash is reused, another one conflicts."""
    part = fx.raw(spark, d, "part")
    have = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("have"))
    put = part.select(F.col("p_partkey").alias("path"), (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).alias("hash"))
    outcome = F.when(F.col("have").isNull(), "stored").when(F.col("have") == F.col("hash"), "reused").otherwise("conflict")
    return put.join(have, "path", "left").select("path", outcome.alias("outcome"))


@query(
    "delete_verify",
    """SELECT p_brand AS parent, count(*) AS asked, count(*) FILTER (p_partkey % 13 = 0) AS still_there, count(*) FILTER (p_partkey % 13 = 0) = 0 AS done FROM part WHERE p_size < 20 GROUP BY p_brand""",
)
def delete_verify(spark, d):
    """A batch delete is done for a parent when a new listing shows none of its entries."""
    part = fx.raw(spark, d, "part")
    asked = part.filter("p_size < 20").select("p_brand", "p_partkey")
    listed = part.filter("p_partkey % 13 = 0").select("p_partkey", F.lit(True).alias("there"))
    found = asked.join(listed, "p_partkey", "left").groupBy(F.col("p_brand").alias("parent")).agg(F.count(F.lit(1)).alias("asked"), F.count("there").alias("still_there"))
    return found.withColumn("done", F.col("still_there") == 0)
