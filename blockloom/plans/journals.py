"""Journal, log and receipt queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import journal as op
from blockloom.operators import runs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


LINES = """lines AS (SELECT event_id // 500 AS segment, event_id AS line_no, CASE WHEN event_id % 101 = 100 THEN '{"sequence":' WHEN event_id % 977 = 976 THEN repeat('x', 12001)
    WHEN event_id % 211 = 210 THEN '{"sequence": ' || (event_id - 5) || '}' ELSE '{"sequence": ' || event_id || '}' END AS line FROM events)"""


@query(
    "journal_scan",
    f"""WITH {LINES}, e AS (SELECT *, max(CAST(length(line) > 12000 AS INTEGER)) OVER (PARTITION BY segment ORDER BY line_no) = 1 AS ended,
        CASE WHEN json_valid(line) THEN CAST(json_extract(line, '$.sequence') AS BIGINT) END AS sequence FROM lines),
        f AS (SELECT *, NOT ended AND sequence IS NOT NULL AND coalesce(sequence > max(CASE WHEN NOT ended THEN sequence END) OVER (PARTITION BY segment ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS ok FROM e)
        SELECT segment, count(*) FILTER (ok) AS n_rows, count(*) FILTER (NOT ok) AS n_skipped, max(sequence) FILTER (ok) AS last_sequence, bool_or(NOT ok) AS warning FROM f GROUP BY segment""",
)
def journal_scan(spark, d):
    """Rows and skipped lines of each segment of the activity log, some lines torn, overlong or out of order."""
    e = F.col("event_id")
    json = lambda x: F.concat(F.lit('{"sequence": '), x.cast("string"), F.lit("}"))
    line = F.when(e % 101 == 100, '{"sequence":').when(e % 977 == 976, F.repeat(F.lit("x"), 12001)).when(e % 211 == 210, json(e - 5)).otherwise(json(e))
    lines = fx.raw(spark, d, "events").select(F.floor(e / 500).alias("segment"), e.alias("line_no"), line.alias("line"))
    rows = op.parse_segments(lines, "sequence long")
    return rows.groupBy("segment").agg(
        F.count_if("ok").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_skipped"), F.max(F.when(F.col("ok"), F.col("row.sequence"))).alias("last_sequence"), F.bool_or(~F.col("ok")).alias("warning")
    )


@query(
    "journal_retention",
    fx.with_tables("activity", "SELECT sequence // 256 AS segment, count(*) AS n, sequence // 256 > (SELECT max(sequence) // 256 FROM activity) - 16 AS kept FROM activity GROUP BY 1"),
)
def journal_retention(spark, d):
    """Rows by segment of 256, and the newest 16 segments, which stay."""
    a = fx.activity(spark, d)
    last = a.agg(F.floor(F.max("sequence") / 256)).scalar()
    segment = F.floor(F.col("sequence") / 256)
    return a.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.col("segment") > last - 16)


@query(
    "activity_page",
    fx.with_tables(
        "activity",
        """SELECT sequence, a.disk_id, coalesce(n.name, a.disk_id) AS disk_name, action, level FROM activity a LEFT JOIN (VALUES ('disk-0', 'Archive'), ('disk-1', 'Photos')) n(id, name) ON a.disk_id = n.id
        WHERE sequence < 900 AND level = 'error' ORDER BY sequence DESC LIMIT 200""",
    ),
)
def activity_page(spark, d):
    """Newest errors before a cursor, with disk names: a page of at most 200 rows."""
    names = spark.createDataFrame([("disk-0", "Archive"), ("disk-1", "Photos")], "disk_id string, name string")
    rows = fx.activity(spark, d).filter("sequence < 900 and level = 'error'").orderBy(F.desc("sequence")).limit(200)
    return rows.join(F.broadcast(names), "disk_id", "left").select("sequence", "disk_id", F.coalesce("name", "disk_id").alias("disk_name"), "action", "level")


# Actions of every ending, with replica rows, warnings and errors among them: (event_id mod 20) names the action.
ACTIONS = "sync.started object.uploading object.confirmed object.reused upload.reused sync.completed cleanup.deleted pins.removed sync.unchanged copy.verified sync.failed sync.interrupted sync.paused sync.cancelled prepared applied unchanged sync.resumed disk.created sync.conflict".split()
ROWS = f"""l AS (SELECT event_id, [{", ".join(f"'{a}'" for a in ACTIONS)}][event_id % 20 + 1] AS action, CASE WHEN event_id % 20 IN (14, 15) OR event_id % 7 = 0 THEN 'replica' ELSE 'sync' END AS kind,
    CASE WHEN event_id % 31 = 0 THEN 'Error' WHEN event_id % 23 = 0 THEN 'WARNING' ELSE 'info' END AS level FROM events)"""


@query(
    "log_outcome",
    f"""WITH {ROWS} SELECT event_id, action, CASE WHEN lower(level) = 'error' OR ends_with(action, '.failed') THEN 'failed' WHEN ends_with(action, '.interrupted') THEN 'interrupted'
        WHEN lower(level) = 'warning' THEN 'warning' WHEN ends_with(action, '.paused') THEN 'paused' WHEN ends_with(action, '.cancelled') THEN 'cancelled'
        WHEN kind = 'replica' AND action = 'prepared' THEN 'to_confirm' WHEN kind = 'replica' AND action IN ('applied', 'unchanged') THEN 'success'
        WHEN action IN ('object.reused', 'upload.reused') THEN 'reused'
        WHEN regexp_matches(action, '[.](confirmed|completed|deleted|removed|unchanged|verified)$') THEN 'success' WHEN ends_with(action, '.started') THEN 'started' ELSE 'record' END AS outcome FROM l""",
)
def log_outcome(spark, d):
    """Status of log rows of every kind."""
    e = F.col("event_id")
    kind = F.when((e % 20).isin(14, 15) | (e % 7 == 0), "replica").otherwise("sync")
    level = F.when(e % 31 == 0, "Error").when(e % 23 == 0, "WARNING").otherwise("info")
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (e % 20 + 1).cast("int"))
    rows = fx.raw(spark, d, "events").select("event_id", action.alias("action"), kind.alias("kind"), level.alias("level"))
    return rows.select("event_id", "action", op.outcome(F.col("action"), F.col("level"), F.col("kind")).alias("outcome"))


@query(
    "journal_normalize",
    """SELECT event_id, substr(repeat(event_type || ' ', 40), 1, 64) AS message, CASE WHEN lower(event_type) IN ('error', 'warning') THEN lower(event_type) ELSE 'info' END AS level FROM events""",
)
def journal_normalize(spark, d):
    t = F.col("event_type")
    level = F.when(F.lower(t).isin("error", "warning"), F.lower(t)).otherwise("info")
    return fx.raw(spark, d, "events").select("event_id", F.substring(F.repeat(F.concat(t, F.lit(" ")), F.lit(40)), 1, 64).alias("message"), level.alias("level"))


@query(
    "json_extract",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, json_extract_string(props, '$.absent') IS NULL AS defaulted FROM events""",
)
def json_extract(spark, d):
    row = F.from_json("props", "k long, absent string")
    return fx.raw(spark, d, "events").select("event_id", F.coalesce(row["k"], F.lit(-1)).alias("k"), row["absent"].isNull().alias("defaulted"))


@query(
    "state_changes",
    fx.with_tables("activity", "SELECT sequence, disk_id, action FROM (SELECT *, lag(action) OVER (PARTITION BY disk_id ORDER BY sequence) AS before FROM activity) WHERE before IS NULL OR before <> action"),
)
def state_changes(spark, d):
    """A log row only where the disk's action differs from its last one."""
    return op.changes(fx.activity(spark, d).select("sequence", "disk_id", "action"), ["disk_id"], "sequence", ["action"])


@query(
    "stage_transitions",
    fx.with_tables(
        "activity",
        """WITH r AS (SELECT disk_id, run_id, min(sequence) AS started, max(sequence) AS ended, CASE WHEN arg_max(level, sequence) = 'error' THEN 'interrupted' ELSE 'completed' END AS outcome FROM activity GROUP BY ALL)
        SELECT *, coalesce(lag(outcome) OVER (PARTITION BY disk_id ORDER BY started) = 'interrupted', FALSE) AS resumed FROM r""",
    ),
)
def stage_transitions(spark, d):
    """Start, end and outcome of each disk's runs; a run after an interrupted one resumes it."""
    runs = fx.activity(spark, d).groupBy("disk_id", "run_id").agg(
        F.min("sequence").alias("started"), F.max("sequence").alias("ended"), F.when(F.max_by("level", "sequence") == "error", "interrupted").otherwise("completed").alias("outcome")
    )
    before = F.lag("outcome").over(Window.partitionBy("disk_id").orderBy("started"))
    return runs.withColumn("resumed", F.coalesce(before == "interrupted", F.lit(False)))


@query(
    "cleanup_progress",
    fx.with_tables("activity", "SELECT disk_id, sequence, CAST(sum(bytes) OVER (PARTITION BY disk_id ORDER BY sequence) AS BIGINT) AS freed FROM activity WHERE action = 'cleanup.deleted'"),
)
def cleanup_progress(spark, d):
    rows = fx.activity(spark, d).filter("action = 'cleanup.deleted'")
    return runs.running(rows, ["disk_id"], ["sequence"], "freed", F.col("bytes")).select("disk_id", "sequence", "freed")


RECEIPTS = """l AS (SELECT 'j' || (user_id % 5) AS job, event_id, event_id * 5 % 300 AS oid, sha256('p' || event_id) AS page_hash FROM events),
    c AS (SELECT *, row_number() OVER w - 1 AS idx, CASE WHEN event_id % 401 = 400 THEN 'broken' ELSE coalesce(lag(page_hash) OVER w, '') END AS previous, coalesce(lag(page_hash) OVER w, '') AS expected
        FROM l WINDOW w AS (PARTITION BY job ORDER BY event_id)),
    v AS (SELECT *, min(CAST(previous = expected AS INTEGER)) OVER (PARTITION BY job ORDER BY idx) = 1 AS ok FROM c)"""


def receipt_pages(spark, d):
    """Receipt log pages chained by hash within a job; some links are broken."""
    e = F.col("event_id")
    rows = fx.raw(spark, d, "events").select(
        F.concat(F.lit("j"), (F.col("user_id") % 5).cast("string")).alias("job"), e, (e * 5 % 300).alias("oid"), F.sha2(F.concat(F.lit("p"), e.cast("string")), 256).alias("page_hash")
    )
    rows = runs.running(rows, ["job"], ["event_id"], "idx", F.lit(1).cast("long")).withColumn("idx", F.col("idx") - 1)
    rows = runs.with_previous(rows, ["job"], ["event_id"], {"before": F.col("page_hash")})
    return rows.withColumn("previous", F.when(e % 401 == 400, "broken").otherwise(F.coalesce("before", F.lit("")))).drop("before")


def checked_pages(spark, d):
    """The pages with ``sound``: whether each follows the one before it."""
    rows = runs.with_previous(receipt_pages(spark, d), ["job"], ["idx"], {"hash_before": F.col("page_hash"), "idx_before": F.col("idx")})
    sound = (F.col("previous") == F.coalesce("hash_before", F.lit(""))) & (F.col("idx") == F.coalesce(F.col("idx_before") + 1, F.lit(0)))
    return rows.withColumn("sound", sound).drop("hash_before", "idx_before")


@query("journal_prefix", f"WITH {RECEIPTS} SELECT job, idx, ok FROM v")
def journal_prefix(spark, d):
    """Whether each page lies in its job's valid prefix."""
    found = runs.running(checked_pages(spark, d), ["job"], ["idx"], "so_far", F.col("sound").cast("int"), F.min)
    return found.select("job", "idx", (F.col("so_far") == 1).alias("ok"))


@query("receipt_replay", f"WITH {RECEIPTS} SELECT job, oid, min(idx) AS first_idx, count(*) AS n FROM v WHERE ok GROUP BY job, oid")
def receipt_replay(spark, d):
    """Receipts of the valid prefix; one that repeats changes nothing."""
    good = op.valid_prefix(checked_pages(spark, d), ["job"], "idx", F.col("sound"))
    return good.groupBy("job", "oid").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))


@query("wal_validity", fx.with_tables("wal", "SELECT dir, count(*) AS records, bool_and(checksum_ok) AND max(seq) = count(*) AND min(seq) = 1 AS valid FROM wal GROUP BY dir"))
def wal_validity(spark, d):
    return op.whole_or_nothing(fx.wal(spark, d), ["dir"], "seq", F.col("checksum_ok"))


@query(
    "wal_replay",
    fx.with_tables("wal", "SELECT dir, path, max(seq) AS seq FROM wal WHERE dir IN (SELECT dir FROM wal GROUP BY dir HAVING bool_and(checksum_ok)) GROUP BY dir, path HAVING arg_max(op, seq) = 'upsert'"),
)
def wal_replay(spark, d):
    """Directory contents after replay; a damaged directory has none."""
    log = fx.wal(spark, d)
    good = op.whole_or_nothing(log, ["dir"], "seq", F.col("checksum_ok")).filter("valid").select("dir")
    last = log.join(good, "dir", "left_semi").groupBy("dir", "path").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))
    return last.filter("op = 'upsert'").drop("op")


@query(
    "patch_replay",
    """WITH p AS (SELECT user_id % 3 AS set_id, event_id AS seq, event_id % 97 AS item, CASE event_type WHEN 'signup' THEN 'reset' WHEN 'error' THEN 'remove' ELSE 'add' END AS op FROM events),
        r AS (SELECT set_id, max(seq) AS reset FROM p WHERE op = 'reset' AND seq % 50 = 0 GROUP BY set_id)
        SELECT p.set_id, item FROM p LEFT JOIN r ON p.set_id = r.set_id WHERE op <> 'reset' AND seq > coalesce(reset, -1) GROUP BY p.set_id, item HAVING arg_max(op, seq) = 'add'""",
)
def patch_replay(spark, d):
    """Sets after their last reset: an item is in if it was last added."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "error", "remove").otherwise("add")
    p = fx.raw(spark, d, "events").select((F.col("user_id") % 3).alias("set_id"), e.alias("seq"), (e % 97).alias("item"), kind.alias("op"))
    resets = p.filter("op = 'reset' and seq % 50 = 0").groupBy("set_id").agg(F.max("seq").alias("reset"))
    after = p.filter("op <> 'reset'").join(resets, "set_id", "left").filter(F.col("seq") > F.coalesce("reset", F.lit(-1)))
    return after.groupBy("set_id", "item").agg(F.max_by("op", "seq").alias("op")).filter("op = 'add'").drop("op")


@query(
    "adaptive_batch",
    """WITH g AS (SELECT event_id // 50 AS run, list_reduce(list_prepend(CAST(128 AS BIGINT), list(CAST(CASE WHEN event_id % 29 = 28 THEN -1 ELSE event_id * 37 % 180 END AS BIGINT) ORDER BY event_id)),
        lambda a, ms: CASE WHEN ms < 0 THEN 128 WHEN ms > 100 THEN greatest(a // 2, 128) WHEN ms <= 25 THEN least(a * 2, 512) ELSE a END) AS batch FROM events GROUP BY 1)
        SELECT run, CAST(batch AS BIGINT) AS batch, CAST(greatest(least(batch, 300, CASE WHEN run % 3 = 0 THEN 128 ELSE 512 END), 1) AS BIGINT) AS budget FROM g""",
)
def adaptive_batch(spark, d):
    """Batch size after each run of 50 steps, and what the next step may take of 300 with or without foreground work waiting."""
    e = F.col("event_id")
    step = F.struct(e, (e * 37 % 180).alias("ms"), (e % 29 == 28).alias("waiting"))
    steps = fx.raw(spark, d, "events").groupBy(F.floor(e / 50).alias("run")).agg(F.array_sort(F.collect_list(step)).alias("steps"))  # 50 a run
    found = steps.select("run", op.batch_after("steps").alias("batch"))
    return found.withColumn("budget", op.budget(F.col("batch"), F.lit(300), F.col("run") % 3 == 0))
