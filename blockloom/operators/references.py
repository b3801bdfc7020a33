"""Reference counts, protection, reclamation and eviction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.operators import runs
from blockloom.operators.views import MOST_PENDING


def reference_changes(old: DataFrame, new: DataFrame, key: str, target: str) -> DataFrame:
    """Signed count changes per target where a key's mapping differs between two versions."""
    a = old.select(key, F.col(target).alias("was"))
    b = new.select(key, F.col(target).alias("now"))
    changed = a.join(b, key, "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    signed = changed.select(F.inline(F.array(F.struct(F.col("was").alias(target), F.lit(-1).cast("long").alias("delta")), F.struct(F.col("now").alias(target), F.lit(1).cast("long").alias("delta")))))
    return signed.filter(F.col(target).isNotNull()).groupBy(target).agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys to add and to remove between two sets of keys."""
    a = old.select(key).distinct().withColumn("in_old", F.lit(True))
    b = new.select(key).distinct().withColumn("in_new", F.lit(True))
    both = a.join(b, key, "full").filter("in_old is null or in_new is null")
    return both.select(key, F.when(F.col("in_old").isNull(), "add").otherwise("remove").alias("change"))


def orphans(pages: DataFrame, objects: DataFrame, key: str = "oid") -> DataFrame:
    """Pages that refer to no page object: integrity errors."""
    return pages.join(objects.filter("kind = 1").select(key), key, "left_anti")


def reachable(spark, edges: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """(node, depth) of every node below the roots, at its least depth, to whatever depth there is.

    A frontier at a time: each level's new nodes are written to ``folder``, and
    those reached before are left out, so nodes with several parents come once
    and circles end.
    """
    level, found = 0, None
    frontier = roots.select("node").distinct()
    while True:
        frontier.write.parquet(f"{folder}/{level}")
        now = spark.read.parquet(f"{folder}/{level}")
        if now.isEmpty():
            break
        seen = now.withColumn("depth", F.lit(level))
        found = seen if found is None else found.unionByName(seen)
        below = edges.join(now, edges["parent"] == now["node"]).select(F.col("child").alias("node")).distinct()
        frontier = below.join(found.select("node"), "node", "left_anti")
        level += 1
    return found if found is not None else now.withColumn("depth", F.lit(0))


def protection(objects: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Add ``reason``, the first that protects an object; an unknown (null) count protects too."""
    first = reduce(lambda rest, r: F.when(F.coalesce(r[1], F.lit(True)), r[0]).otherwise(rest), reversed(reasons), F.lit(None).cast("string"))
    return objects.withColumn("reason", first)


def dependency_violations(pages: DataFrame, table: DataFrame, capacity: int, slots: int, itself: Column, key: str = "oid") -> DataFrame:
    """Pages that a published descriptor must not hold, with the first rule each breaks."""
    listed = table.select(key, F.lit(True).alias("listed"))
    rule = F.when(F.col("page") >= capacity, "capacity").when(F.col("slot") >= slots, "slot").when(itself, "itself").when(F.col("listed").isNull(), "unknown_object")
    return pages.join(listed, key, "left").withColumn("violation", rule).filter("violation is not null")


def partition_verdicts(candidates: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, verdict) for parts that should make up the candidates: exact, missing, twice or foreign."""
    a = candidates.select(key, F.lit(1).alias("wanted"))
    b = parts.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    verdict = F.when(F.col("wanted").isNull(), "foreign").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "twice").otherwise("exact")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def heat(reads: DataFrame, disk: str, tick: str, off: str, length: str, object_size: int, width: int = runs.WIDTH) -> DataFrame:
    """Per disk and object: last tick, frequency and whether the last read was sequential.

    A read that starts where the disk's previous one ended is sequential (the
    first one, if it starts at 0); it does not raise the frequency when it stays
    in the same object.
    """
    rows = reads.withColumn("object", F.floor(F.col(off) / object_size).cast("long"))
    rows = runs.with_previous(rows, [disk], [tick], {"end_before": F.col(off) + F.col(length), "object_before": F.col("object")}, width)
    rows = rows.withColumn("seq", F.col(off) == F.coalesce("end_before", F.lit(0)))
    again = F.col("seq") & F.coalesce(F.col("object_before") == F.col("object"), F.lit(False))
    return (
        rows.withColumn("again", again)
        .groupBy(disk, "object")
        .agg(F.max(tick).alias("last"), F.count_if(~F.col("again")).alias("frequency"), F.max_by("seq", tick).alias("sequential"))
    )


SHORTEST_READ = 65_536  # shorter reads neither continue nor break a streak


def streaks(reads: DataFrame, disk: str, tick: str, off: str, length: str, width: int = runs.WIDTH) -> DataFrame:
    """Runs of reads each starting where the one before ended: (disk, first tick, reads, bytes).  Short reads do not count."""
    rows = reads.filter(F.col(length) >= SHORTEST_READ)
    rows = runs.with_previous(rows, [disk], [tick], {"end_before": F.col(off) + F.col(length)}, width)
    start = F.coalesce(F.col(off) != F.col("end_before"), F.lit(True)).cast("int")
    rows = runs.running(rows, [disk], [tick], "streak", start, F.sum, width)
    return rows.groupBy(disk, "streak").agg(F.min(tick).alias("first_tick"), F.count(F.lit(1)).alias("reads"), F.sum(length).alias("n_bytes")).drop("streak")


def prefetch_objects(n_bytes: Column, reads: Column, object_size: int, most: int) -> Column:
    """Objects to fetch ahead after a streak: none below three reads, then one and one for each object's bytes read, up to ``most``."""
    return F.when(reads >= 3, F.least(F.lit(most), 1 + F.floor(F.least(n_bytes, F.lit(object_size * most)) / object_size))).otherwise(0).cast("long")


# Fixed: how each policy orders candidates for eviction, the first to go first; ties by object id.
POLICIES = {"lru": ["last"], "lfu": ["frequency", "last"], "sequential": ["not_sequential", "last"]}


def eviction_count(used: Column, limit: Column, object_size: int, most: Column, pending: Column) -> Column:
    """Objects that one step evicts: the overrun's worth, at least one, no more than asked for or than may be waiting."""
    over = F.greatest(used - limit, F.lit(0))
    return F.greatest(F.lit(0), F.least(F.greatest(F.ceil(over / object_size), F.lit(1)), most, MOST_PENDING - pending)).cast("long")


def evict(candidates: DataFrame, heat: DataFrame, policy: str, limit: int) -> DataFrame:
    """The next ``limit`` objects to evict; an object never read has heat 0."""
    joined = candidates.join(heat, "oid", "left").select(
        "oid",
        F.coalesce("last", F.lit(0)).alias("last"),
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
        (~F.coalesce("sequential", F.lit(False))).alias("not_sequential"),
    )
    return joined.orderBy(*POLICIES[policy], "oid").limit(limit)


EXTENT_BLOCK = 1 << 16  # extents that one row of the free list's derivation stands for


def relocations(objects: DataFrame, volume: str, movable: Column, last: DataFrame, width: int = runs.WIDTH) -> DataFrame:
    """Moves (volume, oid, from, to): the highest movable object into the lowest free extent, while that is lower.

    A move frees an extent above all objects that are still to move, so it never
    becomes a target: pairing in order gives what moving one by one gives.  A
    volume's extents are numbered in runs, not in one task.
    """
    used = objects.filter("extent is not null")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EXTENT_BLOCK)))
    blocks = last.filter("n > 0").select(volume, "n", block.alias("block")).repartition(volume, "block")
    inside = F.sequence(F.col("block") * EXTENT_BLOCK + 1, F.least(F.col("n"), (F.col("block") + 1) * EXTENT_BLOCK))
    every = blocks.select(volume, F.explode(inside).alias("to"))
    free = every.join(used.select(F.col(volume), F.col("extent").alias("to")), [volume, "to"], "left_anti")
    one = F.lit(1).cast("long")
    free = runs.running(free, [volume], ["to"], "k", one, F.sum, width)
    moved = used.filter(movable).select(volume, "oid", "extent", (-F.col("extent")).alias("down"))
    moved = runs.running(moved, [volume], ["down"], "k", one, F.sum, width)
    return moved.join(free, [volume, "k"]).filter(F.col("to") < F.col("extent")).select(volume, "oid", F.col("extent").alias("from_extent"), F.col("to").alias("to_extent"))


STEP_WINDOW = 128  # objects that one eviction step looks at


def evict_step(objects: DataFrame, eligible: Column, heat: DataFrame, policy: str, cursor: int, limit: int) -> DataFrame:
    """(oid, last, frequency, not_sequential, next_cursor): what one step evicts of the ``STEP_WINDOW`` objects from the cursor on.

    The next cursor is behind the window, or at the start where the window was
    not full.  The window is by object id, whatever objects are eligible.
    """
    window = objects.filter(F.col("oid") >= cursor).orderBy("oid").limit(STEP_WINDOW)
    size, last = window.agg(F.count(F.lit(1)), F.max("oid")).first()
    after = last + 1 if size == STEP_WINDOW else 1
    return evict(window.filter(eligible).select("oid"), heat, policy, limit).withColumn("next_cursor", F.lit(after).cast("long"))
