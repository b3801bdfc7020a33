"""Object classification, runtime overlay and count cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the content types by pool, and of the sync states by number.
TYPES = ["data", "ntfs_mft", "ntfs_log", "ntfs_usn", "ntfs_metadata"]
STATES = ["local", "pending", "uploaded", "synced"]


def name_of(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def content_type(kind: Column, pool: Column) -> Column:
    """Page objects by pool, pools beyond the last count as it; everything else is index."""
    return F.when(kind == 1, name_of(TYPES, F.least(pool, F.lit(len(TYPES) - 1)))).otherwise("container_index")


def effective_state(state: Column, current_refs: Column, cloud_refs: Column) -> Column:
    """A pending object that nothing refers to is local again; a state beyond the last is an error."""
    known = F.when(state.between(0, len(STATES) - 1), state).otherwise(F.raise_error(F.concat(F.lit("unknown sync state "), state.cast("string"))).cast("int"))
    return F.when((state == 1) & (current_refs == 0) & (cloud_refs == 0), 0).otherwise(known)


def classify(objects: DataFrame) -> DataFrame:
    """Add ``content_type`` and ``state`` (the effective one's name)."""
    state = effective_state(F.col("sync_state"), F.col("current_refs"), F.col("cloud_refs"))
    return objects.withColumn("content_type", content_type(F.col("kind"), F.col("pool"))).withColumn("state", name_of(STATES, state))


def overlay(classified: DataFrame, receipts: DataFrame, transfer: DataFrame) -> DataFrame:
    """Add ``shown``: a durable receipt beats a transfer notice, which beats the stored state."""
    confirmed = receipts.select("oid", F.lit(True).alias("confirmed"))
    return (
        classified.join(confirmed, "oid", "left")
        .join(transfer, "oid", "left")
        .withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
        .withColumn("shown", F.when(F.col("confirmed"), "uploaded").otherwise(F.coalesce("transfer_state", "state")))
        .withColumn("is_pending", (F.col("state") == "pending") & ~F.col("confirmed"))
    )


def summary(view: DataFrame, object_size: int) -> DataFrame:
    """Objects and bytes, all and pending, by shown state, content type and residence."""
    count = F.count(F.lit(1))
    pending = F.count_if("is_pending")
    return view.groupBy("shown", "content_type", "missing").agg(
        count.alias("n_objects"), (count * object_size).alias("n_bytes"), pending.alias("pending_objects"), (pending * object_size).alias("pending_bytes")
    )


def cube(classified: DataFrame) -> DataFrame:
    """All 35 counters for each residence; the sub-totals have nulls."""
    sets = [["missing", "state", "content_type"], ["missing", "state"], ["missing", "content_type"], ["missing"]]
    return classified.groupingSets(sets, "missing", "state", "content_type").agg(F.count(F.lit(1)).alias("n"))


def cube_violations(cells: DataFrame) -> DataFrame:
    """Residences whose counters do not add up: states, types and pairs must all sum to the total."""
    state, kind = F.col("state").isNotNull(), F.col("content_type").isNotNull()
    sums = cells.groupBy("missing").agg(
        F.sum(F.when(~state & ~kind, F.col("n"))).alias("total"),
        F.sum(F.when(state & ~kind, F.col("n"))).alias("by_state"),
        F.sum(F.when(~state & kind, F.col("n"))).alias("by_type"),
        F.sum(F.when(state & kind, F.col("n"))).alias("by_pair"),
    )
    return sums.withColumn("consistent", (F.col("total") == F.col("by_state")) & (F.col("total") == F.col("by_type")) & (F.col("total") == F.col("by_pair")))


def signed_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counter changes of a batch of objects: minus one where each was, plus one where it is."""
    minus = before.select(*keys, F.lit(-1).cast("long").alias("delta"))
    plus = after.select(*keys, F.lit(1).cast("long").alias("delta"))
    return minus.unionByName(plus).groupBy(*keys).agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def apply_changes(counts: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Maintained counters: counts plus changes, without cells that became empty; a negative one is an error."""
    both = counts.select(*keys, "n").unionByName(changes.select(*keys, F.col("delta").alias("n")))
    total = both.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")
    return total.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("negative counter")).cast("long")).otherwise(F.col("n")))


# States a block can be shown in, the stored ones first.
STATES = ["local", "pending", "uploaded", "synced", "uploading", "failed"]
TYPES = ["data", "ntfs_mft", "ntfs_log", "ntfs_usn", "ntfs_metadata", "container_index"]
MOST_BLOCKS = 256


def block_page(view: DataFrame, extents: int, state: str | None = None, kind: str | None = None, start: int | None = None, page: int | None = None, limit: int | None = None) -> DataFrame:
    """(extent, oid, shown, content_type, total): a page of blocks in order of extent.

    Limits are clamped to 1..256 (256 by default); a page counts in limits, a
    start in blocks.  Without a filter every extent is a block, whatever it
    holds; with one, only objects that are here and match.  Names that are not
    known are an error.
    """
    if state is not None and state not in STATES:
        raise ValueError("unknown sync state filter")
    if kind is not None and kind not in TYPES:
        raise ValueError("unknown content type filter")
    size = max(1, min(MOST_BLOCKS, MOST_BLOCKS if limit is None else limit))
    first = start if start is not None else (page or 0) * size
    columns = ["extent", "oid", "shown", "content_type"]
    if state is None and kind is None:
        wanted = view.sparkSession.range(first, max(first, min(extents, first + size))).withColumnRenamed("id", "extent")
        held = view.filter(F.col("extent").isNotNull() & (F.col("extent") >= first) & (F.col("extent") < first + size)).select(*columns)
        return wanted.join(held, "extent", "left").select(*columns, F.lit(extents).cast("long").alias("total"))
    hits = view.filter(~F.col("missing"))
    for column, value in (("shown", state), ("content_type", kind)):
        hits = hits if value is None else hits.filter(F.col(column) == value)
    total = hits.agg(F.count(F.lit(1))).first()[0]
    return hits.select(*columns).orderBy("extent").offset(first).limit(size).withColumn("total", F.lit(total))


def totals(view: DataFrame, object_size: int) -> DataFrame:
    """One row of totals over a view with its runtime states."""
    pending, missing = F.col("is_pending"), F.col("missing")
    return view.agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(~missing).alias("resident_objects"),
        F.count_if(missing).alias("missing_objects"),
        *(F.count_if(F.col("shown") == s).alias(f"{s}_objects") for s in STATES),
        F.count_if(pending).alias("pending_total"),
        (F.count_if(pending) * object_size).alias("pending_bytes"),
        F.count_if(pending & ~missing).alias("pending_resident"),
        F.count_if(pending & missing).alias("pending_missing"),
        F.count_if((F.col("sync_state") == 1) & ~F.col("confirmed")).alias("job_remaining"),
    )


def projection(view: DataFrame, page_size: int, object_size: int) -> DataFrame:
    """Objects as they are shown, from a view with refs, used, job (is a job ready) and counted (does it count the object).

    Pins are true, false or, where only a walk could tell, null.
    """
    refs, current = F.col("refs"), F.col("current_refs")
    snapshot = F.when(refs == 0, False).when((current == 0) & ~F.col("job"), True)
    upload = F.when(F.col("counted"), True).when(F.col("job"), False)
    return view.select(
        F.col("extent").alias("block"),
        "oid",
        F.when(F.col("kind") == 1, "data").otherwise("metadata").alias("object_kind"),
        "content_type",
        F.col("shown").alias("sync_state"),
        ((F.col("sync_state") >= 2) | F.col("confirmed")).alias("uploaded"),
        "sealed",
        F.col("used").alias("used_pages"),
        (F.col("used") * page_size).alias("used_bytes"),
        refs.alias("local_reference_count"),
        current.alias("current_reference_count"),
        F.col("cloud_refs").alias("cloud_reference_count"),
        snapshot.alias("snapshot_pinned"),
        upload.alias("upload_pinned"),
        F.lit(object_size).cast("long").alias("length"),
    )
