"""Streaming forms of batch operators: on the same input both give the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from blockloom.operators import catalog, keyed
from blockloom.sources.versioned import VersionedTable, bucket_of


def fold_writes(table: VersionedTable, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: merge a batch of writes into the table's next version, last writer wins.

    Only the buckets that the batch has keys of are read and written.  The batch
    number names the commit, so a batch that is run again after a failure
    publishes nothing twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        now, bucket = table.latest(), bucket_of(keys, buckets)
        touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        rows = batch.unionByName(table.read(now, touched)) if now else batch
        values = [c for c in batch.columns if c not in (*keys, order)]
        folded = keyed.last_per_key(rows, keys, order, *values).select(*batch.columns)
        table.commit_buckets(folded, bucket, touched, f"b{number}")

    return run


def maintain_counts(table: VersionedTable, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: apply (keys, delta) rows to maintained counters."""

    def run(batch: DataFrame, number: int) -> None:
        changes = batch.groupBy(*keys).agg(F.sum("delta").alias("delta"))
        counts = table.read() if table.commits() else batch.sparkSession.createDataFrame([], changes.withColumnRenamed("delta", "n").schema)
        table.commit(catalog.apply_changes(counts, changes, keys), f"b{number}")

    return run


def new_receipts(stream: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Receipts seen for the first time; a job's state goes when the watermark has passed it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["job", "oid"])


def state_changes(stream: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state differs from their key's last one, in order of ``order`` within each batch."""
    out = stream.select(key, order, state)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)

    def run(name: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        keep = []
        for value in rows[state]:
            keep.append(value != last)
            last = value
        held.update((last,))
        yield rows[keep]

    return out.groupBy(key).applyInPandasWithState(run, schema, f"last {stream.schema[state].dataType.simpleString()}", "append", GroupStateTimeout.NoTimeout)
