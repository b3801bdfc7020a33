"""Helpers shared by the training-data operators.

Conventions that hold for every operator of the subpackage:

* an operator selects the columns it needs by name, so further columns of any
  name in its input are ignored;
* a null text behaves like the empty text unless the operator says otherwise;
* intermediate tables go to the shared folder named by
  ``spark.checkpoint.dir`` and are never kept on one machine only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockloom.sources.scratch import fresh_path

# ASCII white space, and words as maximal runs of anything else.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(col: str, modulus: int):
    """crc32 of the column written as text, modulo ``modulus``; -1 for a null."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus, F.lit(-1))


def quoted(name: str) -> str:
    """A column's name as Spark parses it, dots included."""
    return f"`{name}`"


def own_columns(df: DataFrame) -> list:
    """The columns of ``df``, to select after others were joined to it."""
    return [F.col(quoted(c)) for c in df.columns]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with a number behind it, such that no column of ``df`` has the name (Spark ignores case)."""
    taken, name, k = {c.lower() for c in df.columns}, wanted, 0
    while name.lower() in taken:
        name, k = f"{wanted}_{k}", k + 1
    return name


def beside(df: DataFrame, own: list[str], sent: Column, new: list[tuple[str, str]], compute: Callable[[list], list]) -> DataFrame:
    """The columns ``own`` of ``df`` and new ones (name, type), computed from slices of the values of ``sent`` in Arrow batches.

    ``compute`` takes a list of values and returns a row of new values for each.
    Names of any kind are set aside meanwhile.
    """
    kept = [f"own_{k}" for k in range(len(own))]
    rows = df.select(*(F.col(quoted(c)).alias(k) for c, k in zip(own, kept, strict=True)), sent.alias("sent"))
    made = StructType()
    for k, (_, kind) in enumerate(new):
        made = made.add(f"new_{k}", kind)
    kinds = to_arrow_schema(made).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("sent").to_pylist()
            rest = batch.drop_columns(["sent"])
            for start, end in text_slices([v or "" for v in values]):
                found = zip(*compute(values[start:end]), strict=True)
                columns = [*rest.slice(start, end - start).columns, *(pa.array(x, kind) for x, kind in zip(found, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made.names])

    schema = StructType([f for f in rows.schema.fields if f.name != "sent"] + made.fields)
    return rows.mapInArrow(run, schema).toDF(*own, *(n for n, _ in new))


class Scratch:
    """Tables of one run in the shared folder.

    Writing a table cuts the lineage: a lost executor costs the tasks it was
    running, not the steps before them.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = fresh_path(spark, tag)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(texts: Iterable, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts with about ``most`` characters together."""
    start = size = 0
    end = 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= most:
            yield start, end
            start, size = end, 0
    if end > start:
        yield start, end


def connected_components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Alternates two star operations until nothing changes: every node tells its
    larger neighbours about the smallest one it knows, then its smaller
    neighbours.  Every round is one pre-aggregated shuffle per step; the edge
    table never grows beyond its first size, and a hub's edges halve in depth
    each round, so a chain of n nodes takes O(log n) rounds.
    """
    now = scratch.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    for k in range(1, rounds + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: neighbours above the node are linked to the smallest known node
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node's lower neighbours and itself are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = scratch.save(small.filter("a <> b").distinct(), f"{name}-{k}")
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        scratch.drop(f"{name}-{k - 1}")
        now = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
