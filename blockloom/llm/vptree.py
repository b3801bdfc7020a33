"""Nearest neighbours by cosine with one vantage-point tree per shard.

On unit vectors the Euclidean distance is a metric that falls as the cosine
rises.  A node splits its points at the median distance to a vantage point and
keeps the range of distances on each side; a side is left when the triangle
inequality, its bound multiplied by ``factor``, puts it beyond the worst
neighbour found so far.  Factor 1 is exact search; a larger one visits less.
Queries go down to the leaf nearest to them, then walk the tree together, so a
visit is one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockloom.llm.arrays import local_path, map_array, write_array
from blockloom.llm.common import Scratch, quoted

LEAF = 64
DIGITS = 12  # cosines, and components of unit vectors, that agree to so many places count as equal
KINDS = ("points", "ids", "nodes", "ranges")
SLACK = 1e-7  # what rounding can add to a small distance


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class VPTree:
    """Points and ids in tree order; nodes as rows (start, end, vantage point, left child, right child) and ranges of distances."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, nodes: np.ndarray, ranges: np.ndarray):
        self.points, self.ids, self.nodes, self.ranges = points, ids, nodes, ranges

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray) -> VPTree:
        order = np.arange(len(points))
        nodes, ranges, todo = [[0, len(points), -1, -1, -1]], [[0.0] * 4], [0]
        while todo:
            k = todo.pop()
            start, end = nodes[k][:2]
            if end - start <= LEAF:
                continue
            at = order[start:end]
            spread = points[at[:: max(1, len(at) // 8)]]  # of a few points the one whose distances vary most
            some = distance(points[at[:: max(1, len(at) // 256)]] @ spread.T)
            vantage = at[:: max(1, len(at) // 8)][int(np.argmax(some.var(axis=0)))]
            d = distance(points[at] @ points[vantage])
            half = len(at) // 2
            split = np.argpartition(d, half)
            order[start:end], d = at[split], d[split]
            near, far = d[:half], d[half:]
            ranges[k] = [near.min(), near.max(), far.min(), far.max()]
            nodes[k][2:] = [int(vantage), len(nodes), len(nodes) + 1]
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[start, start + half, -1, -1, -1], [start + half, end, -1, -1, -1]]
            ranges += [[0.0] * 4, [0.0] * 4]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        nodes = np.array(nodes, dtype=np.int64)
        inner = nodes[:, 2] >= 0
        nodes[inner, 2] = place[nodes[inner, 2]]
        return cls(points[order], ids[order], nodes, np.array(ranges))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Positions of each query's ``k`` nearest points, -1 where there are fewer; points with the query's own id are left out.

        Cosines that agree to ``DIGITS`` places are ties, and the smaller id goes first.
        """
        best = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), -1, dtype=np.int64)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)

        def look_through(start: int, end: int, active: np.ndarray) -> None:
            c = np.round(queries[active] @ self.points[start:end].T, DIGITS)
            ids = self.ids[start:end]
            c[own[active][:, None] == ids[None, :]] = -np.inf
            some = (c >= best[active, -1:]).any(axis=1)
            active, c = active[some], c[some]
            every = np.concatenate([best[active], c], axis=1)
            where = np.concatenate([found[active], np.broadcast_to(np.arange(start, end), c.shape)], axis=1)
            named = np.concatenate([names[active], np.broadcast_to(ids, c.shape)], axis=1)
            top = np.lexsort((named, -every), axis=1)[:, :k]
            best[active], names[active] = np.take_along_axis(every, top, 1), np.take_along_axis(named, top, 1)
            found[active] = np.where(np.isinf(best[active]), -1, np.take_along_axis(where, top, 1))

        def bounds(node: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = distance(queries[active] @ self.points[self.nodes[node, 2]])
            low, high, far_low, far_high = self.ranges[node].tolist()
            return np.maximum(np.maximum(low - d, d - high), 0.0), np.maximum(np.maximum(far_low - d, d - far_high), 0.0)

        # every query first goes down to the leaf nearest to it, for a bound to prune by ...
        home = np.zeros(len(queries), dtype=np.int64)
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, active = todo.pop()
            start, end, _, left, right = self.nodes[node].tolist()
            if left < 0:
                home[active] = node
                look_through(start, end, active)
                continue
            to_near, to_far = bounds(node, active)
            near = to_near <= to_far
            todo += [(side, active[who]) for side, who in ((left, near), (right, ~near)) if who.any()]
        # ... then all walk the tree together
        walk = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while walk:
            node, active, bound = walk.pop()
            active = active[bound * factor <= distance(best[active, -1]) + SLACK]  # the worst neighbour may be nearer by now
            if not len(active):
                continue
            start, end, _, left, right = self.nodes[node].tolist()
            if left < 0:
                look_through(start, end, active[home[active] != node])
                continue
            to_near, to_far = bounds(node, active)
            walk += [(right, active, to_far), (left, active, to_near)]
        return found


def usable(col: str) -> Column:
    """Vectors that take part: not null, not zero, every component a finite number."""
    return F.coalesce(
        F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(col, lambda x: x != 0),
        F.lit(False),
    )


def with_direction(rows: DataFrame) -> DataFrame:
    """Add ``direction``, a digest of the unit vector's components to ``DIGITS`` places, alike for multiples of one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = [b""] * batch.num_rows
            v = batch.column("v")
            flat, size = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy()
            start = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                u = np.round(unit(flat[start[at][:, None] + np.arange(n)]), DIGITS) + 0.0  # no negative zero
                for k, x in zip(at.tolist(), u, strict=True):
                    found[k] = xxhash.xxh3_128_digest(x.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "direction"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("direction", "binary"))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 8192,
    block_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` nearest others, nearest first, ties to the smaller id.

    Vectors that are null or zero or hold a null or non-finite component take no
    part, nor rows with a null id; vectors are compared with those of their own
    length.  Repeated rows count once.  Of vectors of one direction only the
    k + 1 with the smallest ids can be among a query's nearest others, so the
    rest are left out of the index, which therefore holds no group larger than
    that.  Cosines that agree to 12 places are ties.  All candidates are returned
    where there are fewer than ``k``, and none for an empty table; further
    columns of any name are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vp")
    folder = local_path(scratch.path("index"))
    found = (
        vectors.filter(usable(quoted(vector_col)) & F.col(quoted(id_col)).isNotNull())
        .select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"), is_query.alias("q"))
        .dropDuplicates(["id", "v"])
        .withColumn("dim", F.size("v"))
    )
    rows = scratch.save(with_direction(found), "rows")
    equal = Window.partitionBy("dim", "direction").orderBy("id")
    points = rows.withColumn("r", F.row_number().over(equal)).filter(F.col("r") <= k + 1).select("dim", "id", "v")
    points = scratch.save(points, "points")
    shards = max(1, -(-points.count() // shard_rows))
    queries = rows.filter("q")
    blocks = max(1, -(-queries.count() // block_rows))

    def arrays(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = found.column("id").to_numpy()
        flat = found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(len(ids), -1)[order]

    def write_tree(found: pa.Table) -> pa.Table:
        name = f"{found.column('dim')[0].as_py()}-{found.column('part')[0].as_py()}"
        ids, v = arrays(found)
        tree = VPTree.build(unit(v), ids)
        for kind in KINDS:
            write_array(folder, f"{kind}-{name}", getattr(tree, kind))
        return found.select(["dim", "part"]).slice(0, 1)

    def write_block(found: pa.Table) -> pa.Table:
        name = f"{found.column('dim')[0].as_py()}-{found.column('part')[0].as_py()}"
        ids, v = arrays(found)
        write_array(folder, f"queryids-{name}", ids)
        write_array(folder, f"queries-{name}", unit(v))
        return found.select(["dim", "part"]).slice(0, 1)

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        return df.select("dim", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v").groupBy("dim", "part")

    trees = scratch.save(dealt(points, shards).applyInArrow(write_tree, "dim int, part int"), "trees").withColumnRenamed("part", "shard")
    asked = scratch.save(dealt(queries, blocks).applyInArrow(write_block, "dim int, part int"), "asked").withColumnRenamed("part", "block")
    pairs = trees.join(asked, "dim")  # names of files: every block of the stated queries meets every shard

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard, block = f"{r['dim']}-{r['shard']}", f"{r['dim']}-{r['block']}"
                own, q = map_array(folder, f"queryids-{block}"), map_array(folder, f"queries-{block}")
                tree = VPTree(*(map_array(folder, f"{kind}-{shard}") for kind in KINDS))
                ids = tree.ids
                at = tree.search(q, own, min(len(ids), k + 11), factor)
                rows, cols = np.nonzero(at >= 0)
                at = at[rows, cols]
                cosine = (q[rows] * tree.points[at]).sum(axis=1)  # pair by pair, so equal vectors score equally
                order = np.lexsort((ids[at], -np.round(cosine, DIGITS), rows))
                rows, at, cosine = rows[order], at[order], cosine[order]
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = nth < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[rows[keep]], pa.int64()), pa.array(ids[at[keep]], pa.int64()), pa.array(np.clip(cosine[keep], -1.0, 1.0), pa.float64())], ["query_id", "id", "score"]
                )

    tasks = max(1, min(4000, shards * blocks))
    found = pairs.repartition(tasks, "dim", "shard", "block").mapInArrow(search, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
