import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm.vptree import VPTree, nearest, unit


def brute(rows, k):
    ok = {i: np.array(v, dtype=float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 10:
            continue
        scored = [(-round(float(ok[q] @ v / np.sqrt(ok[q] @ ok[q]) / np.sqrt(v @ v)), 12), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + 0.5 * rng.normal(size=16)).tolist()) for k in range(700)]
    rows += [(700 + k, rows[10][1]) for k in range(60)]  # one very common vector
    rows += [(800, [2 * x for x in rows[20][1]]), (801, None), (802, []), (803, [0.0] * 16), (804, [None] * 16), (805, [float("nan")] + [1.0] * 15), (806, [float("inf")] * 16), (None, rows[0][1])]
    rows += [(810, [1.0, 2.0]), (811, [2.0, 1.0])]  # another length
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(0))


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id]) and -1 <= r.score <= 1
    return out


def test_exact_at_factor_one(spark, rows):
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = lists(nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, factor=1.0, shard_rows=200, block_rows=30))
    assert found == {q: w for q, w in brute(f32, 5).items() if w}


def test_relaxed_recall_and_repeated_rows(spark, rows):
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(f32, 5)
    found = lists(nearest(frame(spark, rows + rows[:100]), F.col("vec_id") % 10 == 0, factor=1.1, shard_rows=200))
    hits = sum(len(set(found[q]) & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_and_none(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert lists(nearest(df, F.col("vec_id") == 0)) == {0: [2, 1]}
    assert nearest(df, F.col("vec_id") == 9).collect() == []
    assert nearest(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_pruning_visits_less():
    rng = np.random.default_rng(1)
    points = unit(np.repeat(rng.normal(size=(20, 8)), 100, axis=0) + 0.01 * rng.normal(size=(2000, 8)))
    ids = np.arange(2000)
    tree = VPTree.build(points, ids)
    found = tree.ids[tree.search(points[:5], np.arange(5), 3, 1.0)]
    want = np.argsort(-(points[:5] @ points.T) + 9 * (np.arange(5)[:, None] == ids), axis=1)[:, :3]
    assert [set(f) for f in found.tolist()] == [set(w) for w in want.tolist()]


def test_ties_go_to_the_smaller_id(spark):
    line = [(k, [float(k + 1), 2.0 * (k + 1), 3.0 * (k + 1)]) for k in range(200)]  # one direction
    found = lists(nearest(frame(spark, line), F.col("vec_id") % 50 == 0, shard_rows=50))
    assert found == {q: [i for i in range(6) if i != q][:5] for q in (0, 50, 100, 150)}
    corners = [(k, [1.0 if k >> b & 1 else -1.0 for b in range(9)]) for k in range(512)]  # many directions, few cosines
    shuffled = [corners[(k * 37) % 512] for k in range(512)]
    found = lists(nearest(frame(spark, shuffled), F.col("vec_id") % 10 == 0, shard_rows=100))
    assert found == brute(corners, 5)
