import re

import numpy as np
import pytest

from blockloom.llm import mixing
from blockloom.llm.mixing import mix_sources


def targets(sizes, cap=3.0):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {s for s in sizes if sizes[s] == 0}
    while True:
        free = sum(weight[s] for s in sizes if s not in full)
        level = (total - sum(cap * sizes[s] for s in full)) / free if free else 0
        more = {s for s in sizes if s not in full and level * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= more


def test_against_brute_force(docs, corpus):
    rows = mix_sources(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus}
    sizes = {}
    for i, _, _, s in corpus:
        sizes[s] = sizes.get(s, 0) + size[i]
    want, taken = targets(sizes), {}
    assert len(rows) == len(corpus)
    source = {i: s for i, _, _, s in corpus}
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        largest = max((size[i] for i in source if source[i] == s), default=0)
        assert abs(taken[s] - want[s]) <= max(10, 0.05 * want[s], largest / 2 if s == "long" else 0)  # "long" has two documents
    assert sorted(map(tuple, mix_sources(docs).collect())) == sorted(map(tuple, rows))


def test_edges(spark, no_docs):
    assert mix_sources(no_docs).collect() == []
    only = spark.createDataFrame([(1, None, "a"), (2, " ", "a"), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mix_sources(only).collect()] == [(0, 0.0, 0)] * 3
    equal = spark.createDataFrame([(k, "one two three", "s") for k in range(50)], "doc_id long, text string, source string")
    assert {(r.copies, r.taken) for r in mix_sources(equal).collect()} == {(1, 3)}
    capped = spark.createDataFrame([(1, "w " * 2, "a"), (2, "w " * 100, "b")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in mix_sources(capped).collect()}
    assert found[1].target == 6.0 and found[1].copies == 3 and found[2].target == 96.0


def test_rates_are_those_of_a_dense_solver(docs, corpus):
    """Rates vary within a source, as exp(lambda * size) below the cap, and meet the target."""
    rows, source = mix_sources(docs).collect(), {i: s for i, _, _, s in corpus}
    by_source = {}
    for r in rows:
        if r["size"]:
            by_source.setdefault(source[r.doc_id], []).append(r)
    varied = 0
    for found in by_source.values():
        sizes, target = np.array([r["size"] for r in found], dtype=float), found[0].target
        taken = lambda x: (sizes * np.minimum(3.0, np.exp(np.minimum(x * sizes, 50)))).sum()
        if target >= 3 * sizes.sum() - 1e-9:
            want = np.full(len(sizes), 3.0)
        else:
            low, high = -50.0, 50.0
            for _ in range(300):  # bisection
                middle = (low + high) / 2
                low, high = (middle, high) if taken(middle) < target else (low, middle)
            want = np.minimum(3.0, np.exp(low * sizes))
            varied += len(set(sizes)) > 1 and abs(low) > 1e-9
            assert sum(r.rate * r["size"] for r in found) == pytest.approx(target, rel=1e-6)
        assert np.allclose([r.rate for r in found], want, rtol=1e-5, atol=1e-12)
    assert varied >= 2


def test_repeated_rows_do_not_fill_one_run(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_RUN", 40)
    monkeypatch.setattr(mixing, "RUN_ROWS", 16)
    rows = [(None, "one two three", "a")] * 400 + [(k, "w " * 40, "b") for k in range(200)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(found) == 600
    for size in (3, 40):
        of = [r for r in found if r["size"] == size]
        assert abs(sum(r.taken for r in of) - of[0].target) <= size


def test_extreme_sizes_and_many_sources(spark):
    rows = [(k, "w " * (1 + k % 5), f"s{k % 40:02d}") for k in range(400)] + [(1000 + k, "w " * 20_000, "s03") for k in range(3)] + [(2000, "w " * 30_000, "s04")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix_sources(df).collect()
    name, sizes = {r[0]: r[2] for r in rows}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    for s in sizes:
        of = [r for r in found if name[r.doc_id] == s]
        assert of[0].target == pytest.approx(want[s])
        assert sum(r.rate * r["size"] for r in of) == pytest.approx(want[s], rel=1e-6)
        assert all(0 <= r.copies <= 3 for r in of)
