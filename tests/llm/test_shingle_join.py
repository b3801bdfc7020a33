import contextlib
import io
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import shingle_join, signature_tree
from blockloom.llm.shingle_join import near_duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    sets, parent = [(i, shingles(t)) for i, t, *_ in rows], {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def check(df, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert found == components(rows)


def test_against_brute_force(docs, corpus):
    check(docs, corpus)


@pytest.fixture
def chains(make_text):
    """Groups of near copies, some linked only through others, and a passage that many documents share."""
    rng, rows = random.Random(8), []
    passage = make_text(rng, "en", 60)
    for g in range(12):
        base = make_text(rng, "de", 40).split()
        for _ in range(25):
            base = list(base)
            base[rng.randrange(40)] = rng.choice(["x", "y", "z"]) + str(rng.randrange(1000))
            rows.append((len(rows), " ".join(base)))
    rows += [(k, passage + " " + make_text(rng, "fr", rng.randint(5, 40))) for k in range(300, 360)]
    return rows


def test_chains_and_passages(spark, chains):
    check(spark.createDataFrame(chains, "doc_id long, text string").repartition(4), chains)


def test_groups_of_many_chunks(spark, chains, monkeypatch):
    monkeypatch.setattr(shingle_join, "CHUNK_SETS", 10)
    check(spark.createDataFrame(chains, "doc_id long, text string").repartition(4), chains)


def test_a_passage_in_every_document(spark, make_text, monkeypatch):
    """Nothing that is sent for one shard or task grows with the number of documents that hold a passage."""
    rng = random.Random(21)
    passage = make_text(rng, "en", 30)
    rows = [(k, f"{passage} {make_text(rng, 'de', rng.randint(3, 30))} {passage if k % 2 else ''}") for k in range(500)]
    rows += [(k, rows[k % 9][1] + " more") for k in range(500, 560)]
    sent = []
    saved = shingle_join.Scratch.save
    monkeypatch.setattr(shingle_join.Scratch, "save", lambda self, df, name: sent.append((name, saved(self, df, name))) or sent[-1][1])
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
    there = next(df for name, df in sent if name == "prefixes")
    per_shingle = max(len(r.a) for r in there.filter("shard >= 0").collect())
    assert per_shingle <= 8 * 30_000
    for name, df in sent:
        if name == "prefixes":
            keys = [k for r in df.filter("shard >= 0").collect() for k in np.frombuffer(r.hashes, dtype=np.uint64).tolist()]
            assert max(keys.count(k) for k in set(keys[:50])) <= df.rdd.getNumPartitions() * 2


def test_shards_go_by_bytes_not_partitions(spark, chains, monkeypatch):
    """However few partitions the input has, a shard's task holds a bounded number of shingles, in bounded parts."""
    monkeypatch.setattr(shingle_join, "SHARD_BYTES", 5_000)
    monkeypatch.setattr(shingle_join, "PART_SHINGLES", 100)
    found, counted = [], shingle_join.count_shared
    monkeypatch.setattr(shingle_join, "count_shared", lambda *args: found.append(counted(*args)) or found[-1])
    check(spark.createDataFrame(chains, "doc_id long, text string").coalesce(1), chains)
    size = sum(len(t.encode()) for _, t in chains)
    assert found[0][1] == -(-size // 5_000) > 4


def test_what_is_sent_does_not_grow_with_the_shards(spark, chains, monkeypatch):
    """A shingle is its hash and a number, for four shards and for thousands of them."""
    sent, kind = [], type(spark.range(0))
    mapped = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *args, **more: sent.append(mapped(self, *args, **more)) or sent[-1])
    df = spark.createDataFrame(chains, "doc_id long, text string").coalesce(1)

    def size():
        shards = shingle_join.count_shared(df, shingle_join.Scratch(spark, "test"), 5, "text")[1]
        return shards, sum(len(x) for row in sent[-1].drop("shard").collect() for x in row)

    few = size()
    monkeypatch.setattr(shingle_join, "SHARD_BYTES", 500)
    many = size()
    assert few[0] == 4 and many[0] > 100
    distinct = len(set().union(*(shingles(t) for _, t in chains)))
    assert few[1] == many[1] == 10 * distinct


def shuffles_of_members(spark, monkeypatch, rows):
    """For each table that is written, how many exchanges of its plan hold members (or the first of equal ones) when no table is small enough to broadcast."""
    found, saved = {}, shingle_join.Scratch.save

    def save(self, df, name):
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            df.explain("formatted")
        n = sum("members#" in x or "first#" in x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan.getvalue()))
        if n:
            found[name] = n
        return saved(self, df, name)

    monkeypatch.setattr(shingle_join.Scratch, "save", save)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return found


def test_members_are_shuffled_twice_however_large_the_tables(spark, chains, monkeypatch):
    """To one row a set in its group, and to the tasks: joins with tables about sets and groups send no members again."""
    assert shuffles_of_members(spark, monkeypatch, chains) == {"candidates": 1, "links": 1}


def test_members_of_large_groups_are_shuffled_twice_a_round(spark, chains, monkeypatch):
    monkeypatch.setattr(shingle_join, "CHUNK_SETS", 10)
    found = shuffles_of_members(spark, monkeypatch, chains)
    assert len(found) > 3
    assert found.pop("across", 2) == 2  # chunks to their pairs, then to tasks
    assert set(found.values()) == {1}


def test_batches_are_cut_by_bytes():
    batch = pa.record_batch({"k": list(range(6)), "b": pa.array([b"x" * 5, None, b"x" * 5, b"x" * 30, b"", b"x"], pa.binary())})
    cut = list(shingle_join.parts([batch, batch.slice(0, 0)], "b", 8))
    assert [c.num_rows for c in cut] == [3, 1, 2]
    assert [k for c in cut for k in c.column("k").to_pylist()] == list(range(6))


def test_boilerplate_documents_in_one_coarse_group(spark, make_text, monkeypatch):
    """Documents made of shared passages only form one large group whose chunks must meet."""
    monkeypatch.setattr(shingle_join, "CHUNK_SETS", 8)
    rng = random.Random(22)
    passages = [make_text(rng, "fr", 12) for _ in range(14)]
    rows = [(k, " ".join(rng.sample(passages, rng.randint(2, 7)))) for k in range(150)]
    rows += [(150 + k, rows[k][1] + " tail") for k in range(0, 150, 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_edges(spark, no_docs):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three"), (6, "é É"), (7, "é é"), (7, "é é")]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 6), (7, 1, 7), (7, 1, 7)]
    assert near_duplicates(no_docs).collect() == []


def test_tree_prunes_nothing_that_links():
    rng, sets = np.random.default_rng(2), []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, size=int(rng.integers(1, 200)), dtype=np.uint64)
        for _ in range(8):
            keep = base[rng.random(len(base)) < rng.choice([0.8, 0.95, 1.0])]
            if len(keep):
                sets.append(np.unique(keep))
    label, groups = signature_tree.connect(sets, 75), defaultdict(set)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if signature_tree.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 75):
                parent[find(i)] = find(j)
    for k, x in enumerate(label.tolist()):
        groups[x].add(k)
    want = defaultdict(set)
    for k in range(len(sets)):
        want[find(k)].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
