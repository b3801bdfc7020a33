"""Operators on small fixtures and against plain Python models."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.functions import binary, paths
from blockloom.operators import catalog, intervals, journal, keyed, packing, references
from blockloom.plans import catalog as catalog_plans, intervals as interval_plans, rules, versions


def test_keyed_table_against_a_dict(spark):
    rng, model = random.Random(3), {}
    for step in range(300):
        if step % 7 == 6:
            a = rng.randrange(500)
            model = {k: v for k, v in model.items() if not a <= k < a + 40}
        elif step % 5 == 4 and model:
            model.pop(rng.choice(sorted(model)))
        else:
            model[rng.randrange(500)] = step
    df, keys = spark.createDataFrame(sorted(model.items()), "k long, v long").repartition(3), sorted(model)
    ids = lambda d: [r.k for r in d.collect()]
    for start in (0, 123, 490, 600):
        assert ids(keyed.scan_after(df, "k", start, 7)) == [k for k in keys if k >= start][:7]
        assert sorted(ids(keyed.range_scan(df, "k", start, start + 90))) == [k for k in keys if start <= k < start + 90]
        leaves = sorted({k >> 3 for k in keys if k >= start})[:2]
        assert ids(keyed.leaf_budget_scan(df, "k", start, 9, 3, 2)) == [k for k in keys if k >= start and k >> 3 in leaves][:9]
        page = keyed.keyset_page(df, "k", start, 5).collect()
        after = [k for k in keys if k > start]
        assert [r.k for r in page] == after[:5] and all(r.has_more == (len(after) > 5) for r in page)
    assert ids(keyed.rank_page(df, "k", 10, 4)) == keys[10:14]
    assert [r["rank"] for r in keyed.rank_of_key(df, "k", [0, 77, 9999]).collect()] == [sum(k < v for k in keys) for v in (0, 77, 9999)]
    with pytest.raises(ValueError):
        keyed.range_scan(df, "k", 5, 4)
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(1, "upsert", "a"), (2, "delete", None), (3, "upsert", "c"), (4, "upsert", "d"), (9, "delete", None)], "k long, op string, v string")
    assert sorted(map(tuple, keyed.apply_upserts(base, new, "k", "v").collect())) == [(1, "a", False), (3, "c", True), (4, "d", True)]


def test_orphans_and_negative_counts(spark):
    pages = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "page long, oid long")
    objects = spark.createDataFrame([(10, 1), (11, 2)], "oid long, kind int")
    assert sorted(r.page for r in references.orphans(pages, objects).collect()) == [2, 3]
    counts = spark.createDataFrame([("a", 1)], "k string, n long")
    with pytest.raises(PySparkException):
        catalog.apply_changes(counts, spark.createDataFrame([("a", -2)], "k string, delta long"), ["k"]).collect()
    with pytest.raises(PySparkException):
        spark.range(1).select(catalog.effective_state(F.lit(7), F.lit(0), F.lit(0))).collect()


def test_cube_against_brute_force(spark):
    rows = [(k, 2 if k % 6 == 5 else 1, 0 if k % 6 == 5 else k % 6, k // 6 % 4, k % 11 == 0, k % 3, k % 2) for k in range(96)]
    df = catalog.classify(spark.createDataFrame(rows, "oid long, kind int, pool int, sync_state int, missing boolean, current_refs long, cloud_refs long"))
    flat = [(r.missing, r.state, r.content_type) for r in df.collect()]
    for r in catalog.cube(df).collect():
        assert r.n == sum(m == r.missing and r.state in (None, s) and r.content_type in (None, t) for m, s, t in flat)


def test_unknown_counts_protect(spark):
    df = references.protection(spark.range(3), [("a", F.when(F.col("id") == 0, F.lit(None).cast("boolean")).otherwise(False)), ("b", F.col("id") == 1)])
    assert [r.reason for r in df.orderBy("id").collect()] == ["a", "b", None]


def test_overlap_join_finds_each_pair_once(spark):
    rng = random.Random(6)
    a = [(k, s, s + rng.randint(1, 300)) for k, s in enumerate(rng.sample(range(2000), 80))]
    b = [(k, s, s + rng.randint(1, 900)) for k, s in enumerate(rng.sample(range(2000), 40))]
    found = intervals.overlap_join(spark.createDataFrame(a, "a long, lstart long, lend long"), spark.createDataFrame(b, "b long, rstart long, rend long"), 64)
    want = sorted((x, y) for x, s, e in a for y, t, u in b if s < u and t < e)
    assert sorted((r.a, r.b) for r in found.collect()) == want


def test_packing_positions(spark):
    rows = [(k * 3, "a" if k % 4 else "b") for k in range(500)]
    found = {r.k: (r.object_ordinal, r.slot, r.sealed) for r in packing.pack_slots(spark.createDataFrame(rows, "k long, pool string"), "pool", "k", 7, run_rows=50).collect()}
    for pool in "ab":
        ks = [k for k, p in rows if p == pool]
        for n, k in enumerate(ks):
            assert found[k] == (n // 7, n % 7, (n // 7 + 1) * 7 <= len(ks))


def test_damaged_logs(spark):
    lines = [("s", 0, '{"sequence": 5}'), ("s", 1, "{torn"), ("s", 2, '{"sequence": 4}'), ("s", 3, '{"sequence": 6}'), ("s", 4, "x" * 12001), ("s", 5, '{"sequence": 9}'), ("t", 0, '{"sequence": 1}')]
    rows = journal.parse_segments(spark.createDataFrame(lines, "segment string, line_no long, line string"), "sequence long").filter("ok").collect()
    assert sorted((r.segment, r.row.sequence) for r in rows) == [("s", 5), ("s", 6), ("t", 1)]
    log = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("c", 2, True)], "d string, seq long, ok boolean")
    assert sorted((r.d, r.seq) for r in journal.valid_prefix(log, ["d"], "seq", F.col("ok")).collect()) == [("a", 1), ("b", 1), ("c", 2)]
    assert {r.d: r.valid for r in journal.whole_or_nothing(log, ["d"], "seq", F.col("ok")).collect()} == {"a": False, "b": True, "c": False}


def test_binary_functions(spark):
    data = struct.pack("<QIH", 2**63 + 5, 70000, 513)
    df = spark.createDataFrame([(bytearray(data), bytearray(b"id"), 7, 9)], "b binary, i binary, p long, v long")
    row = df.select(
        binary.le_number(F.col("b"), 1, 8).alias("q"),
        binary.le_number(F.col("b"), 9, 4).alias("i"),
        binary.le_number(F.col("b"), 13, 2).alias("h"),
        binary.bound_tag(F.col("i"), F.col("p"), F.col("v"), F.col("b")).alias("t"),
    ).first()
    assert (int(row.q), int(row.i), int(row.h)) == (2**63 + 5, 70000, 513)
    assert row.t == hashlib.sha256(b"id" + struct.pack("<QQ", 7, 9) + data).hexdigest()[:32]


def test_paths(spark):
    row = spark.range(1).select(paths.parent(F.lit("/a/b")), paths.parent(F.lit("a")), paths.commit_name(F.lit(12), F.lit("rr")), paths.is_component(F.lit("a/b"))).first()
    assert tuple(row) == ("/a", "", "00000000000000000012-rr.json", False)


def test_partition_tables(spark):
    from blockloom.sources.partitions import partitions

    def image(spans):
        entries = b"".join(b"T" * 16 + b"U" * 16 + struct.pack("<QQ", a, b) + bytes(80) for a, b in spans).ljust(4 * 128, b"\0")
        head = b"EFI PART" + struct.pack("<III", 65536, 92, 0) + bytes(4) + bytes(48) + struct.pack("<QIII", 2, 4, 128, zlib.crc32(entries))
        head = head[:16] + struct.pack("<I", zlib.crc32(head)) + head[20:]
        boot = bytes(446) + bytes([0, 0, 0, 0, 0xEE]) + bytes(59) + b"\x55\xaa"
        return boot + head.ljust(512, b"\0") + entries

    good = image([(10, 19), (20, 30)])
    rows = [(1, bytearray(good)), (2, bytearray(image([(10, 20), (20, 30)]))), (3, bytearray(good[:600] + b"x" + good[601:])), (4, bytearray(good[:1030] + b"x" + good[1031:])), (5, bytearray(b"")), (6, None)]
    found = sorted(((r.k, r.partition, r.first_sector, r.error) for r in partitions(spark.createDataFrame(rows, "k long, d binary"), "k", "d").collect()), key=str)
    assert [f[0] for f in found] == [1, 1, 2, 3, 4, 5]
    assert found[:2] == [(1, 0, 10, None), (1, 1, 20, None)] and found[2][3] == "overlap" and all(f[3] for f in found[2:])


def test_second_copy_of_a_partition_table():
    from blockloom.sources.partitions import read_entries

    entries = (b"T" * 16 + b"U" * 16 + struct.pack("<QQ", 10, 19) + bytes(80)).ljust(4 * 128, b"\0")

    def header(entries_at, other, guid=b"D"):
        head = b"EFI PART" + struct.pack("<III", 65536, 92, 0) + bytes(4) + struct.pack("<QQ", 0, other) + bytes(16) + guid * 16 + struct.pack("<QIII", entries_at, 4, 128, zlib.crc32(entries))
        return (head[:16] + struct.pack("<I", zlib.crc32(head)) + head[20:]).ljust(512, b"\0")

    boot = bytes(446) + bytes([0, 0, 0, 0, 0xEE]) + bytes(59) + b"\x55\xaa"
    good = boot + header(2, 4) + entries + entries + header(3, 1)
    assert read_entries(good) == [(0, 10, 19, None)]
    assert read_entries(good[:-500] + b"x" + good[-499:])[0][3] == "backup header"
    assert read_entries(boot + header(2, 4) + entries + bytes(512) + header(3, 1))[0][3] == "backup entries"
    assert read_entries(boot + header(2, 4) + entries + entries + header(3, 1, b"E"))[0][3] == "backup entries"
    assert read_entries(good[: 4 * 512]) == [(0, 10, 19, None)]  # an image without the second copy


def test_run_lists(spark):
    from blockloom.functions.runlists import parse, runs

    good = bytes([0x21, 5, 0x10, 0x27, 0x01, 3, 0x11, 2, 0xFF, 0])
    assert parse(good) == [(0, 5, 10000), (5, 3, None), (8, 2, 9999)]
    bad = [b"", b"\x00", good[:-1], good[:3], bytes([0x11, 1, 0xFF, 0]), bytes([0x10, 1, 0])]
    rows = spark.createDataFrame([(0, bytearray(good)), *((k, bytearray(b)) for k, b in enumerate(bad, 1)), (9, None)], "k long, d binary").withColumn("r", runs()("d")).collect()
    found = {r.k: r.r and [tuple(x) for x in r.r] for r in rows}
    assert found[0] == parse(good) and all(found[k] is None for k in found if k)


def test_digests_and_keys(spark):
    from blockloom.functions import crypto

    data = b"abcdefghij"
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "k long, d binary")
    found = {r.k: (r.p, r.s) for r in df.select("k", crypto.part_digests(F.col("d"), 4).alias("p"), crypto.sign(b"key")("d").alias("s")).collect()}
    md5 = lambda x: hashlib.md5(x).hexdigest()
    assert found[1][0] == [md5(b"abcd"), md5(b"efgh"), md5(b"ij")] and found[2][0] == [md5(b"")]
    assert found[1][1] == __import__("hmac").new(b"key", data, "sha256").hexdigest() and found[3][1] is None
    key = df.filter("k = 1").select(crypto.derive_key(10)(F.lit("pw"), "d").alias("x")).first().x
    assert bytes(key) == hashlib.pbkdf2_hmac("sha256", b"pw", data, 10)


def test_windows_in_runs_equal_plain_windows(spark):
    from pyspark.sql import Window

    from blockloom.operators import runs

    rows = spark.range(0, 400).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 401).alias("o"), (F.col("id") * 13 % 29).alias("v")).withColumn("v", F.when(F.col("v") != 5, F.col("v")))
    w = Window.partitionBy("k").orderBy("o")
    got = runs.with_previous(rows, ["k"], ["o"], {"p": F.col("v")}, 16)
    want = rows.withColumn("p", F.lag("v").over(w))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    for total in (F.sum, F.min, F.max):
        for inclusive in (True, False):
            got = runs.running(rows, ["k"], ["o"], "t", F.col("v"), total, 16, inclusive)
            want = rows.withColumn("t", total("v").over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_reach_ends_in_circles_and_counts_shared_nodes_once(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (2, 4), (4, 5), (9, 10)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert sorted(map(tuple, references.reachable(spark, edges, roots, f"file://{tmp_path}/a").collect())) == [(1, 0), (2, 1), (3, 2), (4, 1), (5, 2)]
    chain = spark.range(1, 60).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    assert references.reachable(spark, chain, roots, f"file://{tmp_path}/b").count() == 60
    assert references.reachable(spark, edges, roots.limit(0), f"file://{tmp_path}/c").collect() == []


def test_unknown_filters_are_errors(spark):
    from blockloom.operators import catalog as c

    for bad in ({"state": "lost"}, {"kind": "video"}):
        with pytest.raises(ValueError):
            c.block_page(spark.range(1), 1, **bad)


def test_config_pages_of_one_small_file_take_several_tasks(spark, tmp_path):
    """Each customer becomes a page of 4 KB, so the work must not follow the partitions of the file."""
    spark.range(70_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = rules.config_pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == fx.tasks(spark.range(70_000), 1 << 15) == 9
    seen = {r.verdict: r.n for r in found.groupBy("verdict").count().withColumnRenamed("count", "n").collect()}
    k = range(70_000)
    assert seen["format"] == sum(i % 11 == 5 for i in k) and seen["checksum"] == sum(i % 11 != 5 and i % 13 == 6 for i in k)
    assert seen["length"] == sum(i % 11 != 5 and i % 13 != 6 and i % 17 == 4 for i in k)


def test_fixture_rows_are_dealt_by_number(spark):
    assert [fx.tasks(spark.range(n), 1000) for n in (0, 100, 500, 1000, 9000, 50_000)] == [1, 1, 5, 9, 10, 51]


def test_block_requests_work_the_view_out_once(spark, sf_dir, monkeypatch):
    made, viewed = [], catalog_plans.viewed
    count = lambda *args: made.append(1) or viewed(*args)
    monkeypatch.setattr(catalog_plans, "viewed", count)
    monkeypatch.setattr(rules, "viewed", count)
    plan = rules.block_requests(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "l_orderkey" not in plan


@pytest.mark.parametrize("query", [versions.snapshot_restore, interval_plans.coalesce_runs])
def test_pages_are_dealt_by_their_number(spark, sf_dir, monkeypatch, query):
    """What a task holds in memory goes by rows, however few partitions the shuffle would be coalesced to."""
    monkeypatch.setattr(fx, "tasks", lambda rows, most=0: 11)
    plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and ", 11), REPARTITION_BY_NUM" in plan
    assert "hashpartitioning(l_orderkey#" in plan and "l_linenumber" not in "".join(x for x in plan.split("\n") if "ENSURE_REQUIREMENTS" in x)
