"""Sources, sinks and streaming twins."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blockloom import fixtures as fx
from blockloom.operators import journal, keyed
from blockloom.sources import jsonl, transport
from blockloom.sources.listing import PagedListing
from blockloom.sources.versioned import VersionConflict, VersionedTable
from blockloom.streaming import twins


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.latest() == 0
    assert t.commit(spark.range(3), "a") == 1 and t.commit(spark.range(5), "b", expected=1) == 2
    assert t.commit(spark.range(9), "a") == 1 and t.read().count() == 5 and t.read(1).count() == 3
    with pytest.raises(VersionConflict):
        t.commit(spark.range(1), "c", expected=1)
    assert t.keep(1) == [1] and t.commits() == {2: "b"}
    with pytest.raises(KeyError):
        t.read(1)


def test_of_two_concurrent_commits_one_wins(spark, tmp_path):
    """The second writer publishes between the first one's look at the versions and its own publishing."""
    root = f"file://{tmp_path}/t"
    first, second = VersionedTable(spark, root), VersionedTable(spark, root)
    publish = first._publish

    def late(version, description):
        assert second.commit(spark.range(7), "second") == version
        publish(version, description)

    first._publish = late
    with pytest.raises(VersionConflict):
        first.commit(spark.range(3), "first")
    assert first.commits() == {1: "second"} and first.read().count() == 7
    first._publish = publish
    assert first.commit(spark.range(3), "first") == 2 and second.read().count() == 3


def test_buckets_take_over_what_a_commit_does_not_touch(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v long")
    bucket = (F.col("k") % 4).cast("int")
    t.commit_buckets(rows(range(12), 1), bucket, [0, 1, 2, 3], "a")
    t.commit_buckets(rows([1, 5], 2), bucket, [1, 2], "b")  # bucket 2 becomes empty, 9 goes from bucket 1
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(0, 1), (1, 2), (3, 1), (4, 1), (5, 2), (7, 1), (8, 1), (11, 1)]
    assert sorted(r.k for r in t.read(buckets=[1, 2]).collect()) == [1, 5] and t.read(1).count() == 12
    assert t.keep(1) == [1] and t.read().count() == 8
    t.commit_buckets(rows([], 1), bucket, [0, 1, 3], "c")
    assert t.read().collect() == [] and t.read().columns == ["k", "v"]


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from blockloom.sources import scratch

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session)


def test_journal_round_trip_and_damage(spark, tmp_path):
    rows = spark.range(1, 46).select(
        F.col("id").alias("sequence"), F.concat(F.lit("disk-"), (F.col("id") % 2).cast("string")).alias("disk_id"), F.when(F.col("id") % 7 == 0, "error").otherwise("info").alias("level")
    )
    folder = tmp_path / "log"
    jsonl.write_segments(rows, f"file://{folder}", 16)
    assert len(list(folder.glob("segment=*"))) == 3
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, part in enumerate(sorted(folder.glob("segment=*/*.json"))):
        (flat / f"activity-{k:04d}.jsonl").write_text(part.read_text() + ("{torn" if k == 2 else ""))
    found = jsonl.read_segments(spark, f"file://{flat}", newest=2)
    assert sorted(r.sequence for r in found.collect()) == list(range(16, 46))
    page = found.filter("sequence < 40 and level = 'error'").orderBy(F.desc("sequence")).limit(2)
    assert [r.sequence for r in page.collect()] == [35, 28]


def test_transport_frames(spark):
    magic = b"TESTFRM1"
    rows = [(1, bytearray(b"")), (2, bytearray(b"abc" * 1000)), (3, None)]
    df = spark.createDataFrame(rows, "k long, d binary").withColumn("f", transport.encode(magic)("d"))
    back = {r.k: (r.x.data, r.x.error) for r in df.withColumn("x", transport.decode(magic)("f")).collect()}
    assert back == {1: (b"", None), 2: (b"abc" * 1000, None), 3: (None, None)}
    frame = df.filter("k = 2").first().f
    bad = [frame[:100], b"X" + frame[1:], frame[:20] + b"\xff" + frame[21:], frame[:-5]]
    errors = spark.createDataFrame([(bytearray(b),) for b in bad], "f binary").select(transport.decode(magic)("f").alias("x")).collect()
    assert [r.x.error for r in errors] == ["header", "header", "digest", "frame"]
    key, iv = F.lit(bytearray(b"k" * 16)), F.lit(bytearray(b"i" * 12))
    sealed = df.filter("k = 2").withColumn("e", transport.encrypted(F.col("f"), key, iv, F.lit("id-2")))
    assert sealed.select((transport.decrypted(F.col("e"), key, F.lit("id-2")) == F.col("f")).alias("same")).first().same
    with pytest.raises(PySparkException):
        sealed.select(transport.decrypted(F.col("e"), key, F.lit("id-3"))).collect()


def test_paged_listing(spark, tmp_path):
    spark.dataSource.register(PagedListing)
    entry = lambda p: {"path": p, "length": 3}
    a = tmp_path / "ok" / "a"
    a.mkdir(parents=True)
    (a / "0.json").write_text(json.dumps([entry("/a/1"), entry("/a/2")]))
    (a / "1.json").write_text(json.dumps([entry("/a/3")]))
    read = lambda d: spark.read.format("paged_listing").option("pagesize", 2).load(str(tmp_path / d))
    assert sorted(r.path for r in read("ok").collect()) == ["/a/1", "/a/2", "/a/3"]
    for name, pages in {"twice": [["/a/1", "/a/2"], ["/a/2"]], "after": [["/a/1"], ["/a/2"]], "foreign": [["/b/1"]]}.items():
        d = tmp_path / name / "a"
        d.mkdir(parents=True)
        for k, page in enumerate(pages):
            (d / f"{k}.json").write_text(json.dumps([entry(p) for p in page]))
        with pytest.raises(PySparkException):
            read(name).collect()


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    """The event log in three files, in order."""
    events = fx.raw(spark, sf_dir, "events")
    for k in range(3):
        events.filter(F.floor(F.col("event_id") / 400) == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
    schema = events.schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events"), events, tmp_path


def run(stream, path, each, mode="append"):
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"file://{path}").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_write_fold_twin(spark, event_files):
    source, _, tmp = event_files
    pick = lambda df: df.select((F.col("user_id") % 3).alias("vol"), (F.col("event_id") % 41).alias("page"), F.col("event_id").alias("seq"), "event_type")
    table = VersionedTable(spark, f"file://{tmp}/fold")
    each = twins.fold_writes(table, ["vol", "page"], "seq")
    run(pick(source()), f"{tmp}/c1", each)
    batch = keyed.last_per_key(pick(event_files[1].filter("event_id < 1200")), ["vol", "page"], "seq", "event_type")
    assert sorted(map(tuple, table.read().select("vol", "page", "seq", "event_type").collect())) == sorted(map(tuple, batch.collect()))
    n = table.latest()
    each(pick(event_files[1].filter("event_id < 10")), 0)  # a batch run again changes nothing
    run(pick(source()), f"{tmp}/c1", each)  # a restart from the checkpoint neither
    assert table.latest() == n


def test_counts_twin(spark, event_files):
    source, events, tmp = event_files
    table = VersionedTable(spark, f"file://{tmp}/counts")
    run(source().select("event_type", F.lit(1).cast("long").alias("delta")), f"{tmp}/c2", twins.maintain_counts(table, ["event_type"]))
    want = {r.event_type: r["count"] for r in events.filter("event_id < 1200").groupBy("event_type").count().collect()}
    assert {r.event_type: r.n for r in table.read().collect()} == want


def test_state_changes_twin(spark, event_files):
    source, events, tmp = event_files
    pick = lambda df: df.select((F.col("user_id") % 4).alias("disk"), "event_id", "event_type")
    out = f"file://{tmp}/changes"
    run(twins.state_changes(pick(source()), "disk", "event_id", "event_type"), f"{tmp}/c3", lambda df, n: df.write.mode("append").parquet(out))
    want = journal.changes(pick(events.filter("event_id < 1200")), ["disk"], "event_id", ["event_type"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_receipts_twin(spark, event_files):
    source, events, tmp = event_files
    pick = lambda df: df.select(F.lit("j").alias("job"), (F.col("event_id") % 50).alias("oid"), F.col("ts").cast("timestamp").alias("ts"))
    out = f"file://{tmp}/receipts"
    run(twins.new_receipts(pick(source()), "ts", "60 days"), f"{tmp}/c4", lambda df, n: df.write.mode("append").parquet(out))
    found = [r.oid for r in spark.read.parquet(out).collect()]
    assert sorted(found) == list(range(50))
