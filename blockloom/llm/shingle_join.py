"""Near duplicates: components of documents linked by the Jaccard index of their word shingles.

Exact, in steps that each read or shuffle bounded pieces:

1. Tasks hash every text's shingles; sorted arrays of hashes are shuffled by
   shard, and each shard writes the shingles that were sent more than once,
   with how often, as sorted arrays in the shared folder.
2. Tasks read the texts again and look those numbers up.  A set with fewer
   shared shingles than any link needs is settled.  The others are written
   once each, with their prefix: so many of their rarest shingles that two
   linked sets must have one of them in common.
3. Sets that share a prefix shingle form coarse groups (connected components).
   Frequent shingles come last in the order of rarity, so a passage that many
   documents hold does not join them.
4. Each coarse group, cut into chunks of bounded size, is joined by signature
   trees (see signature_tree).  Chunks of one group meet again only where they
   share a prefix shingle of sets that are not connected yet.

No task gathers all that a frequent shingle or a large group has: what tasks send
for a shingle is added up, or reduced to its least set, before the shuffle.  Shards
go by the bytes of all texts, so a shard's task is as large for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import signature_tree
from blockloom.llm.arrays import by_shard, local_path, map_array, mix, shard_of, squeeze, unsqueeze, write_array
from blockloom.llm.common import Scratch, connected_components, quoted
from blockloom.llm.kneser_ney import MOST_MAPS, words_of

MOST_SHARDS = 30_000
SHARD_BYTES = 16_000_000  # of text: some three million shingles a shard, whatever the size of the input's partitions
PART_SHINGLES = 500_000
TASK_SHINGLES = 1_000_000  # that a task holds before it sends them
SENT_SHINGLES = 200_000  # about, in one batch
SLICE_BYTES = 1_000_000  # of text that a task has as Python objects
MOST_SEEN = 200_000  # sets that a task remembers to have sent
CHUNK_SETS = 4096
CHUNK_BYTES = 24_000_000
UNCOUNTED = (1 << 32) - 1


class Shingler:
    """Sorted distinct 64-bit hashes of each text's shingles."""

    def __init__(self, words: int, remembered: int = 400_000):
        self.words, self.remembered = words, remembered
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [words_of(t) for t in texts]
        missing = set().union(*cut).difference(self.known)
        if len(self.known) + len(missing) > self.remembered:
            self.known.clear()
            missing = set().union(*cut)
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
        get = self.known.__getitem__
        return [self.shingles(np.fromiter(map(get, t), dtype=np.uint64, count=len(t))) for t in cut]

    def shingles(self, word: np.ndarray) -> np.ndarray:
        if not len(word):
            return word
        n = min(self.words, len(word))
        count = len(word) - n + 1
        found = np.full(count, n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                found = mix(found * np.uint64(0x9E3779B97F4A7C15) + word[k : k + count])
        found.sort()
        return found[np.r_[True, found[1:] != found[:-1]]]


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_shared(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def count_shared(docs: DataFrame, scratch: Scratch, words: int, text_col: str) -> tuple[str, int]:
    """Write, for each shard, the shingles found more than once and how often.

    A task leaves out sets that it has just sent and adds up before it sends, so
    a shingle of all documents is one row for each million shingles or so.  A set
    that several tasks hold counts for each: its shingles are written though no
    other set may have them.  That makes it a candidate more, and no link less,
    as all that two sets share is written; the numbers give the order of rarity.
    What is sent for a shingle does not depend on the number of shards.
    """
    folder = local_path(scratch.path("shared"))
    texts = docs.select(F.col(quoted(text_col)).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards, part = min(MOST_SHARDS, max(4, -(-size // SHARD_BYTES))), PART_SHINGLES
    names = ["shard", "hashes", "numbers"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        seen: set[int] = set()
        sets: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            """Each shingle once, with the number of sets it is in."""
            flat = np.concatenate(sets)
            sets.clear()
            flat.sort()
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            n = np.diff(first, append=len(flat)).astype(np.uint16)
            flat = flat[first]
            del first
            shard = shard_of(flat, shards)
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            at = shard[starts]
            del shard
            ends = np.r_[starts[1:], len(flat)]
            rows = 1 + len(starts) * SENT_SHINGLES // len(flat)
            for k in range(0, len(starts), rows):
                some = list(zip(starts[k : k + rows].tolist(), ends[k : k + rows].tolist(), strict=True))
                sent = [squeeze(flat[x:y]) for x, y in some], [n[x:y].tobytes() for x, y in some]
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + rows], pa.int32()), *(pa.array(x, pa.binary()) for x in sent)], names)

        for batch in parts(batches, "text", SLICE_BYTES):
            for s in shingles(batch.column("text").to_pylist()):
                if len(s) and (key := set_key(s)) not in seen:
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(key)
                    sets.append(s)
                    size += len(s)
                    if size > TASK_SHINGLES or len(sets) == 65_535:
                        yield from out()
                        size = 0
        if sets:
            yield from out()

    def write(found: pa.Table) -> pa.Table:
        """Shingles whose numbers add up to more than one, taken up for one range of hashes after the other."""
        shard = found.column("shard")[0].as_py()
        rows = []
        for batch in found.to_batches():
            for hashes, numbers in zip(batch.column("hashes"), batch.column("numbers"), strict=True):
                rows.append((unsqueeze(hashes.as_buffer()), np.frombuffer(numbers.as_buffer(), dtype=np.uint16)))
        total = sum(len(r[0]) for r in rows)
        # the shard's hashes are spread evenly over its range
        cuts = [((shard << 32) // shards << 32) + ((1 << 64) // shards * k // (1 + total // part)) for k in range(1, 1 + total // part)]
        cuts = np.array(cuts, dtype=np.uint64)
        bounds = [np.r_[0, np.searchsorted(r[0], cuts), len(r[0])] for r in rows]
        shingles, sets = [], []
        for k in range(len(cuts) + 1):
            flat = np.concatenate([r[0][b[k] : b[k + 1]] for r, b in zip(rows, bounds, strict=True)])
            if not len(flat):
                continue
            n = np.concatenate([r[1][b[k] : b[k + 1]] for r, b in zip(rows, bounds, strict=True)]).astype(np.int64)
            order = np.argsort(flat)
            flat = flat[order]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            number = np.add.reduceat(n[order], first)
            shared = number > 1
            shingles.append(flat[first[shared]])
            sets.append(np.minimum(number[shared], UNCOUNTED).astype("<u4"))
        write_array(folder, f"shingles-{shard}", np.concatenate([np.zeros(0, dtype=np.uint64), *shingles]))
        write_array(folder, f"sets-{shard}", np.concatenate([np.zeros(0, dtype="<u4"), *sets]))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    sent = texts.mapInArrow(send, "shard int, hashes binary, numbers binary")
    there = sent.groupBy("shard").applyInArrow(write, "shard int").collect()  # one row a shard
    for k in set(range(shards)) - {r.shard for r in there}:
        write_array(folder, f"shingles-{k}", np.zeros(0, dtype=np.uint64))
        write_array(folder, f"sets-{k}", np.zeros(0, dtype="<u4"))
    return folder, shards


def candidate_sets(docs: DataFrame, folder: str, shards: int, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, members, prefix): members and prefix once a task for each set that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        written: set[int] = set()

        def look_up(flat: np.ndarray) -> np.ndarray:
            out = np.ones(len(flat), dtype=np.int64)
            order = np.argsort(flat)
            for k, at in by_shard(shard_of(flat[order], shards)):
                if k not in maps:
                    if len(maps) > MOST_MAPS:
                        maps.clear()
                    maps[k] = map_array(folder, f"shingles-{k}"), map_array(folder, f"sets-{k}")
                keys, n = maps[k]
                if len(keys):
                    at = order[at]
                    place = np.minimum(np.searchsorted(keys, flat[at]), len(keys) - 1)
                    out[at] = np.where(keys[place] == flat[at], n[place], 1)
            return out

        for batch in parts(batches, "text", SLICE_BYTES):
            sets = shingles(batch.column("text").to_pylist())
            numbers = look_up(np.concatenate(sets))
            key, members, prefix, at = [], [], [], 0
            for s in sets:
                n, number = len(s), numbers[at : at + len(s)]
                at += n
                key.append(set_key(s))
                member, front = None, None
                if n and key[-1] not in written and int((number > 1).sum()) >= least_shared(n, percent):
                    order = np.lexsort((s, number))[: n - least_shared(n, percent) + 1]
                    front = s[order[number[order] > 1]]
                    if len(front):
                        written.add(key[-1])
                        member, front = s.tobytes(), front.tobytes()
                    else:
                        front = None
                members.append(member)
                prefix.append(front)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(key, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(members, pa.binary()), pa.array(prefix, pa.binary())],
                ["id", "key", "n", "members", "prefix"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, key long, n long, members binary, prefix binary")


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut where a binary column reaches about ``most`` bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)) + 1
            yield batch.slice(start, end - start)
            start = min(end, len(ends))


def prefix_edges(candidates: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect the sets of every prefix shingle.

    Sets of one batch are connected with the least of them on the spot, and only
    that one is sent for the shingle, so a frequent shingle is a row a batch.
    """

    def least(flat: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles, the least key of each, and edges of the others to it."""
        order = np.lexsort((key, flat))
        flat, key = flat[order], key[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        low = np.repeat(key[starts], np.diff(np.r_[starts, len(flat)]))
        return flat[starts], key[starts], np.unique(np.stack([key, low], axis=1)[key != low], axis=0)

    names = ["shard", "hashes", "a", "b"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "prefix"):
            prefixes = [np.frombuffer(p, dtype=np.uint64) for p in batch.column("prefix").to_pylist()]
            key = np.repeat(np.array(batch.column("key").to_pylist(), dtype=np.int64), [len(p) for p in prefixes])
            flat, low, edges = least(np.concatenate(prefixes), key)
            rows = [(k, flat[at].tobytes(), low[at].tobytes(), b"") for k, at in by_shard(shard_of(flat, shards))]
            rows.append((-1, b"", edges[:, 0].tobytes(), edges[:, 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), *3 * [pa.binary()]), strict=True)], names)

    def longs(values: list[bytes]) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(x, dtype=np.int64) for x in values)])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[x], dtype=np.int64)) for x in ("a", "b")], ["a", "b"])

    def stars(found: pa.Table) -> pa.Table:
        flat = longs(found.column("hashes").to_pylist()).view(np.uint64)
        edges = least(flat, longs(found.column("a").to_pylist()))[2]
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    sent = scratch.save(candidates.select("key", "prefix").mapInArrow(send, "shard int, hashes binary, a binary, b binary"), "prefixes")
    there = sent.filter("shard < 0").select("a", "b").mapInArrow(unpack, "a long, b long")
    return there.union(sent.filter("shard >= 0").groupBy("shard").applyInArrow(stars, "a long, b long"))


def touched(rows: DataFrame) -> DataFrame:
    """(shingle, cid, low, high) of rows (cid, label, prefix): the chunks that each prefix shingle occurs in, and the range of labels there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "prefix"):
            prefixes = [np.frombuffer(p, dtype=np.int64) for p in batch.column("prefix").to_pylist()]
            n = [len(p) for p in prefixes]
            cid, label = (np.repeat(batch.column(x).to_numpy(zero_copy_only=False), n) for x in ("cid", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.concatenate(prefixes) if prefixes else [], cid, label)], ["shingle", "cid", "label"])

    found = rows.select("cid", "label", "prefix").mapInArrow(run, "shingle long, cid long, label long")
    return found.groupBy("shingle", "cid").agg(F.min("label").alias("low"), F.max("label").alias("high"))


def joined(rows: DataFrame, percent: int, across: bool = False) -> DataFrame:
    """Edges (a, b) that connect the linked sets of each ``task`` of rows (task, side, key, label, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def settle() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                sets = [np.frombuffer(r["members"], dtype=np.uint64) for r in held]
                key = np.array([r["key"] for r in held], dtype=np.int64)
                known = np.array([r["label"] for r in held], dtype=np.int64)
                side = np.array([r["side"] for r in held]) if across else None
                label = signature_tree.connect(sets, percent, known, side)
                order = np.lexsort((key, label))
                starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
                low = np.empty(len(key), dtype=np.int64)
                low[order] = np.repeat(key[order][starts], np.diff(np.r_[starts, len(key)]))
                new = key != low
                if new.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[new], pa.int64()), pa.array(low[new], pa.int64())], ["a", "b"])
            held.clear()

        for batch in parts(batches, "members"):
            for row in batch.to_pylist():
                if held and held[-1]["task"] != row["task"]:
                    yield from settle()
                held.append(row)
        yield from settle()

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def chunks_of(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """For each group of rows (key, bytes), the number of chunks that its sets fill."""
    return rows.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int").alias(name))


def similar_sets(candidates: DataFrame, shards: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the sets that are linked with others; candidates (key, n, members, prefix) may be there several times.

    Where a set goes is worked out on rows without its members, so a join shuffles
    them twice for any size of those tables: to where they belong, and to its tasks.
    """
    edges = scratch.save(prefix_edges(candidates, shards, scratch), "prefix-edges")
    coarse = connected_components(edges, scratch, "coarse").withColumnsRenamed({"node": "key", "component": "coarse"})
    sizes = candidates.groupBy("key").agg((8 * F.max("n")).alias("bytes"))
    grouped = scratch.save(sizes.join(coarse, "key"), "grouped")
    load = scratch.save(chunks_of(grouped, ["coarse"], "chunks"), "load")
    place = grouped.join(load, "coarse").select("key", "coarse", "chunks")
    rows = scratch.save(candidates.select("key", "members").join(place, "key").dropDuplicates(["key"]), "candidates")
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk")
    whole = rows.select(F.struct("coarse", chunk).alias("task"), F.lit(0).cast("long").alias("side"), "key", F.col("key").alias("label"), "members")
    links = scratch.save(joined(whole, percent), "links")
    known = scratch.save(connected_components(links, scratch, "fine"), "known")
    if load.filter("chunks > 1").isEmpty():
        return known
    # The sets of groups of several chunks, with their components so far.  A component is named by its least key.
    large = grouped.join(load.filter("chunks > 1").select("coarse"), "coarse", "left_semi")
    labels = scratch.save(labelled(large, known).select("coarse", "key", "bytes", "label"), "labels")

    def merged(edges: DataFrame, name: str) -> DataFrame:
        """The labels after linking the components of both ends of each edge."""
        ends = [labels.select(F.col("key").alias(x), F.col("label").alias(f"{x}_label")) for x in ("a", "b")]
        found = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        found = connected_components(found, scratch, f"{name}-merge").withColumnsRenamed({"node": "label", "component": "merged"})
        return scratch.save(labels.join(found, "label", "left").select("coarse", "key", "bytes", F.coalesce("merged", "label").alias("label")), f"{name}-labels")

    def unsettled(name: str) -> DataFrame:
        """Groups that hold several components."""
        ranges = labels.groupBy("coarse").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        return scratch.save(ranges.filter("low <> high").select("coarse"), name)

    # First one set for each component, in chunks of their own, until that links no more.  Each time's are among the last one's ...
    heads = rows.filter("chunks > 1")
    for k in range(8):
        apart = unsettled(f"apart-{k}")
        if apart.isEmpty():
            break
        at = labels.filter("key = label").join(apart, "coarse", "left_semi").select("coarse", "key", "bytes")
        part = F.pmod(F.xxhash64("key", F.lit(k)), F.col("parts")).cast("int").alias("chunk")
        at = at.join(chunks_of(at, ["coarse"], "parts"), "coarse").select("key", F.struct("coarse", part).alias("task"))
        heads = scratch.save(heads.select("key", "members").join(at, "key"), f"heads-{k}")
        scratch.drop(f"heads-{k - 1}")
        more = joined(heads.select("task", F.lit(0).cast("long").alias("side"), "key", F.col("key").alias("label"), "members"), percent)
        more = scratch.save(more, f"head-links-{k}")
        if more.isEmpty():
            break
        labels = merged(more, f"heads-{k}")
    apart = unsettled("apart")
    if not apart.isEmpty():
        # ... then those pairs of chunks that share a prefix shingle of sets of different components: no others can be linked
        at = labels.join(apart, "coarse", "left_semi")
        labels = merged(scratch.save(across_chunks(at, rows, candidates, percent, scratch), "across"), "across")
    settled = labels.select(F.col("key").alias("node"), F.col("label").alias("component"))
    return known.join(settled.select("node"), "node", "left_anti").unionByName(settled)


def across_chunks(at: DataFrame, rows: DataFrame, candidates: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between sets (coarse, key, bytes, label) of different components; rows have their members, candidates their prefixes."""
    at = at.join(chunks_of(at, ["coarse", "label"], "pieces"), ["coarse", "label"])
    total = at.groupBy("coarse").agg(F.ceil(F.sum("bytes") / CHUNK_BYTES + F.count(F.lit(1)) / CHUNK_SETS).cast("int").alias("all"))
    own = F.col("pieces") > 1  # a component of several chunks has them to itself; smaller ones share chunks
    at = at.join(total, "coarse").withColumn(
        "cid",
        F.when(own, F.xxhash64("coarse", "label", F.pmod(F.xxhash64("key"), F.col("pieces")))).otherwise(F.xxhash64("coarse", F.pmod(F.xxhash64("label"), F.col("all")))),
    )
    at = scratch.save(at.select("cid", (~own).alias("shared"), "key", "bytes", "label"), "places")
    prefixes = candidates.select("key", "prefix").join(at.select("key", "cid", "label"), "key").dropDuplicates(["key"])
    touches = scratch.save(touched(prefixes), "touched")
    useful = touches.groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high and n > 1")
    useful = scratch.save(touches.join(useful.select("shingle"), "shingle", "left_semi").select("shingle", "cid"), "useful")
    x, y = useful.alias("x"), useful.alias("y")
    pairs = x.join(y, F.col("x.shingle") == F.col("y.shingle")).filter("x.cid < y.cid").select(F.col("x.cid").alias("x"), F.col("y.cid").alias("y")).distinct()
    chunks = scratch.save(at.groupBy("cid").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")), "chunks")
    a, b = chunks.alias("a"), chunks.alias("b")
    pairs = pairs.join(a, F.col("x") == F.col("a.cid")).join(b, F.col("y") == F.col("b.cid")).filter(percent * F.greatest("a.low", "b.low") <= 100 * F.least("a.high", "b.high"))
    sides = pairs.select(F.struct("x", "y").alias("task"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("cid")), F.struct(F.lit(1).alias("side"), F.col("y").alias("cid")))).alias("s"))
    # similar sets side by side, where compression finds what they share
    at = scratch.save(rows.select("key", "members").join(at, "key").sortWithinPartitions("cid", "label"), "placed")
    crossed = at.join(sides.select("task", F.col("s.side").cast("long").alias("side"), F.col("s.cid").alias("cid")), "cid").select("task", "side", "key", "label", "members")
    # a shared chunk also meets itself: there every set is a side of its own
    alone = at.filter("shared").select(F.struct(F.col("cid").alias("x"), F.col("cid").alias("y")).alias("task"), F.col("key").alias("side"), "key", "label", "members")
    return joined(crossed.unionByName(alone), percent, across=True)


def labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``label``, the component of ``key`` as far as it is known."""
    known = known.withColumnsRenamed({"node": "key", "component": "label"})
    return rows.join(known, "key", "left").withColumn("label", F.coalesce("label", "key"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Words are lower-cased (A-Z); fewer than ``words`` of them are one shingle; a
    null text or one without words has none and is linked with nothing, so its
    component is itself.  Two documents are linked when the overlap of their
    sets is at least ``percent`` of the union; ``component_id`` is the smallest
    id that can be reached (null ids are never the smallest; a component of null
    ids alone has a null one).  Repeated rows share their component.  Sets and
    shingles are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession, "near")
    folder, shards = count_shared(docs, scratch, words, text_col)
    sets = scratch.save(candidate_sets(docs, folder, shards, words, percent, id_col, text_col), "sets")
    scratch.drop("shared")
    known = scratch.save(similar_sets(sets.filter("prefix is not null"), shards, percent, scratch), "components")
    lowest = sets.filter("n > 0").groupBy("key").agg(F.min("id").alias("low"))
    per_set = scratch.save(labelled(lowest, known), "lowest")
    best = per_set.groupBy("label").agg(F.min("low").alias("component_id"))
    of_key = scratch.save(per_set.join(best, "label").select("key", "component_id"), "result")
    some = sets.filter("n > 0").join(of_key, "key").select("id", "n", "component_id")
    none = sets.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).withColumnsRenamed({"id": id_col, "n": "n_shingles"})
