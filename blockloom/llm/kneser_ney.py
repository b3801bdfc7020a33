"""Interpolated modified Kneser-Ney bigram model.

Counting runs in Spark: tasks count words, then word pairs, in sorted arrays,
which are shuffled by shard and added up.  Every shard becomes sorted arrays in
the shared folder; scoring workers map them into memory and look up the distinct
pairs of a batch at once, so a worker's own memory does not depend on the model.

    p(w|v)  = max(c(vw) - D(c), 0) / c(v) + gamma(v) p(w)
    p(w)    = max(k(w) - E(k), 0) / K + gamma / (V + 1)

where k(w) is the number of different words before w, K the sum of all k(w), V
the number of different tokens, and the discounts D, E for counts 1, 2 and 3 or
more come from the numbers of pairs (words) with counts 1 to 4.  The uniform
share is over the V tokens and one for all unseen words.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrays import by_shard, local_path, map_array, mix, shard_of, squeeze, tally, unsqueeze, write_array
from blockloom.llm.common import Scratch, quoted, text_slices

END = b" end"  # no word holds a space
UNSEEN = (1 << 32) - 1
START = (1 << 32) - 2
MOST_SHARDS = 30_000
MOST_MAPS = 10_000  # arrays that a worker keeps mapped
PENDING = 1_500_000  # tokens that a task gathers before it sends their pairs


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def discounts(n: list[int]) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more, from the numbers of things seen 1 to 4 times; 0.5, 1, 1.5 where those are too few."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.01), k - 0.01) for k, d in enumerate(found, 1)]


def seen_times(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


class Vocabulary:
    """Word ids: positions in the sorted hashes of all words, over all shards."""

    def __init__(self, folder: str, sizes: list[int], remembered: int = 400_000):
        self.folder, self.shards, self.remembered = folder, len(sizes), remembered
        self.first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.known: dict[bytes, int] = {}
        self.maps: dict[str, np.ndarray] = {}

    def part(self, kind: str, shard: int) -> np.ndarray:
        name = f"{kind}-{shard}"
        if name not in self.maps:
            if len(self.maps) > MOST_MAPS:
                self.maps.clear()
            self.maps[name] = map_array(self.folder, name)
        return self.maps[name]

    def learn(self, words: list[bytes]) -> None:
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
        found = np.full(len(words), UNSEEN, dtype=np.int64)
        order = np.argsort(hashes)
        for shard, at in by_shard(shard_of(hashes[order], self.shards)):
            if self.first[shard] == self.first[shard + 1]:
                continue
            at = order[at]
            keys = self.part("words", shard)
            place = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            found[at] = np.where(keys[place] == hashes[at], self.first[shard] + place, UNSEEN)
        self.known.update(zip(words, found.tolist(), strict=True))

    def ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of each text's words, its end included."""
        every = set().union(*texts)
        every.add(END)
        missing = every.difference(self.known)
        if len(self.known) + len(missing) > self.remembered:
            self.known.clear()
            missing = every
        if missing:
            self.learn(list(missing))
        get, end = self.known.__getitem__, self.known[END]
        return [np.fromiter((*map(get, t), end), dtype=np.uint64, count=len(t) + 1) for t in texts]

    def values(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Per-word values of sorted ids; 0 for words not seen."""
        out = np.zeros(len(ids), dtype=np.int64)
        shard = np.searchsorted(self.first, ids.astype(np.int64), side="right") - 1
        for k, at in by_shard(np.where(ids == UNSEEN, -1, shard)):
            if k >= 0:
                out[at] = self.part(kind, k)[ids[at].astype(np.int64) - self.first[k]]
        return out


def pairs_of(ids: list[np.ndarray]) -> np.ndarray:
    """(word before, word) of every token as one number each; the start of a text comes before its first."""
    flat = np.concatenate(ids)
    before = np.r_[np.uint64(START), flat[:-1]]
    before[np.cumsum([0, *map(len, ids[:-1])])] = START
    return before << np.uint64(32) | flat


class PairShards:
    """Shard of a pair: by its first word, so that one shard sees all pairs of a word; frequent first words are split by pair."""

    def __init__(self, shards: int, frequent: list[int]):
        self.shards = shards
        self.frequent = np.array(sorted([*frequent, START]), dtype=np.uint64)

    def split(self, before: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.frequent, before), len(self.frequent) - 1)
        return self.frequent[at] == before

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        before = pairs >> np.uint64(32)
        return shard_of(mix(np.where(self.split(before), pairs, before)), self.shards)


def payload(shards: list[int], keys: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["shard", "keys", "counts"])


def sharded(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys and their counts for each shard."""
    for k, at in by_shard(shard):
        yield payload([k], [squeeze(keys[at])], [counts[at].astype("<u4").tobytes()])


def added_up(found: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([unsqueeze(k) for k in found.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, dtype="<u4") for c in found.column("counts").to_pylist()])
    return found.column("shard")[0].as_py(), *tally(keys, counts)


def train(docs: DataFrame, learn_from: Column, text_col: str = "text") -> dict:
    """Count the rows of ``docs`` for which ``learn_from`` is true; returns the model's description.

    The number of shards follows the number of input partitions, up to a bound.  What comes to
    the driver is a few numbers a shard and at most four words a shard that are
    frequent enough to split.  A null text has its end as only token; without
    any row, or with empty tables, the model gives every token the uniform share.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    folder = local_path(scratch.path("model"))
    texts = docs.filter(learn_from).select(F.col(quoted(text_col)).alias("text"))
    shards = min(MOST_SHARDS, max(4, 4 * texts.rdd.getNumPartitions()))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), dtype=np.uint64, count=len(seen))
            keys, counts = tally(hashes, np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
            seen.clear()
            yield from sharded(keys, counts, shard_of(keys, shards))

        for batch in batches:
            seen[END] += batch.num_rows
            for text in batch.column("text"):
                seen.update(words_of(text.as_py()))
                if len(seen) > 400_000:
                    yield from out()
        if seen:
            yield from out()
        pa.default_memory_pool().release_unused()

    def write_words(found: pa.Table) -> pa.Table:
        shard, keys, counts = added_up(found)
        write_array(folder, f"words-{shard}", keys)
        write_array(folder, f"counts-{shard}", counts)
        top = np.argsort(-counts, kind="stable")[:4]
        ends = int(counts[keys == np.uint64(xxhash.xxh3_64_intdigest(END))].sum())  # a text has one end
        return pa.table({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())], "ends": [ends], "top": [top.tolist()], "top_n": [counts[top].tolist()]})

    sent = "shard int, keys binary, counts binary"
    rows = texts.mapInArrow(count_words, sent).groupBy("shard").applyInArrow(
        write_words, "shard long, n long, total long, ends long, top array<long>, top_n array<long>"
    ).collect()  # one row a shard
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] = r.n
    total, first = sum(r.total for r in rows), np.r_[0, np.cumsum(sizes)]
    if first[-1] >= START:
        raise OverflowError("more different words than 32-bit ids")
    often = total // (2 * shards)
    frequent = [int(first[r.shard]) + k for r in rows for k, n in zip(r.top, r.top_n, strict=True) if n > often]
    place = PairShards(shards, frequent)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(folder, sizes)
        pending: list[np.ndarray] = []
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = tally(np.concatenate(pending))
            pending.clear()
            yield from sharded(keys, counts, place(keys))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in text_slices([t or "" for t in texts]):
                pending.append(pairs_of(words.ids([words_of(t) for t in texts[start:end]])))
                waiting += len(pending[-1])
                if waiting > PENDING:
                    yield from out()
                    waiting = 0
        if pending:
            yield from out()
        pa.default_memory_pool().release_unused()

    def write_pairs(found: pa.Table) -> pa.Table:
        shard, keys, counts = added_up(found)
        write_array(folder, f"pairs-{shard}", keys)
        write_array(folder, f"paircounts-{shard}", counts.astype("<u4"))
        before = keys >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        kinds = np.stack([np.add.reduceat((counts == 1).astype(np.int64), starts), np.add.reduceat((counts == 2).astype(np.int64), starts), np.add.reduceat((counts > 2).astype(np.int64), starts)], axis=1)
        firsts = before[starts]
        write_array(folder, f"firsts-{shard}", firsts.astype("<u4"))
        write_array(folder, f"kinds-{shard}", kinds.astype("<u4"))
        part = place.split(firsts)
        after, n = tally(keys & np.uint64(0xFFFFFFFF))
        out = {"kind": [], "shard": [], "keys": [], "counts": [], "numbers": []}

        def add(kind: int, shard: int, keys: bytes, counts: bytes, numbers: list[int]) -> None:
            for name, x in zip(out, (kind, shard, keys, counts, numbers), strict=True):
                out[name].append(x)

        add(0, shard, b"", b"", [len(keys), *seen_times(counts)])
        for v, k in zip(firsts[part].tolist(), kinds[part].tolist(), strict=True):
            add(1, shard, b"", b"", [v, *k])
        for k, at in by_shard(np.searchsorted(first, after.astype(np.int64), side="right") - 1):
            add(2, k, squeeze(after[at]), n[at].astype("<u4").tobytes(), [])
        return pa.table(out, schema=pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("numbers", pa.list_(pa.int64()))]))

    counted = scratch.save(
        texts.mapInArrow(count_pairs, sent).groupBy("shard").applyInArrow(write_pairs, "kind int, shard int, keys binary, counts binary, numbers array<long>"),
        "counted",
    )
    pair_rows = counted.filter("kind = 0").select("shard", "numbers").collect()  # one row a shard
    split: dict[int, list[int]] = {}
    for r in counted.filter("kind = 1").select("numbers").collect():  # at most the split words a shard
        v, *k = r.numbers
        split[v] = [a + b for a, b in zip(split.get(v, [0, 0, 0]), k, strict=True)]

    def write_before(found: pa.Table) -> pa.Table:
        """k(w) of a shard's words: for how many different words each is the next."""
        shard, keys, counts = added_up(found)
        dense = np.zeros(sizes[shard], dtype=np.int64)
        dense[keys.astype(np.int64) - int(first[shard])] = counts
        write_array(folder, f"befores-{shard}", dense.astype("<u4"))
        return pa.table({"numbers": [[*seen_times(dense), int((dense > 2).sum()), int(dense.sum())]]})

    befores = counted.filter("kind = 2").select("shard", "keys", "counts").groupBy("shard").applyInArrow(write_before, "numbers array<long>").collect()
    scratch.drop("counted")
    sum_up = lambda rows, n: [sum(r[k] for r in rows) for k in range(n)]
    n_pairs = sum_up([r.numbers for r in pair_rows], 5)
    n_before = sum_up([r.numbers for r in befores], 6)
    lower = discounts(n_before[:4])
    return {
        "folder": folder,
        "sizes": sizes,
        "shards": shards,
        "frequent": frequent,
        "split": split,
        "pair_shards": sorted(r.shard for r in pair_rows),
        "tokens": total,
        "kinds": int(first[-1]),
        "texts": sum(r.ends for r in rows),
        "upper": discounts(n_pairs[1:]),
        "lower": lower,
        "befores": n_before[5],
        "rest": (lower[0] * n_before[0] + lower[1] * n_before[1] + lower[2] * n_before[4]) / n_before[5] if n_before[5] else 1.0,
    }


class Scorer:
    def __init__(self, model: dict):
        self.m = model
        self.words = Vocabulary(model["folder"], model["sizes"])
        self.place = PairShards(model["shards"], model["frequent"])
        self.has = set(model["pair_shards"])

    def pair_values(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """c(vw), and what the discounts of all pairs with v sum to, of sorted pairs."""
        m, upper = self.m, np.array(self.m["upper"])
        count, given = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs))
        before = pairs >> np.uint64(32)
        for shard, at in by_shard(np.where(before == UNSEEN, -1, self.place(pairs))):
            if shard not in self.has:
                continue
            keys, n = self.words.part("pairs", shard), self.words.part("paircounts", shard)
            place = np.minimum(np.searchsorted(keys, pairs[at]), len(keys) - 1)
            count[at] = np.where(keys[place] == pairs[at], n[place], 0)
            firsts = self.words.part("firsts", shard)
            v = before[at]
            place = np.minimum(np.searchsorted(firsts, v.astype(np.uint32)), len(firsts) - 1)
            given[at] = np.where(firsts[place] == v, self.words.part("kinds", shard)[place] @ upper, 0.0)
        often = np.flatnonzero(self.place.split(before))
        for v in np.unique(before[often]).tolist():
            given[often[before[often] == v]] = np.dot(m["split"].get(v, [0, 0, 0]), upper)
        return count, given

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text, scores in log10."""
        m = self.m
        ids = self.words.ids([words_of(t) for t in texts])
        pairs = pairs_of(ids)
        distinct, back = np.unique(pairs, return_inverse=True)
        before, after = distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF)
        word, at = np.unique(after, return_inverse=True)
        c, k = self.words.values("counts", word), self.words.values("befores", word)
        base = np.log10((c + 0.1) / (m["tokens"] + 0.1 * (m["kinds"] + 1)))
        off = np.array([0.0, *m["lower"]])[np.minimum(k, 3)]
        low = np.maximum(k - off, 0) / max(m["befores"], 1) + m["rest"] / (m["kinds"] + 1)
        first, to = np.unique(before, return_inverse=True)
        times = self.words.values("counts", np.where(first == START, UNSEEN, first))
        times[first == START] = m["texts"]
        times = times[to]
        count, given = self.pair_values(distinct)
        off = np.array([0.0, *m["upper"]])[np.minimum(count, 3)]
        safe = np.maximum(times, 1)
        p = np.where(times > 0, np.maximum(count - off, 0) / safe + given / safe * low[at], low[at])
        score, base, known = np.log10(p)[back], base[at][back], (c > 0)[at][back]
        starts = np.cumsum([0, *map(len, ids[:-1])])
        return list(zip(map(len, ids), np.add.reduceat(known.astype(np.int64), starts).tolist(), np.add.reduceat(base, starts).tolist(), np.add.reduceat(score, starts).tolist(), strict=True))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score, perplexity.

    ``score`` is the log10 probability of the text's words and its end,
    ``base_score`` that of an additively smoothed word count model.  A null or
    empty text is its end alone.  Repeated rows get equal results.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(json.dumps(model))  # a few numbers a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = json.loads(shared.value)
        model["split"] = {int(k): v for k, v in model["split"].items()}
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in text_slices([t or "" for t in texts]):
                n, known, base, total = zip(*scorer(texts[start:end]), strict=True)
                columns = [batch.column("id").slice(start, end - start), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_col)
