"""Toxicity by nearest labelled examples.

A bounded sample of labelled texts is indexed.  Terms are the words and word
beginnings of the whole sample; texts are TF-IDF vectors over them, in which a
term's inverse document frequency is multiplied by how much the classes of the
sample differ in it (supervised term weighting: the square of the phi
coefficient, never zero).  A text's nearest examples by exact cosine come from a
block-max inverted index: blocks of examples are visited in order of the largest
cosine they can hold, and the search ends when no block can beat the k-th best.
Similarity-weighted votes, corrected for the sampling of the classes and
calibrated on the sample with each example left out, give the score; the nearest
examples are its evidence.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import Scratch, quoted, text_slices

WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)
BLOCK = 64
SEVERAL = 4  # blocks that are visited at once


def terms_of(word: str) -> list[str]:
    """A lower-case word itself, marked by a final space, and its beginnings."""
    return [word + " ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Counter:
    """Counts the terms of texts, as sorted 64-bit hashes.  Words seen lately are remembered."""

    def __init__(self, remembered: int = 150_000):
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def learn(self, words: set[str]) -> None:
        missing = words.difference(self.known)
        if missing and len(self.known) + len(missing) > self.remembered:
            self.forget()
            missing = words
        if not missing:
            return
        terms = [terms_of(w) for w in missing]
        lengths = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
        flat = np.fromiter((xxhash.xxh3_64_intdigest(t) for some in terms for t in some), dtype=np.uint64, count=int(lengths.sum()))
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.lengths, self.flat = np.r_[self.lengths, lengths], np.r_[self.flat, self.translate(flat)]

    def translate(self, hashes: np.ndarray) -> np.ndarray:
        return hashes

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each text, terms ascending."""
        cut = [WORDS.findall(t.lower()) for t in texts]
        self.learn(set().union(*cut))
        get, out = self.known.__getitem__, []
        for words in cut:
            at, n = np.unique(np.fromiter(map(get, words), dtype=np.int64, count=len(words)), return_counts=True)
            terms, n = self.flat[spread(self.starts[at], self.lengths[at])], np.repeat(n, self.lengths[at])
            order = np.argsort(terms)
            terms, n = terms[order], n[order]
            first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, dtype=np.int64)
            out.append((terms[first], np.add.reduceat(n, first) if len(first) else n))
        return out


class KnownTerms(Counter):
    """The same for the terms of a vocabulary only, as positions in it.

    The vocabulary holds every beginning of each word in it, so a word whose
    longest beginning it lacks isn't looked up.  Beginnings are looked up once for
    all words that share them.
    """

    def __init__(self, vocabulary: np.ndarray, remembered: int = 150_000):
        self.vocabulary = vocabulary
        super().__init__(remembered)

    def forget(self) -> None:
        super().forget()
        self.flat = np.zeros(0, dtype=np.int64)
        self.begun: dict[str, int] = {}
        self.begun_at, self.begun_n, self.whole = np.zeros((0, len(BEGINNINGS)), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def translate(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def look_up(self, terms: list[str]) -> np.ndarray:
        return self.translate(np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64, count=len(terms)))

    def begin(self, longest: list[str]) -> None:
        """Remember the known beginnings of words that start in these ways, shorter ones first, and whether all are known."""
        at = np.full((len(longest), len(BEGINNINGS)), -1, dtype=np.int64)
        fits = np.ones(len(longest), dtype=bool)
        sizes = np.fromiter(map(len, longest), dtype=np.int64, count=len(longest))
        for k, n in enumerate(BEGINNINGS):
            some = np.flatnonzero(fits & (sizes >= n))
            starts = [longest[j][:n] for j in some.tolist()]
            names = {b: j for j, b in enumerate(dict.fromkeys(starts))}
            at[some, k] = self.look_up(list(names))[np.fromiter(map(names.__getitem__, starts), dtype=np.int64, count=len(starts))]
            fits[some] = at[some, k] >= 0
        self.begun.update(zip(longest, range(len(self.begun), len(self.begun) + len(longest)), strict=True))
        self.begun_at = np.concatenate([self.begun_at, at])
        self.begun_n, self.whole = np.r_[self.begun_n, (at >= 0).sum(axis=1)], np.r_[self.whole, fits]

    def learn(self, words: set[str]) -> None:
        missing = words.difference(self.known)
        if missing and len(self.known) + len(missing) > self.remembered:
            self.forget()
            missing = words
        if not missing:
            return
        missing = list(missing)
        longest = [w[: BEGINNINGS[-1]] for w in missing]
        if new := set(longest).difference(self.begun):
            self.begin(list(new))
        group = np.fromiter(map(self.begun.__getitem__, longest), dtype=np.int64, count=len(longest))
        own = np.full(len(missing), -1, dtype=np.int64)
        some = np.flatnonzero(self.whole[group])
        own[some] = self.look_up([missing[j] + " " for j in some.tolist()])
        found = np.concatenate([own[:, None], self.begun_at[group]], axis=1)
        lengths = (own >= 0) + self.begun_n[group]
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.lengths, self.flat = np.r_[self.lengths, lengths], np.r_[self.flat, found[found >= 0]]


class BlockMaxIndex:
    """Postings of each term by block of examples, with the term's largest weight in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        example = np.repeat(np.arange(self.n), [len(at) for at, _ in vectors])
        term = np.concatenate([at for at, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        block = self.example // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, dtype=np.int64)
        self.first, self.count = first, np.diff(np.r_[first, len(term)])  # postings of each entry (term, block)
        self.block = block[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entries = np.searchsorted(term[first], np.arange(n_terms + 1))  # entries of each term

    def search(self, at: np.ndarray, w: np.ndarray, k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, ties to the earlier example."""
        found, cosine = np.zeros(0, dtype=np.int64), np.zeros(0)
        counts = self.entries[at + 1] - self.entries[at]
        entry = spread(self.entries[at], counts)
        if not len(entry):
            return found, cosine
        factor, block = np.repeat(w, counts), self.block[entry]
        bound = np.bincount(block, factor * self.most[entry], self.blocks)
        waiting = np.argsort(-bound, kind="stable")
        waiting = waiting[bound[waiting] > 0]
        many = SEVERAL
        while len(waiting):
            if len(cosine) == k:
                waiting = waiting[bound[waiting] >= cosine[-1] - 1e-12]
            now, waiting = waiting[:many], waiting[many:]
            many *= 4
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[now] = True
            here = np.flatnonzero(chosen[block])
            n = self.count[entry[here]]
            posting = spread(self.first[entry[here]], n)
            score = np.bincount(self.example[posting], np.repeat(factor[here], n) * self.weight[posting], self.n)
            if leave_out >= 0:
                score[leave_out] = 0.0
            some = np.flatnonzero(score > (cosine[-1] - 1e-12 if len(cosine) == k else 0))
            found, cosine = np.r_[found, some], np.r_[cosine, score[some]]
            order = np.lexsort((found, -np.round(cosine, 12)))[:k]
            found, cosine = found[order], cosine[order]
        return found, cosine


def unit_vector(at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(n)) * weight[at]
    return at, w / (np.sqrt((w * w).sum()) or 1.0)


def term_weights(examples: list[np.ndarray], y: np.ndarray, n_terms: int) -> np.ndarray:
    """Inverse document frequency times the squared phi coefficient of term and class.

    Terms of few examples count for less, and none for nothing, so that texts
    without telling words have neighbours too.
    """
    n, m1 = len(examples), float(y.sum())
    m0 = n - m1
    b, a = (np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *(e for e, v in zip(examples, y, strict=True) if v == c)]), minlength=n_terms).astype(float) for c in (0, 1))
    df = a + b
    cross = a * (m0 - b) - b * (m1 - a)
    phi2 = cross * cross / np.maximum(m0 * m1 * df * np.maximum(n - df, 0.5), 1e-9)
    return (np.log((1 + n) / (1 + df)) + 1) * (phi2 * df / (df + 3) + 0.1 / n)


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve (Newton steps, lightly regularised towards slope 1, intercept 0)."""
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 0.05 * (theta - [1.0, 0.0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.1, float(theta[0])), float(theta[1])


def log_odds(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Model:
    """Examples, their vectors and what they vote for.  Built from a bounded sample, so its size does not depend on the corpus."""

    def __init__(self, ids: list, counts: list[tuple[np.ndarray, np.ndarray]], y: list[int], shares: tuple[float, float], k: int = 5):
        self.k, self.line = k, (1.0, 0.0)
        y = np.array(y, dtype=np.int64)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(t for t, _ in counts)]))
        places = [np.searchsorted(self.vocabulary, t).astype(np.int32) for t, _ in counts]
        self.weights = term_weights(places, y, len(self.vocabulary)) if len(y) else np.zeros(0)
        vectors = [unit_vector(at, n, self.weights) for at, (_, n) in zip(places, counts, strict=True)]
        strongest = [(int(at[np.argmax(w)]), float(-w.max())) if len(at) else (-1, 0.0) for at, w in vectors]
        order = sorted(range(len(vectors)), key=lambda j: strongest[j])  # like examples share blocks
        self.vectors = [vectors[j] for j in order]
        self.ids = [ids[j] for j in order]
        self.y = y[order].astype(float)
        self.weight = np.array(shares)[y[order]] if len(y) else np.zeros(0)  # what one example of its class stands for
        self.rate = float((self.weight * self.y).sum() / self.weight.sum()) if len(y) else 0.0

    @functools.cached_property
    def index(self) -> BlockMaxIndex:
        """Built where it is searched, once a worker process."""
        return BlockMaxIndex(self.vectors, len(self.vocabulary))

    @functools.cached_property
    def count(self) -> KnownTerms:
        return KnownTerms(self.vocabulary)

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * cosine * self.weight[found]
        prior = 0.1 * float(self.weight.mean())
        return float(((w * self.y[found]).sum() + prior * self.rate) / (w.sum() + prior))

    def left_out(self, j: int) -> float:
        """The votes for example ``j`` by the others."""
        return self.vote(*self.index.search(*self.vectors[j], self.k, j))

    def score(self, at: np.ndarray, n: np.ndarray) -> tuple[float, list, list[float]]:
        if not len(at):
            return self.rate, [], []
        found, cosine = self.index.search(*unit_vector(at, n, self.weights), self.k)
        x = self.line[0] * log_odds(self.vote(found, cosine)) + self.line[1]
        return float(1 / (1 + np.exp(-x))), [self.ids[j] for j in found[:3]], [float(c) for c in cosine[:3]]


def sample_labelled(docs: DataFrame, labels: DataFrame, every: dict[int, int], per_class: int, most_chars: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of at most ``per_class`` labelled rows of each class, those with the smallest hash of their id.

    Whole texts, in that order, as long as a class has no more than ``most_chars``
    characters.  ``every`` is how many labels a class has; a share of the hashes
    that holds several times the sample is ranked, so the ranking does not grow.
    """
    y = F.col(quoted(label_col)).cast("int")
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    chosen = (
        labels.select(F.col(quoted(id_col)).alias("id"), y.alias("y"))
        .filter("id is not null and y in (0, 1)")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .filter((F.xxhash64("id").cast("double") / 2.0**64 + 0.5) * F.when(F.col("y") == 1, every.get(1, 0)).otherwise(every.get(0, 0)) <= 4 * per_class + 100)
        .withColumn("k", F.row_number().over(order))
        .filter(F.col("k") <= per_class)
        .drop("k")
    )
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # at most 2 * per_class rows of two numbers
    found = found.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # an id of several rows counts once
    return found.withColumn("chars", F.sum(F.length("text")).over(order)).filter(F.col("chars") <= most_chars).drop("chars")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 300, most_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``per_class`` labelled rows and ``most_chars`` characters of each class.

    Labels other than 0 and 1 are left out; an id labelled both ways counts as
    1, and of several rows with one id the first text counts.  With labels of
    one class only, or none, every text gets the share of 1 among the labels.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    every = {r.y: r.n for r in labels.groupBy(F.col(quoted(label_col)).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).filter("y in (0, 1)").collect()}  # two rows
    sample = scratch.save(sample_labelled(docs, labels, every, per_class, most_chars, id_col, text_col, label_col), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            found = counter(batch.column("text").to_pylist())
            terms, n = ([c[k].astype(np.int64) for c in found] for k in (0, 1))
            columns = [batch.column("id"), batch.column("y"), pa.array(terms, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "terms", "n"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "y", "text").mapInArrow(count, f"id {kind}, y int, terms array<long>, n array<long>").toArrow()  # bounded: see above
    rows = sorted(
        zip(rows["id"].to_pylist(), rows["y"].to_pylist(), (np.asarray(x.values) for x in rows["terms"]), (np.asarray(x.values) for x in rows["n"]), strict=True), key=lambda r: (str(r[0]), r[1])
    )
    drawn = [sum(y == v for _, y, *_ in rows) for v in (0, 1)]
    shares = tuple(every.get(v, 0) / drawn[v] if drawn[v] else 1.0 for v in (0, 1))
    model = Model([r[0] for r in rows], [(t.view(np.uint64), n) for _, _, t, n in rows], [r[1] for r in rows], shares)
    if not rows:
        return model
    shared = spark.sparkContext.broadcast(model)

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([shared.value.left_out(j) for j in at], pa.float64())], ["j", "votes"])

    found = spark.range(len(rows)).repartition(max(1, len(rows) // 100)).mapInArrow(leave_out, "j long, votes double").collect()  # a number an example
    votes = np.array([r.votes for r in sorted(found)])
    model.line = fit_line(log_odds(votes), model.y, model.weight / model.weight.mean())
    shared.destroy()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, evidence_ids, evidence_cosines (the three nearest examples).

    A text that shares no term with any example, the empty and the null one among
    them, has no neighbours and gets the share of 1 among the labels.  Ties among
    examples go by their place in the index.  Repeated rows get equal results, an
    empty table an empty one; further columns of any name are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class and most_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[int, tuple] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in text_slices(texts):
                found = []
                for at, n in model.count(texts[start:end]):
                    name = xxhash.xxh3_128_intdigest(at.tobytes() + n.tobytes())
                    if name not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[name] = model.score(at, n)
                    found.append(known[name])
                columns = [batch.column("id").slice(start, end - start)]
                columns += [pa.array([f[0] for f in found], pa.float64()), pa.array([[str(i) for i in f[1]] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "score", "evidence_ids", "evidence_cosines"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, evidence_ids array<string>, evidence_cosines array<double>").withColumnRenamed("id", id_col)
