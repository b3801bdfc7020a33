"""Token counts of a byte-fallback BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens at places that no vocabulary piece spans, so
merging each alone gives the whole text's pieces.  The distinct pre-tokens of a
batch lie end to end in flat numpy arrays; each round finds every sequence's
best pair and merges it in all sequences at once, until none is left, however
long a sequence is.  What survives is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import quoted, text_slices

SPACE = "▁"  # the vocabulary's mark for a space
NORMAL = 1  # piece type in the model file
NEVER = np.iinfo(np.int64).max


class MergeTable:
    """Pairs of symbols whose concatenation is a piece, with the rank of that piece."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        ranks = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}  # equal scores, equal rank
        self.ids = {p: k for k, p in enumerate(scores)}
        self.size = len(self.ids)
        self.inner = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = (ranks[score], self.ids[piece])
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.keys = keys
        self.rank = np.array([self.pairs[k][0] for k in keys.tolist()], dtype=np.int64)
        self.made = np.array([self.pairs[k][1] for k in keys.tolist()], dtype=np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def parts(self, token: str) -> Iterator[str]:
        """Cut where no piece has the two characters in a row."""
        start = 0
        for i in range(1, len(token)):
            if token[i - 1 : i + 1] not in self.inner:
                yield token[start:i]
                start = i
        yield token[start:]


def merge_together(sequences: list[list[int]], table: MergeTable) -> np.ndarray:
    """Symbols left of each sequence.

    In a round every sequence merges its best pair wherever it stands, from left
    to right, up to the first place where the merged symbol makes a pair with a
    neighbour that is as good or better: one by one, that pair would come next.
    """
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    symbol = np.fromiter((x for s in sequences for x in s), dtype=np.int64, count=int(lengths.sum()))
    owner = np.repeat(np.arange(len(sequences)), lengths)
    left = lengths.copy()
    rank = np.full(len(symbol), NEVER)
    made = np.zeros(len(symbol), dtype=np.int64)
    if len(symbol) > 1:
        rank[:-1], made[:-1] = table.look_up(symbol[:-1], symbol[1:])
        rank[:-1][owner[:-1] != owner[1:]] = NEVER
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(rank, starts)
        live = best < NEVER
        if not live.all():  # finished sequences leave the arrays
            stay = np.repeat(live, np.diff(np.r_[starts, len(symbol)]))
            symbol, owner, rank, made = symbol[stay], owner[stay], rank[stay], made[stay]
            if not len(symbol):
                break
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = best[live]
        spans = np.diff(np.r_[starts, len(symbol)])
        hit = np.flatnonzero(rank == np.repeat(best, spans))
        run = np.flatnonzero(np.r_[True, np.diff(hit) > 1])  # of hits that overlap in a row, every second one
        hit = hit[(hit - np.repeat(hit[run], np.diff(np.r_[run, len(hit)]))) % 2 == 0]
        last = len(symbol) - 1
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, last)
        follows = np.r_[False, hit[1:] - hit[:-1] == 2]  # the symbol before was merged in this round too
        one_before = np.where(follows, made[np.maximum(hit - 2, 0)], symbol[before])
        better = np.where((hit > 0) & (owner[before] == owner[hit]), table.look_up(one_before, made[hit])[0], NEVER) <= rank[hit]
        better |= np.where((hit + 2 <= last) & (owner[after] == owner[hit]), table.look_up(made[hit], symbol[after])[0], NEVER) <= rank[hit]
        stops = np.cumsum(better) - better  # places before this one where merging stops
        first = np.flatnonzero(np.r_[True, owner[hit[1:]] != owner[hit[:-1]]])
        hit = hit[stops == np.repeat(stops[first], np.diff(np.r_[first, len(hit)]))]
        symbol[hit] = made[hit]
        np.subtract.at(left, owner[hit], 1)
        stay = np.ones(len(symbol), dtype=bool)
        stay[hit + 1] = False
        symbol, owner, rank, made = symbol[stay], owner[stay], rank[stay], made[stay]
        now = hit - np.arange(len(hit))  # where the merged symbols are now
        for at in (now, now - 1):
            at = at[at >= 0]
            inside = (at + 1 < len(symbol)) & (owner[np.minimum(at + 1, len(symbol) - 1)] == owner[at])
            rank[at[~inside]] = NEVER
            at = at[inside]
            rank[at], made[at] = table.look_up(symbol[at], symbol[at + 1])
    return left


class TokenCounter:
    """Counts tokens; remembers up to ``remembered`` pre-tokens of this worker."""

    def __init__(self, model_file: str, remembered: int = 400_000):
        self.table = MergeTable(model_file)
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def learn(self, tokens: Iterable[str]) -> None:
        tokens = list(tokens)
        if len(self.known) + len(tokens) > self.remembered:
            self.known.clear()
        ids, counts = self.table.ids, dict.fromkeys(tokens, 0)
        sequences, owners = [], []
        for token in counts:
            for part in self.table.parts(token):
                if len(part) == 1:
                    # a character outside the vocabulary falls back to its bytes
                    counts[token] += 1 if part in ids else len(part.encode("utf-8", "surrogatepass"))
                    continue
                sequences.append([ids[c] for c in part])
                owners.append(token)
        if sequences:
            for token, n in zip(owners, merge_together(sequences, self.table).tolist(), strict=True):
                counts[token] += n
        self.known.update(counts)

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pre_tokens(t) if t else [] for t in texts]
        missing = set().union(*cut).difference(self.known)
        if missing or len(self.known) > self.remembered:
            everything = set().union(*cut) if len(self.known) + len(missing) > self.remembered else missing
            self.learn(everything)
        get = self.known.__getitem__
        return [sum(map(get, tokens)) for tokens in cut]

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """The text after a leading space mark, each token a run of marks and what follows up to the next."""
        text = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in text:
            return re.findall(f"{SPACE}+[^{SPACE}]*", text)
        return [SPACE + t for t in text[1:].split(SPACE)]


_COUNTERS: dict[str, TokenCounter] = {}  # one per worker process and vocabulary


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit.

    Counts are those of the vocabulary's own library without added tokens;
    strings that look like special tokens are ordinary text.  A null text is
    empty: 0 bytes and 0 tokens.  Repeated rows give repeated results, an empty
    table an empty one; further columns of any name are ignored.
    ``model_file`` is a path that every worker can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault(model_file, None) or TokenCounter(model_file)
        _COUNTERS[model_file] = counter
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in text_slices(texts):
                part = texts[start:end]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, end - start),
                        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part], pa.int64()),
                        pa.array(counter.count(part), pa.int64()),
                    ],
                    ["id", "n_bytes", "n_tokens"],
                )

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    counted = rows.mapInArrow(run, f"id {ids}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
