"""Packing token sequences into windows by best-fit decreasing.

Documents are tokenised and cut: full windows first, the rest is one piece.
Pieces are dealt at random, but repeatably, into groups of a bounded number;
each group packs its pieces, longest first, into the open window with the least
remaining capacity that holds them.  A segment tree over capacities, whose
leaves count the open windows with that capacity, finds it.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import Scratch, quoted, text_slices

GROUP_BITS, PART_BITS = 40, 20  # sequence_id: the group's number, its part, a count within that, from upper bits to lower


class OpenWindows:
    """Open windows by remaining capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)  # 1: a window with a capacity below this node is open
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest open window with at least that capacity."""
        node = self.leaves + least
        if not self.some[node]:
            while node > 1 and not (node % 2 == 0 and self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.stacks[capacity].pop()
        if not self.stacks[capacity]:
            while node and not (node < self.leaves and (self.some[2 * node] or self.some[2 * node + 1])):
                self.some[node] = 0
                node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of pieces given longest first."""
    open_windows, sequences, offsets, used = OpenWindows(window), [], [], 0
    for n in lengths:
        found = open_windows.take(n)
        if found is None:
            found, used = (window, used), used + 1
        capacity, sequence = found
        sequences.append(sequence)
        offsets.append(window - capacity)
        if capacity > n:
            open_windows.add(capacity - n, sequence)
    return sequences, offsets


def only_letters(word: str) -> bool:
    """Whether normalising and folding the word leaves a run of letters."""
    return word.isalpha() and (word.isascii() or (is_normalized("NFC", word) and word.lower().isalpha()))


class WordTokens:
    """Token ids of texts, a white-space separated word at a time.

    The vocabulary drops white space, never joins across it and folds case, so
    a lower-cased text's ids are its words' ids in order.  Only words that hold
    an added token in whatever case go to the library as they are, because it
    looks for those before it folds case.  Punctuation that ends
    a word after a letter is a word of its own to the vocabulary, so the ids of
    such a word are those of its two parts.  Words seen lately are remembered in
    two generations; the older one goes when the younger is full.
    """

    TAIL = re.compile(rb"(.*[a-z])([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)", re.DOTALL)

    def __init__(self, tokenizer_file: str, remembered: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.remembered = remembered
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Add words that the younger generation lacks."""
        again = words.intersection(self.old)
        self.young.update((w, self.old[w]) for w in again)
        tail = self.TAIL.fullmatch
        parts = [(w, *m.groups()) for w in words - again if (m := tail(w))]
        whole = (words - again).difference([w for w, _, _ in parts])
        whole.update(p for _, core, end in parts for p in (core, end) if p not in self.young)
        plain, other = [], []
        for w in whole:
            (plain if only_letters(t := w.decode()) else other).append(t)
        for start in range(0, len(plain), 20_000):
            # a run of letters is one word of the vocabulary, and its last token is marked as an end
            part = plain[start : start + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(part) + 1:
                other += part
                continue
            flat = ids.tobytes()
            self.young.update((w.encode(), flat[i:j]) for w, i, j in zip(part, cuts, cuts[1:], strict=False))
        for start in range(0, len(other), 20_000):
            part = other[start : start + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.young.update((w.encode(), np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(part, found, strict=True))
        self.young.update([(w, self.young[core] + self.young[end]) for w, core, end in parts])

    def words(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        low = data.lower()
        if self.added and self.added.search(low):
            return [w if self.added.search(w.lower()) else w.lower() for w in data.split()]
        return low.split()

    def encode(self, texts: list[str], last: int) -> list[np.ndarray]:
        words = [self.words(t) for t in texts]
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        self.learn(set().union(*words).difference(self.young))
        get, end = self.young.__getitem__, np.array([last], dtype="<u4").tobytes()
        return [np.frombuffer(b"".join(map(get, w)) + end, dtype="<u4") for w in words]


_TOKENS: dict[str, WordTokens] = {}


def cut_documents(docs: DataFrame, tokenizer_file: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens): full windows, then the rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _TOKENS.setdefault(tokenizer_file, None) or WordTokens(tokenizer_file)
        _TOKENS[tokenizer_file] = tokens
        gc.disable()  # the lists of words and pieces hold no cycles
        try:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for begin, end in text_slices(texts, 6_000_000):
                    row, start, length, crc, total = [], [], [], [], []
                    for k, ids in enumerate(tokens.encode(texts[begin:end], end_id), begin):
                        for at in range(0, len(ids), window):
                            piece = ids[at : at + window]
                            row.append(k)
                            start.append(at)
                            length.append(len(piece))
                            crc.append(zlib.crc32(piece))
                            total.append(len(ids))
                    columns = [batch.column("id").take(pa.array(row))]
                    columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            gc.enable()

    ids = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {ids}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_pieces: int = 50_000,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of a document, its end id included, lies in exactly one piece, and
    the pieces of a sequence lie without gaps from offset 0.  A null or empty
    text is its end id alone.  Repeated rows are packed each; ties go by id and
    start, so reruns agree.  Further columns of any name are ignored, and an
    empty table gives an empty result.  A group holds about ``group_pieces``
    pieces: groups are drawn by a piece's content, and one that repeated rows
    fill is dealt anew by row, so a task's memory does not depend on the input.
    Padding suffers only by one partly filled window or so a group.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.save(cut_documents(docs, tokenizer_file, window, end_id, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    kind = pieces.schema["id"].dataType.simpleString()
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(groups)).cast("long"))
    # a group several times as large as it should be holds repeated rows
    full = scratch.save(
        dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * group_pieces + 100).select("grp", F.ceil(F.col("n") / group_pieces).alias("parts")), "full"
    )
    if full.isEmpty():
        dealt = dealt.withColumn("part", F.lit(0).cast("long"))
    else:
        dealt = dealt.join(full, "grp", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "start", "rid"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        if max(sequence) >= 1 << PART_BITS or pdf["part"].iloc[0] >= 1 << (GROUP_BITS - PART_BITS):
            raise OverflowError("more sequences or parts in a group than their bits hold")
        pdf["sequence_id"] = pdf["grp"] * (1 << GROUP_BITS) + pdf["part"] * (1 << PART_BITS) + np.array(sequence, dtype=np.int64)
        pdf["offset"] = np.array(offset, dtype=np.int64)
        return pdf.drop(columns=["grp", "part", "rid"])

    return (
        dealt.groupBy("grp", "part")
        .applyInPandas(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        .withColumnRenamed("id", id_col)
    )
