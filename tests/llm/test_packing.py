import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from blockloom.llm.packing import best_fit_decreasing, pack

FILE = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, window):
    tokenizer = Tokenizer.from_file(FILE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(sequences), sum(r.length for r in rows)


def test_round_trip_and_fill(docs, corpus):
    texts = {i: t for i, t, *_ in corpus}
    n, total = check(pack(docs, FILE, window=256).collect(), texts, 256)
    assert n <= 1.05 * total / 256 + 2
    check(pack(docs, FILE, window=256, group_pieces=40).collect(), texts, 256)  # several groups


def test_best_fit_against_plain_search():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    rooms = []
    for n in lengths:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(64 - n)
    sequences, offsets = best_fit_decreasing(lengths, 64)
    left = defaultdict(lambda: 64)
    for s, o, n in zip(sequences, offsets, lengths, strict=True):
        assert o == 64 - left[s]
        left[s] -= n
    assert sorted(left.values()) == sorted(rooms)


def test_repeated_rows_and_empty(spark, no_docs):
    rows = pack(spark.createDataFrame([(1, "same words"), (1, "same words"), (None, None)], "doc_id long, text string"), FILE).collect()
    assert sorted((r.offset, r.length) for r in rows) == [(0, 3), (3, 3), (6, 1)]
    assert pack(no_docs, FILE).collect() == []


def test_added_tokens_in_any_case(spark):
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>", "x<|startOFtext|>y", "a <|startoftext|> B", "<|EndOfText|>. Next", "x<|endoftext|>y!", "<|endoftext|><|ENDOFTEXT|>", "A<B> | c"]
    check(pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), FILE).collect(), dict(enumerate(texts)), 2048)


def test_repeated_rows_spread_over_groups(spark):
    rows = [(1, "the same words again")] * 3000 + [(k, f"word {k}") for k in range(2, 40)]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), FILE, window=64, group_pieces=20).collect()
    assert len(found) == len(rows)
    groups, sequences = defaultdict(int), defaultdict(list)
    for r in found:
        groups[r.sequence_id >> 20] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert max(groups.values()) <= 200
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 64


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "some words", 1, 2, 3, 4)], "doc_id long, text string, id int, grp int, part int, `a.b` int")
    assert [r.length for r in pack(df, FILE).collect()] == [3]
