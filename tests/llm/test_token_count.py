import random

import public_tokenizers
import pytest
import sentencepiece

from blockloom.llm.token_count import TokenCounter, count_tokens, merge_together

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_against_library(docs, corpus, library):
    rows = {r.doc_id: r for r in count_tokens(docs, MODEL, limit=100).collect()}
    assert len(rows) == len(corpus)
    for i, t, *_ in corpus:
        n = len(library.encode(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 100)


def test_awkward_texts(library):
    rng = random.Random(1)
    texts = ["", " ", "   ", "a  b   c", "▁▁x", "\n\n\t", "<s></s><unk><0x41>", "a" * 5000, " " * 3000, "ab" * 700, "你好" * 50, "\x00\x01", "2024 12345", "ß" * 900]
    texts += ["".join(rng.choice("ab c\né1▁.你") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    assert TokenCounter(MODEL).count(texts) == [len(library.encode(t)) for t in texts]


def one_by_one(sequence, table):
    """Plain search: merge the best pair, leftmost first, until none is left."""
    s = list(sequence)
    while True:
        found = [(*table.pairs[key], i) for i in range(len(s) - 1) if (key := s[i] * table.size + s[i + 1]) in table.pairs]
        if not found:
            return len(s)
        _, made, i = min(found, key=lambda f: (f[0], f[2]))
        s[i : i + 2] = [made]


def test_rounds_equal_one_merge_at_a_time():
    table, rng = TokenCounter(MODEL).table, random.Random(2)
    for alphabet in ("abcdefghinorst▁", "ab", "aeinst", "0123456789", "-=_"):
        letters = [table.ids[c] for c in alphabet]
        sequences = [[rng.choice(letters) for _ in range(rng.randint(1, 60))] for _ in range(150)] + [[letters[0]] * n for n in range(1, 40)]
        assert merge_together(sequences, table).tolist() == [one_by_one(s, table) for s in sequences]


def test_long_sequences(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (399, 400, 5000, 30_000)] + ["ab" * 20_000, "=" * 30_000, "einst" * 3000]
    assert TokenCounter(MODEL).count(texts) == [len(library.encode(t)) for t in texts]


def test_repeated_rows_and_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "some words", 1, 2)] * 2 + [(None, None, 1, 2)], "doc_id long, text string, id int, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(df, MODEL).collect()) == [(0, 0, 0), (1, 10, 2), (1, 10, 2)]


def test_forgetting_changes_nothing(library):
    counter, texts = TokenCounter(MODEL, remembered=5), ["some words here", "other words there", "some words here"]
    assert [counter.count([t])[0] for t in texts] == [len(library.encode(t)) for t in texts]


def test_empty_table(no_docs):
    assert count_tokens(no_docs, MODEL).collect() == []
