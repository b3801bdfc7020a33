"""The registered queries of the operators: columns, splits and what the contracts fix, on the smallest tables."""

from __future__ import annotations

import zlib

import pytest
import pyarrow.parquet as pq

from blockloom.llm import queries


@pytest.fixture(scope="module")
def texts(sf_dir):
    return {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def run(spark, sf_dir, name, columns):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(columns)] == columns
    return df.collect()


def test_langid(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op1_langid", ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (rest(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out and texts[r.doc_id]["lang"]]
    assert sum(r.lang_pred == texts[r.doc_id]["lang"] for r in held) >= 0.9 * len(held)


def test_toxicity(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op2_toxicity", ["doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines"])
    assert len(rows) == len(texts)
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_mixing(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op3_mix_sources", ["doc_id", "size", "source_size", "target", "taken"])
    assert len(rows) == len(texts) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - sum(r["size"] for r in rows)) <= 0.02 * sum(r["size"] for r in rows)


def test_dedup_and_links(spark, sf_dir, texts):
    exact = run(spark, sf_dir, "op4_exact_dedup", ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])
    near = run(spark, sf_dir, "op9_shingle_join", ["doc_id", "n_shingles", "component_id"])
    assert len(exact) == len(near) == len(texts)
    part = {r.doc_id: r.component_id for r in near}
    assert all(part[r.doc_id] == part[r.keep_id] for r in exact if (texts[r.doc_id]["text"] or "").split())


def test_pages(spark, sf_dir):
    rows = run(spark, sf_dir, "op5_html_extract", ["page_id", "url", "text", "n_chars"])
    assert len(rows) == pq.read_table(f"{sf_dir}/pages.parquet").num_rows and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_tokens_and_packing(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op6_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    assert len(rows) == len(texts) and all(r.n_bytes == len((texts[r.doc_id]["text"] or "").encode()) and r.over_limit == (r.n_tokens > 4096) for r in rows)
    pieces = run(spark, sf_dir, "op7_packing", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(total) == set(texts) and sum(r.length for r in pieces) == sum(total.values())


def test_nearest(spark, sf_dir):
    rows = run(spark, sf_dir, "op8_nearest", ["query_id", "rank", "vec_id", "score"])
    assert all(r.query_id % 50 == 0 and r.vec_id != r.query_id and 1 <= r["rank"] <= 5 for r in rows)


def test_language_model(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op10_lm_score", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    learned = sum(len((t["text"] or "").encode().split()) + 1 for i, t in texts.items() if rest(i, 10))
    assert len(rows) == len(texts) and {r.train_tokens for r in rows} == {learned}
    assert all(r.held_out == (rest(r.doc_id, 10) == 0) and r.n_tokens == len((texts[r.doc_id]["text"] or "").encode().split()) + 1 for r in rows)
