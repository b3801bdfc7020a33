import importlib.util
import random
import re

import pytest
from pyspark.sql import functions as F

from blockloom.llm.common import Scratch, connected_components

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline

from .test_packing import check
from .test_shingle_join import shingles


def test_stages_on_a_fixture(spark, corpus, tmp_path):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == df.columns
            kept.append(sorted(r.doc_id for r in docs.collect()))
    text = {i: t for i, t, *_ in corpus}
    letters = {i for i, t in text.items() if t and re.search(r"[^\W\d_]", t)}
    assert set(kept[0]) <= letters and len(kept[0]) >= 0.97 * len(letters)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in text.items()}
    first = {}
    for i in kept[0]:
        first.setdefault(norm[i], i)
    assert kept[1] == sorted(first.values())
    sets = {i: shingles(text[i]) for i in kept[1]}
    alike = lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    for n, i in enumerate(kept[2]):
        assert not any(alike(i, j) for j in kept[2][:n])  # one of each group stays
    for i in set(kept[1]) - set(kept[2]):
        assert any(alike(i, j) for j in kept[1] if j != i)
    assert set(kept[3]) <= set(kept[2]) and all(kept[3].count(i) <= 3 for i in set(kept[3]))
    taken = kept[3]
    rows = docs.collect()
    assert sum(r.start == 0 for r in rows) == len(taken)
    once = [r for r in rows if taken.count(r.doc_id) == 1]
    assert {r.doc_id for r in rows} == set(taken)
    assert sum(r.length for r in rows if r.doc_id in {o.doc_id for o in once}) == sum({r.doc_id: r.doc_tokens for r in once}.values())
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == len(rows)


def test_columns_of_any_name_stay(spark, docs, corpus):
    text = {i: t for i, t, *_ in corpus}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, "")
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows and all(r.text == text[r.doc_id] and r.lang_pred == r.key == r.copies == "clash" for r in rows)
        none = stage(spark, docs.limit(0), "")
        assert none.columns == docs.columns and none.collect() == []


def test_names_inside_stages_and_dots(spark):
    df = spark.createDataFrame([(k, f"the words of text {k} are these and {k * k}", "en", "s", k) for k in range(9)], "doc_id long, text string, lang string, source string, row_key int")
    for name in ("row_id", "row_text", "row_copies", "row_copy", "kept_id", "key_text", "lang_pred", "a.b", "ID"):
        df = df.withColumn(name, F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, df, "")
        assert found.columns == df.columns
        assert all(r["a.b"] == "a.b" and r.row_copies == "row_copies" and r.row_key == r.doc_id for r in found.collect())
    assert corpus_pipeline.pack(spark, df, "").count() == 9


def test_repeated_and_null_ids(spark, make_text):
    rng = random.Random(4)
    base = [make_text(rng, "en", 40) for _ in range(6)]
    rows = [(1, base[0]), (1, base[1]), (2, base[0] + " more"), (None, base[2]), (None, base[3]), (3, base[2] + " more"), (None, base[4] + " tail"), (None, base[4]), (4, None), (None, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    found = sorted(((r.doc_id, r.text) for r in kept), key=str)
    assert (1, base[0]) in found and (1, base[1]) in found and (2, base[0] + " more") not in found
    assert (3, base[2] + " more") in found and (None, base[2]) not in found and (None, base[3]) in found
    assert sum(t is not None and t.startswith(base[4]) for _, t in found) == 1 and sum(not t for _, t in found) == 3
    mixed = corpus_pipeline.mix(spark, df, "").collect()  # one source: its target is its size
    assert abs(sum(len((r.text or "").split()) for r in mixed) - sum(len((t or "").split()) for _, t in rows)) <= 41
    many = spark.createDataFrame([(7, "some words here", "en", "a")] * 300 + [(k, "other words", "en", "b") for k in range(300)], df.schema)
    words = [len(r.text.split()) for r in corpus_pipeline.mix(spark, many, "").collect() if r.source == "a"]
    assert abs(sum(words) - 1500 * 5 / 7) <= 120


def test_packing_of_unique_documents(spark):
    rows = [(k, "some words " * k) for k in range(1, 30)]
    found = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    check(found, dict(rows), 2048)


@pytest.mark.parametrize("edges", [[], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(1, 2), (2, 1), (3, 3), (5, 4), (9, 4)]])
def test_connected_components(spark, edges):
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    low = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert found == low
