import hashlib
import re

from blockloom.llm.exact_dedup import exact_dedup, keep_first_copies


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    return groups


def test_against_brute_force(docs, corpus):
    groups = expected(corpus)
    rows = exact_dedup(docs).collect()
    assert len(rows) == len(corpus)
    text = {i: norm(t) for i, t, *_ in corpus}
    for r in rows:
        g = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_hot_group_goes_map_side_and_agrees(spark):
    rows = [(k, "same text") for k in range(900)] + [(k, f"text {k // 2}") for k in range(900, 1500)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), tracked=64, tracked_top=8).collect()
    assert len(found) == 1500 and sum(r.kept for r in found) == 1 + 300
    assert {(r.keep_id, r.group_size) for r in found if r.doc_id < 900} == {(0, 900)}


def test_repeated_rows_nulls_and_empty(spark, no_docs):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (3, "b"), (4, None), (5, "")] + [(9, "many")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup(df).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 4
    kept = keep_first_copies(df).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(False, 1, "a"), (False, 4, None), (False, 9, "many")]
    assert sum(r.doc_id is None for r in kept) == 1
    assert exact_dedup(no_docs).collect() == [] and keep_first_copies(no_docs).collect() == []
    unique = spark.createDataFrame([(3, "a b"), (1, "c"), (2, "a\tb"), (None, "c"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in keep_first_copies(unique).collect() if r.text) == [(0, "c"), (2, "a\tb")]


def test_names_that_clash_and_dots(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, 5), (2, "a  b", "y", 2, 6), (3, None, "z", 3, 7), (3, "c", "w", 4, 8)], "doc_id long, text string, `a.b` string, kept_id int, KEPT_SHA int")
    for rows, want in ((df, ["w", "x", "z"]), (df.filter("text is not null"), ["w", "x"])):
        found = keep_first_copies(rows)
        assert found.columns == df.columns and sorted(r["a.b"] for r in found.collect()) == want


def test_a_digest_that_is_not_among_the_winners_is_counted_map_side(spark):
    rows = [(k, "hot") for k in range(400)] + [(k, "warm") for k in range(400, 700)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tracked=8, tracked_top=1)
    assert sorted((r.keep_id, r.group_size) for r in found.filter("kept").collect()) == [(0, 400), (400, 300)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
