import collections
import math
import random

import numpy as np
import pytest

from blockloom.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark, make_text):
    rng, rows, labels = random.Random(5), [], []
    for k in range(400):
        text = make_text(rng, rng.choice(["en", "de", "fr"]), rng.randint(10, 60)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vileword", "nasty", "zorkel" + rng.choice(["en", "a", "issimo"])]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    rows += [(400, None), (401, ""), (402, "1 2 3"), (402, "1 2 3")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out(labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels.filter("doc_id % 5 <> 0"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id < 400:
            assert (r.score >= 0.5) == bool(truth[r.doc_id])
        else:
            assert r.score < 0.5 and r.evidence_ids == []
        if r.score >= 0.5:
            assert r.evidence_ids and r.evidence_cosines == sorted(r.evidence_cosines, reverse=True)
            assert any(truth[int(i)] for i in r.evidence_ids)


def test_search_is_exact():
    rng, vectors = random.Random(9), []
    for _ in range(700):
        at = tuple(sorted(rng.sample(range(30), rng.randint(1, 6))))
        w = [rng.random() + 0.1 for _ in at]
        norm = sum(x * x for x in w) ** 0.5
        vectors.append((np.array(at), np.array([x / norm for x in w])))
    dense = np.zeros((700, 30))
    for k, (at, w) in enumerate(vectors):
        dense[k, at] = w
    index = toxicity.BlockMaxIndex(vectors, 30)
    for q in range(0, 700, 23):
        cosine = dense @ dense[q]
        cosine[q] = 0
        want = [k for k in np.lexsort((np.arange(700), -np.round(cosine, 12)))[:15] if cosine[k] > 0]
        found, score = index.search(*vectors[q], 15, q)
        assert found.tolist() == want and np.allclose(score, cosine[want])


def test_scores_against_brute_force(labelled):
    """Vectors, cosines, votes and scores by plain dictionaries."""
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels.filter("doc_id % 5 <> 0"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    terms = lambda t: collections.Counter(x for w in toxicity.WORDS.findall(t.lower()) for x in toxicity.terms_of(w))
    counts = {i: terms(texts[i]) for i in model.ids}
    n, m1 = len(counts), sum(truth[i] for i in counts)
    m0 = n - m1
    df = {v: collections.Counter(t for i, c in counts.items() if truth[i] == v for t in c) for v in (0, 1)}

    def weight(t):
        a, b = df[1][t], df[0][t]
        if not a + b:
            return 0.0
        phi2 = (a * (m0 - b) - b * (m1 - a)) ** 2 / (m0 * m1 * (a + b) * max(n - a - b, 0.5))
        return (math.log((1 + n) / (1 + a + b)) + 1) * (phi2 * (a + b) / (a + b + 3) + 0.1 / n)

    def vector(c):
        v = {t: (1 + math.log(k)) * weight(t) for t, k in c.items() if weight(t)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(c) for i, c in counts.items()}
    every = {v: sum(truth[i] == v for i in truth if i % 5) for v in (0, 1)}
    share = {v: every[v] / (m1 if v else m0) for v in (0, 1)}
    mean, rate = sum(share[truth[i]] for i in counts) / n, every[1] / (every[0] + every[1])
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i in range(0, 403, 9):
        q = vector(terms(texts[i]))
        cosines = sorted(((round(sum(x * v.get(t, 0.0) for t, x in q.items()), 12), j) for j, v in vectors.items()), reverse=True)[:5]
        w = [(c * c * share[truth[j]], truth[j]) for c, j in cosines if c > 0]
        if not q:
            assert found[i].score == pytest.approx(rate) and not found[i].evidence_ids
            continue
        votes = (sum(x * y for x, y in w) + 0.1 * mean * rate) / (sum(x for x, _ in w) + 0.1 * mean)
        odds = model.line[0] * math.log(votes / (1 - votes)) + model.line[1] if 1e-6 < votes < 1 - 1e-6 else None
        if odds is not None:
            assert found[i].score == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)
        assert found[i].evidence_cosines == pytest.approx([c for c, _ in cosines if c > 0][:3])


def test_a_small_separable_sample_and_evidence_for_all(spark):
    rows = [(k, f"{'awful' if k % 2 else 'kind'} words number {k}") for k in range(30)] + [(100, "awful thing"), (101, "kind thing"), (102, "number nine"), (103, "zzz qqq")]
    docs = spark.createDataFrame([*rows, (3, "awful words number 3"), (None, "awful")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (5, None), (7, 3)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert found[100].score > 0.5 > found[101].score and len({round(r.score, 6) for r in found.values()}) >= 3
    assert all(found[i].evidence_ids for i in (100, 101, 102)) and found[103].evidence_ids == []


def test_columns_of_any_name_long_texts_and_ties(spark):
    rows = [(k, "same text bad" if k % 2 else "same text good", 1, 2, 3) for k in range(20)] + [(50, "bad " * 200_000, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, y int, `a.b` int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, toxic int, id int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(found) == 21 and found[50].score > 0.5 and found[1].evidence_ids == found[3].evidence_ids and len(found[1].evidence_ids) == 3


def test_no_labels_and_empty(labelled, no_docs):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    one_class = toxicity.train(docs, labels.filter("toxic = 1"))
    assert {r.score >= 0.5 for r in toxicity.score(docs, one_class).collect()} == {True}
    assert toxicity.score(no_docs, model).collect() == []


def test_unknown_words_cost_no_lookup_of_their_own(monkeypatch):
    """Beginnings are hashed once for all words that share them, a word only if its longest beginning is known."""
    sample = ["banana bandit ba", "Bananas über überall"]
    vocabulary = np.unique(np.concatenate([t for t, _ in toxicity.Counter()(sample)]))
    texts = [" ".join(f"{start}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)) for start in ("bananx", "banana", "überal", "q", "ba")] + sample + ["", "ba b"]
    want = [[(vocabulary.searchsorted(t), c) for t, c in zip(*found, strict=True) if t in vocabulary] for found in toxicity.Counter()(texts)]
    hashed, digest = [], toxicity.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(toxicity.xxhash, "xxh3_64_intdigest", lambda t: hashed.append(t) or digest(t))
    known = toxicity.KnownTerms(vocabulary)
    assert [list(zip(at, n, strict=True)) for at, n in known(texts)] == want
    assert not [t for t in hashed if t.startswith("bananx") and len(t) > 6]
    assert len(hashed) < 1500  # five a word before
    for remembered in (1, 30):
        assert [list(zip(at, n, strict=True)) for at, n in toxicity.KnownTerms(vocabulary, remembered)(texts)] == want
