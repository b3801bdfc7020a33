import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import kneser_ney
from blockloom.llm.kneser_ney import discounts, score, train


def brute(rows, learned):
    texts = [[*(t or "").encode().lower().split(), b"<end>"] for _, t, *_ in rows]
    c, pairs = Counter(), Counter()
    for (i, *_), t in zip(rows, texts, strict=True):
        if learned(i):
            c.update(t)
            pairs.update(zip([b"<start>", *t[:-1]], t, strict=True))
    times, k, kinds = Counter(), Counter(w for _, w in pairs), defaultdict(lambda: [0, 0, 0])
    for (v, _), n in pairs.items():
        times[v] += n
        kinds[v][min(n, 3) - 1] += 1
    seen = lambda values: [sum(x == n for x in values) for n in (1, 2, 3, 4)]
    d, e = discounts(seen(pairs.values())), discounts(seen(k.values()))
    total, n, size = len(pairs), sum(c.values()), len(c)
    rest = sum(e[min(x, 3) - 1] for x in k.values()) / total if total else 1.0
    low = lambda w: ((k[w] - e[min(k[w], 3) - 1]) / total if k[w] else 0.0) + rest / (size + 1)

    def p(v, w):
        if not times[v]:
            return low(w)
        m = pairs[v, w]
        return (m - d[min(m, 3) - 1] if m else 0.0) / times[v] + np.dot(d, kinds[v]) / times[v] * low(w)

    out = []
    for t in texts:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (size + 1))) for w in t)
        out.append((len(t), sum(w in c for w in t), base, sum(math.log10(p(v, w)) for v, w in zip([b"<start>", *t[:-1]], t, strict=True))))
    return out, (p, c, n)


@pytest.mark.parametrize("pending", [1_500_000, 50])
def test_against_brute_force(docs, corpus, monkeypatch, pending):
    monkeypatch.setattr(kneser_ney, "PENDING", pending)
    model = train(docs, F.col("doc_id") % 3 != 0)
    want, (p, c, n) = brute(corpus, lambda i: i % 3 != 0)
    assert model["tokens"] == n
    rows = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(rows) == len(corpus)
    for (i, *_), (tokens, known, base, total) in zip(corpus, want, strict=True):
        r = rows[i]
        assert (r.n_tokens, r.n_known) == (tokens, known)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total)
        assert r.perplexity == pytest.approx(10 ** (-total / tokens))
    for v in (b"the", b"<start>", b"never seen"):  # a distribution: all words and the unseen one sum to one
        assert sum(p(v, w) for w in c) + p(v, b"unseen!") == pytest.approx(1.0)


def test_frequent_first_words_are_split(spark):
    rows = [(k, " ".join(f"hot w{(k * 7 + j) % 90}" for j in range(30))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = train(df, F.lit(True))
    assert model["frequent"] and len(model["split"]) >= 1
    want, _ = brute(rows, lambda i: True)
    found = {r.doc_id: r.score for r in score(df, model).collect()}
    assert [found[i] for i, _ in rows] == pytest.approx([w[3] for w in want])


def test_nothing_learned_and_empty(docs, no_docs):
    model = train(docs, F.lit(False))
    rows = score(docs, model).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(0.0) for r in rows)
    assert score(no_docs, train(no_docs, F.lit(True))).collect() == []
