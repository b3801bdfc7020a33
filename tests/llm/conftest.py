from __future__ import annotations

import random

import pytest

SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "de": "sch ein ich der und gen ung lich keit heit ver ge auf aus ach ber ster tz pf eu ei ö ä ü ß".split(),
    "fr": "le la é è eau oi ou que ment tion ai eux ch pa tre an on ier oir vi ç ré ê ir un de".split(),
}


COMMON = {"en": "the of and that with from this was".split(), "de": "der die und nicht mit von auch eine".split(), "fr": "les des et dans pour avec une est".split()}


def words(rng, lang, n):
    return [rng.choice(COMMON[lang]) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_text():
    return lambda rng, lang, n: " ".join(words(rng, lang, n))


@pytest.fixture(scope="session")
def corpus(make_text):
    """(doc_id, text, lang, source): prose, exact and near copies, nulls, empty, blank and very long texts."""
    rng = random.Random(7)
    rows = []
    for k in range(160):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, make_text(rng, lang, rng.randint(1, 120)), lang, rng.choice(["a", "b", "c", None, "hot", "hot", "hot"])))
    for k in range(160, 200):  # copies with other white space
        rows.append((k, rows[k % 7][1].replace(" ", "\n \t", 3) if k % 2 else rows[k % 7][1], rows[k % 7][2], "hot"))
    for k in range(200, 240):  # near copies
        w = rows[k % 5 + 20][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w), rows[k % 5 + 20][2], "a"))
    rows += [(240, None, None, None), (241, "", "en", "b"), (242, " \n\t ", "en", "b"), (243, "1234 !!!", None, "c"), (244, "Wort", "de", None)]
    rows.append((245, make_text(rng, "en", 6000), "en", "long"))
    rows.append((246, "x" * 3000, "en", "long"))
    rows.append((247, "Ä Ö €uro 你好 ▁mark <s> <|endoftext|> á", "de", "c"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    for name in ("id", "key", "n", "size", "score", "text_sha256", "rid", "lang_pred", "copies"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
