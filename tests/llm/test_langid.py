import random

from blockloom.llm import langid


def test_held_out_accuracy_and_unknown(spark, docs, corpus, make_text):
    rng = random.Random(11)
    taught = [(make_text(rng, lang, 150), lang) for lang in ("en", "de", "fr") for _ in range(120)]
    learned = langid.train_dictionaries(spark.createDataFrame([*taught, (None, "en"), ("text", None), ("", "xx")], "text string, lang string"))
    assert set(learned) == {"en", "de", "fr"} and all(len(d) <= 112 * 1024 for d in learned.values())
    rows = langid.identify(docs, learned, 0.0005).collect()
    assert len(rows) == len(corpus)
    found = {r.doc_id: r for r in rows}
    prose = [k for k in range(160) if k % 3 == 1 and len(corpus[k][1].split()) > 20]
    assert sum(found[k].lang_pred == corpus[k][2] for k in prose) >= 0.95 * len(prose)
    for k in (240, 241, 242, 243):
        assert found[k].lang_pred == "und" and found[k].lang_rejected and found[k].lang_score == 0.0
    assert all(0 <= r.lang_score <= 1 for r in rows)
    assert found[0].source == corpus[0][3] and found[0].id == "clash"  # other columns stay
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add((r.lang_pred, r.lang_score))
    assert all(len(v) == 1 for v in by_text.values())  # copies get equal results


def test_a_large_group_of_copies_takes_one_place(spark, make_text):
    rng = random.Random(5)
    texts = [make_text(rng, "en", 30) for _ in range(100)]
    frame = lambda rows: spark.createDataFrame([(t, "en") for t in rows], "text string, lang string")
    learned = langid.train_dictionaries(frame(texts), texts_per_lang=50)["en"].decode()
    chosen = [t for t in texts if langid.plain(t) in learned]
    assert len(chosen) == 50
    by_hash = frame(texts).selectExpr("text", "xxhash64(text) h").orderBy("h").first().text
    first = next(t for t in chosen if learned.startswith(langid.plain(t)))
    for copies in ([first] * 1000, [by_hash] * 1000, [f"{k} {first}!" for k in range(1000)]):
        assert langid.train_dictionaries(frame(texts + copies), texts_per_lang=50)["en"].decode() == learned


def test_nothing_learned_and_empty(docs, no_docs):
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.train_dictionaries(no_docs) == {}
    assert langid.identify(no_docs, {"en": b"the and"}).collect() == []


def test_smallest_encoding_wins():
    classify = langid.Classifier({"a": b" alpha beta gamma delta " * 50, "b": b" one two three four five " * 50})
    assert classify("gamma delta alpha", 0.0)[0] == "a"
    assert classify("three four one", 0.0)[0] == "b"
    assert classify("gamma", 1000.0)[3]  # narrow against the asked margin


def brute_sizes(dictionaries, text):
    """Each chunk by a fresh compressor per language, with nothing computed ahead."""
    import zstandard as z

    data, sizes = langid.plain(text).encode(), []
    for d in dictionaries.values():
        raw, total = z.ZstdCompressionDict(d + langid.MARK, dict_type=z.DICT_TYPE_RAWCONTENT), 0
        for at in range(0, len(data), 2048):
            params = z.ZstdCompressionParameters.from_level(langid.LEVEL, search_log=langid.SEARCH_LOG, dict_size=1 << 17, source_size=2048 + len(langid.MARK), write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(z.ZstdCompressor(compression_params=params, dict_data=raw).compress(langid.MARK + data[at : at + 2048]))
        sizes.append(total)
    return sizes


def test_against_brute_force(docs, corpus, make_text):
    rng = random.Random(3)
    learned = {lang: langid.plain(make_text(rng, lang, 3000)).encode() for lang in ("de", "en", "fr")}
    found = {r.doc_id: r for r in langid.identify(docs, learned, 0.01).collect()}
    for i, text, *_ in corpus[::5] + corpus[240:]:
        r = found[i]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True)
            continue
        sizes = brute_sizes(learned, text)
        low, second = sorted(sizes)[:2]
        assert r.lang_pred == list(learned)[sizes.index(low)]
        assert abs(r.lang_margin - (second - low) / low) < 1e-12 and r.lang_rejected == (r.lang_margin < 0.01)


def test_number_signs_are_no_letters_and_ties_go_by_name(spark):
    rows = [(1, "½ ² Ⅷ ①"), (2, "½ a"), (3, "日本"), (4, "日本")]
    learned = {"aa": b" same text ", "bb": b" same text "}
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()}
    assert found[1].lang_pred == "und" and found[1].lang_rejected
    assert {found[k].lang_pred for k in (2, 3, 4)} == {"aa"} and found[3].lang_margin == 0.0 and found[3].lang_rejected
    taught = langid.train_dictionaries(spark.createDataFrame([("½ ² ①", "xx"), ("Wort", "de")], "text string, lang string"))
    assert set(taught) == {"de"}


def test_passages_come_from_anywhere_and_too_many_labels_are_an_error(spark):
    import pytest

    texts = [f"{'start ' * 400}{'middle ' * 400}{'end ' * 400}{chr(97 + k) * 3}" for k in range(24)]
    learned = langid.train_dictionaries(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), chars_per_text=500)["en"]
    assert all(w in learned for w in (b"start", b"middle", b"end"))
    with pytest.raises(ValueError):
        langid.train_dictionaries(spark.createDataFrame([("word", f"l{k}") for k in range(9)], "text string, lang string"), most_langs=8)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "word", 2, 3)], "doc_id long, text string, `a.b` int, LANG_PRED int")
    found = langid.identify(df, {"en": b"the word"}, prefix="x.")
    assert found.columns == [*df.columns, "x.pred", "x.score", "x.margin", "x.rejected"] and found.first()["a.b"] == 2
