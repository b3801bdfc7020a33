"""Language identification by compression.

Each language has a raw-content zstandard dictionary: text of that language.  A
text is compressed in chunks with every dictionary; the language whose
dictionary gives the fewest bytes wins, and a narrow margin is a rejection.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import beside, quoted

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LEAST_MARGIN = 0.0005  # relative excess of the second smallest size below which two languages fit equally well

# Every dictionary ends with this mark and every chunk begins with it: it is one match in each language, which makes
# the block worth compressing, so that even a few words show what they match.
MARK = bytes(range(33, 65)) * 2
LEVEL, SEARCH_LOG = 12, 1  # a level that matches three letters; two candidates are looked at for each match


def plain(text: str) -> str:
    """Lower-case letters with single spaces between words: what is compressed."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def train_dictionaries(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    texts_per_lang: int = 96,
    chars_per_text: int = 2048,
    bytes_per_lang: int = 112 * 1024,
    most_langs: int = 256,
) -> dict[str, bytes]:
    """Dictionary text of each language of ``labelled`` (rows with a null text or label are left out).

    A bounded sample: for each language the ``texts_per_lang`` distinct texts
    with the smallest hash, of each a passage of ``chars_per_text`` characters
    (all, if it has fewer) that starts where the hash says, and of the passages,
    in order, those that fit into ``bytes_per_lang`` bytes.  Texts with the same
    words are copies and take one place, however many there are.  Only hashes
    are shuffled to choose the sample; copies are merged and the rank limit is
    applied before that.  More than ``most_langs`` labels are an error.
    """
    words = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " "))  # as in plain()
    hashed = (
        labelled.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text"))
        .filter("lang is not null and text rlike '\\\\p{L}'")
        .withColumn("h", F.xxhash64(words))
    )
    chosen = (
        hashed.groupBy("lang", "h")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .filter(F.col("k") <= texts_per_lang)
        .select("lang", "h", "k")
    )
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - chars_per_text + 1)) + 1
    sample = (
        hashed.join(F.broadcast(chosen), ["lang", "h"])  # at most texts_per_lang rows a language
        .groupBy("lang", "k")
        .agg(F.min(F.substring("text", start, F.lit(chars_per_text))).alias("text"))
        .limit((most_langs + 1) * texts_per_lang)
        .collect()
    )
    if len({r.lang for r in sample}) > most_langs:
        raise ValueError(f"more than {most_langs} languages: raise most_langs")
    texts: dict[str, list[str]] = {}
    for row in sorted(sample):
        found = texts.setdefault(row.lang, [])
        text = plain(row.text)
        if text not in found and sum(len(t.encode()) for t in [*found, text]) <= bytes_per_lang:
            found.append(text)
    return {lang: "".join(t).encode() for lang, t in sorted(texts.items())}


class Classifier:
    """Compresses a text, in chunks, with every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, chunk: int = 2048):
        self.langs = list(dictionaries)
        self.chunk = chunk
        self.engines = [self.engine(data, level) for data in dictionaries.values()]

    def engine(self, data: bytes, level: int):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(
            level, search_log=SEARCH_LOG, dict_size=1 << 17, source_size=self.chunk + len(MARK), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        raw = z.ZstdCompressionDict(data + MARK, dict_type=z.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=params)
        return z.ZstdCompressor(compression_params=params, dict_data=raw)

    def sizes(self, text: str) -> list[int]:
        data = plain(text).encode("utf-8", "replace")
        chunks = [MARK + data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        return [sum(len(e.compress(c)) for c in chunks) for e in self.engines]

    def __call__(self, text: str | None, least_margin: float) -> tuple[str, float, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        others = [s for k, s in enumerate(sizes) if k != best]
        score = 1 / (1 + sum(2.0 ** -min(1000, s - sizes[best]) for s in others))
        margin = (min(others) - sizes[best]) / sizes[best] if others else 1.0
        return self.langs[best], score, margin, margin < least_margin


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    least_margin: float = LEAST_MARGIN,
    text_col: str = "text",
    prefix: str = "lang_",
) -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_margin and lang_rejected (and all its own columns of other names).

    ``und`` with score 0, rejected, for a null text or one without letters, and
    for any text if nothing was learned.  Ties go to the language first by code
    point; their margin is 0.  ``lang_margin`` is the relative excess of the
    second smallest size; texts below ``least_margin`` are rejected.  Every row
    is classified by itself, so repeated rows get equal results; an empty table
    gives an empty result.  Texts are compressed whole, at one level.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)  # bounded: see train_dictionaries
    names = [f"{prefix}{x}" for x in ("pred", "score", "margin", "rejected")]
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]

    kept: list[Classifier] = []  # in a task: one

    def compute(texts: list[str | None]) -> list[tuple]:
        if not kept:
            kept.append(Classifier(shared.value))
        return [kept[0](t, least_margin) for t in texts]

    return beside(docs, own, F.col(quoted(text_col)), list(zip(names, ("string", "double", "double", "boolean"), strict=True)), compute)
