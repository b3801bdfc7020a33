"""A training corpus from raw documents, in five stages.

Every stage works on all that the one before kept; all but the last return the
columns of ``documents``, the last the pieces of packed sequences.  Columns of
any further name stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import exact_dedup, langid, mixing, packing, shingle_join
from blockloom.llm.common import Scratch, free_name, own_columns, table

ID, TEXT = "doc_id", "text"


def text_key() -> Column:
    """Tells rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(F.col(TEXT), F.lit("")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, null and empty texts among them, and those that two languages fit equally well.

    Repeated rows get equal decisions, an empty table gives an empty one.
    """
    prefix = "lang_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"x_{prefix}"
    found = langid.identify(docs, langid.train_dictionaries(docs), prefix=prefix)
    return found.filter(~F.col(f"{prefix}rejected")).select(*own_columns(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of equal texts; null texts are empty ones, of rows that repeat id and text one stays, an empty table stays empty."""
    return exact_dedup.keep_first_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id (null last), of each group of near copies.

    Documents without words, null texts among them, all stay.  Rows that share
    an id are decided by their own texts; rows that repeat id and text share the
    decision.  An empty table stays empty.
    """
    key, at = free_name(docs, "row_key"), free_name(docs, "key_text")
    named = docs.select(F.struct(F.col(ID).isNull().alias("missing"), F.col(ID).alias("id"), text_key().alias("text")).alias(key), TEXT)
    groups = shingle_join.near_duplicates(named, id_col=key)
    dropped = groups.filter(F.col(key) != F.col("component_id")).select(F.col(f"{key}.id").alias(key), F.col(f"{key}.text").alias(at)).distinct()
    return docs.join(dropped, docs[ID].eqNullSafe(F.col(key)) & (text_key() == F.col(at)), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as its source's target weight asks for.

    Documents without words, null texts among them, are left out.  Rows that share
    an id are told apart by their texts; rows that repeat id and text share the
    copies of all of them.  An empty table stays empty.
    """
    key, at, of, copy = (free_name(docs, x) for x in ("row_id", "row_text", "row_copies", "row_copy"))
    mixed = mixing.mix_sources(docs.select(ID, TEXT, "source", text_key().alias(at)), also=at)
    share = mixed.groupBy(F.col(ID).alias(key), at).agg((F.sum("copies") / F.count(F.lit(1))).alias(of)).filter(F.col(of) > 0)
    rows = docs.join(share.withColumnRenamed(at, f"{at}_"), docs[ID].eqNullSafe(F.col(key)) & (text_key() == F.col(f"{at}_")))
    # a whole number but for rows that repeat id and text: of those, as many as the fraction says have one copy more
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)
    rows = rows.withColumn(copy, (F.floor(of) + (drawn < F.col(of) - F.floor(of)).cast("long")).cast("int"))
    return rows.filter(F.col(copy) > 0).withColumn(of, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*own_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens.

    A null or empty text is its end token alone, repeated rows are packed each,
    an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None  # compression, set joins, iterations and tokenisers have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
