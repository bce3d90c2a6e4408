"""Corpus preparation: toxicity, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All
but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import language, toxicity
from docsift.llm.common import bounded_batches, fold, load, save_table
from docsift.llm.neardup import near_duplicates
from docsift.llm.packing import pack
from docsift.llm.repeats import remove_repeats
from docsift.shipping import ship_package

#: Words of the shortest passage that the substring stage removes.
PASSAGE_WORDS = 50


def _begin(spark: SparkSession) -> None:
    ship_package(spark)
    bounded_batches(spark)


def _set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names, which a stage uses itself, under other names, and
    the names to give back."""
    away = {}
    for c in docs.columns:
        if c.lower() in names:
            away[c] = c + "_"
            while away[c].lower() in {x.lower() for x in docs.columns}:
                away[c] += "_"
    return docs.withColumnsRenamed(away), {new: old for old, new in away.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model marks go; it learns from the labels of the others' folds.
    Every row is judged by its own text, also without a doc_id or when others share it.  A null
    or empty text has the model's bias as its score; an empty table gives no rows, and columns of
    any name pass unread."""
    _begin(spark)
    model = toxicity.train(docs, toxicity.known_labels(load(spark, sf_dir, "labels")))
    return toxicity.drop_predicted(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go: no letters, or a score that hardly any
    rightly predicted text has.  Every row is judged by its own text, whatever its doc_id.  A null
    or empty text goes; an empty table gives no rows, and columns of any name pass unread."""
    _begin(spark)
    model = language.train(docs.where(fold(F.col("doc_id")) != 2))
    return language.drop_rejected(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) the smallest doc_id stays.

    Texts are grouped, not ids: of an id that several texts share, each text is judged for
    itself, and those of a group's smallest id all stay.  Rows without a doc_id stay and let
    no other go; so do texts without words.  An empty table gives no rows; columns of any name,
    also of those used here, pass unchanged."""
    _begin(spark)
    docs, own = _set_aside(docs, "g_id", "k_id", "k_text")
    text = F.coalesce("text", F.lit(""))
    several = (docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
               .agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b")).where(F.col("a") != F.col("b")))
    if several.isEmpty():  # an id is a text
        gone = near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("g_id")).distinct()
        return docs.join(gone, F.col("doc_id") == F.col("g_id"), "left_anti").withColumnsRenamed(own)
    # a number for each (id, text), ascending with the id
    digest = F.sha2(text, 256)
    each = (docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k_id"), digest.alias("k_text"))
            .agg(F.any_value("text").alias("text")).repartitionByRange("k_id", "k_text").sortWithinPartitions("k_id", "k_text"))
    numbered = save_table(each.withColumn("doc_id", F.monotonically_increasing_id()), "stage-numbered")
    keys = numbered.select("k_id", "k_text", F.col("doc_id").alias("k_number"))
    found = near_duplicates(numbered, shingle=5, percent=80).where(~F.col("kept")).select("doc_id", "component_id")
    lowest = numbered.select(F.col("doc_id").alias("l_number"), F.col("k_id").alias("l_id"))
    gone = (found.join(keys, F.col("doc_id") == F.col("k_number")).join(lowest, F.col("component_id") == F.col("l_number"))
            .where(F.col("k_id") != F.col("l_id")).select("k_id", "k_text"))
    return docs.join(gone, (F.col("doc_id") == F.col("k_id")) & (digest == F.col("k_text")), "left_anti").withColumnsRenamed(own)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more that a smaller doc_id has are cut out of the texts.

    A null text stays null; a row without a doc_id neither loses words nor makes others lose any.
    ``n_chars`` follows a text that was cut.  An empty table gives no rows; columns of any name,
    also of those used here, pass unchanged."""
    _begin(spark)
    docs, own = _set_aside(docs, "n_words", "n_removed")
    out = remove_repeats(docs, window=PASSAGE_WORDS, start=-(-PASSAGE_WORDS // 2))
    return (out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(docs.columns).withColumnsRenamed(own))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 ids.  A null text is empty and packs its closing id alone; rows
    without a doc_id or with a repeated one are documents of their own; other columns aren't read."""
    _begin(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: Trained models and token ids are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
