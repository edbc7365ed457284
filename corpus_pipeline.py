"""Corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

Each stage works on every document its predecessor kept.  Nulls, empty texts, repeated rows and further columns are
treated as the operators state; rows of null doc_id count as documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import langid, minhash, packing, pii, quality
from assayer.llm.queries import SURROGATE_KEY
from assayer.llm.shared import table
from assayer.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text lies near the centroids of a learned language."""
    return docs.where(langid.language_of(F.col("text"), langid.train(docs))["lang_kept"])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the cut."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_of(F.col("text"), model) >= quality.CUT)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, similarity 0.8)."""
    return minhash.deduplicated(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows a text that changed."""
    given = docs.withColumnRenamed("n_entities", "n_entities given") if "n_entities" in docs.columns else docs
    changed = pii.pseudonymised(given, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("n_entities") > 0, length).otherwise(F.col("n_chars")))
    return changed.drop("n_entities").withColumnRenamed("n_entities given", "n_entities").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token bytes."""
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality", quality_classifier), ("near_duplicates", minhash_dedup), ("personal_data", pii_surrogates), ("packing", pack)]

#: The stages learn models and hash shingles, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
