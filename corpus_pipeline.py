"""From raw documents to packed sequences: score, deduplicate, mix, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelflight.llm import digest_index, jaccard, mixing, packing, quality, shared
from shelflight.llm.queries import MIXTURE, MIXTURE_REST, MIXTURE_SEED


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table's labels, does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return digest_index.keep_rows(docs, digest_index.deduplicate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chains of similar documents connect: five words, similarity 0.8."""
    return jaccard.keep_one(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights, in random order."""
    return mixing.mix_sources(docs, MIXTURE, MIXTURE_REST, seed=MIXTURE_SEED).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixture", mix),
    ("packing", pack),
]

# SQL has neither the classifier nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is stored as Parquet and is the next one's input.

    What a stage stored on its way, and the result before, is deleted once its own result is stored; tables that
    others stored in this session stay. An empty table gives no rows; the stages' functions say what becomes of nulls.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with shared.Scope() as scope:
            result = stage(spark, docs, sf_dir)
        docs = shared.stored(result, name)
        scope.clear()
        if last is not None:
            shared.discard(last)
        last = docs
    return docs
