"""A training corpus from raw documents: five stages, each a training-data operator on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import language_id
from mnemospark.llm.common import fold, materialise, unused
from mnemospark.llm.exact_dedup import keep_one
from mnemospark.llm.mixing import mixed
from mnemospark.llm.near_dedup import keep_representatives
from mnemospark.llm.packing import pack


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, null texts among them, and those that are like no learned language.

    Repeated rows are judged alike; columns of any name stay as they are; an empty table stays empty.
    """
    model = language_id.learn(docs.where(fold("doc_id", 3) != 1))
    again = dict(zip(("lang_pred", "score", "evidence"), unused(docs, "had_lang_pred", "had_score", "had_evidence"), strict=True))
    marked = language_id.identify(docs.withColumnsRenamed(again), model)
    kept = marked.where((marked["lang_pred"] != language_id.UNKNOWN) & (marked["evidence"] >= model.level)).drop("lang_pred", "score", "evidence")
    return kept.withColumnsRenamed({v: k for k, v in again.items()}).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the one with the largest id; null is an empty text, a null id the smallest, one of repeated rows stays."""
    return keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their five-word shingles, keep the one with the smallest id, and those without words."""
    return keep_representatives(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them; a null source is one of its own, texts without words are left."""
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is its end alone, repeated rows are documents of their own."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", recognised_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mixing", source_weights),
    ("packing", packed),
]

#: No SQL expresses the trained language model; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
