"""From raw documents to packed sequences: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscape.llm import packing, secrets, signature_tree, toxicity
from labelscape.llm.catalog import THRESHOLD, held_out
from labelscape.llm.common import columns_of, small_batches, table, unused, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    name = unused(docs, "toxicity")
    return toxicity.score(docs, toxicity.fit(docs, labels), name=name).where(F.col(name) < THRESHOLD).select(*columns_of(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the document with the smallest doc_id."""
    small_batches(spark)
    return signature_tree.one_of_each(docs, width=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col("n_chars"))).select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL has no tokenizer and no classifier; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
