"""Queries of this package's operators over the given tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscape.llm import (alignment, bit_codes, bpe, chat, licenses, manifest, order_minhash, packing, secrets, signature_tree, simhash, toxicity,
                            warc)
from labelscape.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
#: Score from which a document counts as toxic.
THRESHOLD = 0.3


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(table(spark, folder, "conversations"))


def held_out(key: str) -> F.Column:
    """Rows that no model may learn from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    labels = table(spark, folder, "labels").where(~held_out("doc_id"))
    return toxicity.fit(table(spark, folder, "documents"), labels)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, folder)).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op5_bit_codes(spark: SparkSession, folder: str) -> DataFrame:
    return bit_codes.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.neighbour_edits(table(spark, folder, "documents"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_spans(table(spark, folder, "documents"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature_tree.jaccard_join(table(spark, folder, "documents"))


def op8_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    return signature_tree.jaccard_join(table(spark, folder, "documents"), links=True)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN, digests=True)


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignments(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(table(spark, folder, "documents"), tampered=manifest.without_newlines())


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_chat, op2_toxicity, op3_warc, op4_licenses, op5_bit_codes, op6_order_minhash, op7_secrets, op8_jaccard_join, op9_packing, op10_byte_bpe,
    op11_alignment, op12_simhash, op13_manifest)}
ORACLES: dict[str, str] = {
    "op1_chat": chat.SQL,
    "op8_jaccard_join": signature_tree.SQL,
    "op13_manifest": manifest.sql(),
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
}
#: Further queries of an operator: the join with the number of links of each document.
FURTHER: dict[str, Query] = {"op8_link_counts": op8_link_counts}
FURTHER_ORACLES: dict[str, str] = {"op8_link_counts": signature_tree.LINKS_SQL}
