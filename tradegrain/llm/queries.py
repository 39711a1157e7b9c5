"""The registered queries of this package: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradegrain.llm import align, chat, decontaminate, html_text, lines, packing, pii, prefix_trie, quality, sharding, simhash, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]

# The url rules to apply, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(_table(spark, folder, "documents"), min_words=1)


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def packed_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Packed pieces of documents under a public vocabulary, each with the checksum of its ids."""
    encode = packing.document_encoder(vocabulary or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    pieces = packing.pack(docs, encode, ["text"])
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(_table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"), label_col="toxic")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).drop("text_key", "lang")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), shingle=4, max_bits=4)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(_table(spark, folder, "pages"), rules)


def op9_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, folder, "conversations"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, folder, "documents"), shards=24)


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents")).drop("text_key")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    first = partial(align.byte_level_side, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    second = partial(align.piece_side, public_tokenizers.path("piece_bpe_32k.model"))
    return align.align(_table(spark, folder, "documents"), first, second)[0]


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(_table(spark, folder, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_text": op2_html_text,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_url_rules": op8_url_rules,
    "op9_perspectives": op9_perspectives,
    "op10_shards": op10_shards,
    "op11_personal_data": op11_personal_data,
    "op12_token_alignment": op12_token_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}
