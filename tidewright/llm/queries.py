"""The operators of this package bound to the given tables, with production parameters, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, conversation_trie, decontamination, lm_scores, near_duplicates, quality, quality_classifier, revisits, sharding, substrings, token_counts
from .common import read, shared_folder

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
MAX_TOKENS = 1024
SHARDS = 40


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(read(spark, folder, "conversations"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    df = decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    docs = read(spark, folder, "documents").select("doc_id", "text")
    df = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest_of_ids().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    df = substrings.remove_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(read(spark, folder, "documents"), SHARDS)


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


def op7_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    good = read(spark, folder, "labels").where("quality = 1 and toxic = 0")
    return lm_scores.score(read(spark, folder, "documents"), good)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(read(spark, folder, "documents")).select(*columns)


def op9_revisits(spark: SparkSession, folder: str) -> DataFrame:
    df = revisits.resolve(revisits.crawl_log(read(spark, folder, "pages")))
    return df.withColumn("headers", revisits.header_lines(F.col("headers")))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = read(spark, folder, "documents").select("doc_id", "text", n_bytes.alias("n_bytes"))  # measured here, so that no text moves to its count
    cache = f"{shared_folder(spark)}/token-counts"  # kept from run to run; only contents not counted yet are encoded
    df = token_counts.count_tokens(docs, cache, public_tokenizers.path(BYTE_BPE))
    return df.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, folder, "conversations"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(read(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.train_and_classify(read(spark, folder, "documents"), read(spark, folder, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat, op2_decontamination, op3_bpe, op4_substrings, op5_sharding, op6_near_duplicates, op7_lm_scores, op8_quality, op9_revisits,
        op10_token_counts, op11_conversation_trie, op12_alignment,
        op13_quality_classifier,
    )
}
SQL: dict[str, str] = {"op1_chat": chat.SQL, "op9_revisits": revisits.SQL, "op11_conversation_trie": conversation_trie.SQL}
