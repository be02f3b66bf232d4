"""The corpus pipeline: quality rules, near-dedup, substring dedup, benchmark decontamination, byte BPE round trip.

Each stage gets the documents that the one before kept; all but the last return the columns of ``documents``. Further columns of
the input are not read, whatever their names. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontamination, near_duplicates, quality, substrings
from tidewright.llm.common import materialize, read, ready, row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, judged: DataFrame, *more: str) -> DataFrame:
    """Rows of ``docs`` that ``judged`` holds, found by doc_id and row key, so that no other row of the same doc_id slips in."""
    wanted = judged.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_kept"))
    rows = docs.select(*COLUMNS).withColumn("_key", row_key(*more))
    same = (F.col("_key") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(wanted.hint("shuffle_hash"), same, "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go.

    Null and empty texts have no words and go. Rows are judged one by one, also those of equal or null doc_id; equal rows alike.
    """
    ready(spark)
    return _only(docs, quality.judge(docs).where("kept"), "lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates stays.

    Texts without words are linked with nothing and stay. Repeated rows of the least doc_id stay together; a null doc_id is
    larger than any other.
    """
    ready(spark)
    return _only(docs, near_duplicates.near_duplicates(docs, with_key=True).where("kept"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go from all documents but the first; a document without any word left goes.

    A text that loses nothing stays as it is (a null or wordless one too), otherwise its words are joined by one space. Rows of
    equal doc_id take nothing from each other.
    """
    ready(spark)
    df = substrings.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return df.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go. Null and wordless texts have no windows and stay, rows are judged one by one."""
    items = read(spark, sf_dir, "benchmark")
    found = decontamination.contamination(docs, items)
    return _only(docs, found.where("not contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back. Null counts as empty; one row for each row of ``docs``."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest_of_ids().alias("ids_sha256"), exact.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("byte bpe", tokenize),
]
#: Near-duplicate groups and subword merges are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
