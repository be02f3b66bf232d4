"""Token counts behind a digest cache.

A count is stored under two digests, of the content and of the tokenizer file, so a new tokenizer version never reads old
counts. Contents without a stored count are reduced to distinct ones before any text is encoded, and their counts are
appended to the cache. The cache is a Parquet folder that all executors reach; an append is one committed Spark job.

Byte-level tokenizers of the ``tokenizers`` library count by pretoken: the library encodes each pretoken once per worker
and its length is remembered, which gives the count of the whole text since merges never cross pretokens.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, NARROW, PRETOKEN, WIDE
from .common import text_or_empty

#: Pretokens whose length a worker remembers before it starts anew.
KEPT = 400_000


class PieceCounter:
    """Counts by pretoken for a plain byte-level tokenizer of the ``tokenizers`` library."""

    def __init__(self, tokenizer, special: list[str]):
        self.tokenizer, self.special, self.known = tokenizer, special, {}

    def count(self, texts: list[str]) -> list[int]:
        split = [self._pieces(t) for t in texts]
        new = list({p for pieces, _ in split for p in pieces if p not in self.known})
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list({p for pieces, _ in split for p in pieces})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, map(len, self.tokenizer.encode_batch(part, add_special_tokens=False))))
        return [sum(map(self.known.__getitem__, pieces)) + extra for pieces, extra in split]

    def _pieces(self, text: str) -> tuple[list[str], int]:
        parts = [text]
        for s in self.special:
            parts = [q for p in parts for q in p.split(s)]
        found = (PRETOKEN if WIDE.search(text) else NARROW).findall
        return [x for p in parts for x in found(p)], len(parts) - 1


class WholeCounter:
    """Counts by encoding whole texts, for any other tokenizer file."""

    def __init__(self, encode):
        self.encode = encode

    def count(self, texts: list[str]) -> list[int]:
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=4)
def counter(path: str):
    """The counter of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return WholeCounter(lambda t: len(model.encode(t, num_threads=1)))
    import json
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if spec["model"]["type"] == "BPE" and spec["normalizer"] is None and spec["pre_tokenizer"] == plain and simple and len(spec["added_tokens"]) < 2:
        return PieceCounter(tokenizer, [t["content"] for t in spec["added_tokens"]])
    return WholeCounter(lambda t: len(tokenizer.encode(t, add_special_tokens=False)))


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: str = "text") -> Column:
    """Digest of the normalised content: null counts as empty, nothing else is changed since it could change the tokens."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def _stored(spark, cache: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("version string, digest binary, n_tokens long").parquet(cache)


def fill_cache(docs: DataFrame, cache: str, path: str, text: str = "text") -> None:
    """Encode each distinct content without a stored count once and append its count to ``cache``."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    known = _stored(spark, cache)
    todo = docs.select(content_digest(text).alias("digest"), text_or_empty(text).alias("_text"))
    # Copies are combined before the shuffle, so that a hot content moves once per task; the stored counts meet them after it.
    todo = todo.groupBy("digest").agg(F.any_value("_text").alias("_text"))
    if known is not None:
        todo = todo.join(known.where(F.col("version") == version), "digest", "left_anti")

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        out: list[int] = []
        batch, size = [], 0
        for t in texts.to_pylist():
            batch.append(t)
            size += len(t)
            if size > 4 * CHUNK:
                out += counter(path).count(batch)
                batch, size = [], 0
        return pa.array(out + counter(path).count(batch), pa.int64())

    todo.select(F.lit(version).alias("version"), "digest", count("_text").alias("n_tokens")).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` to every row of ``docs``; null text counts as empty, repeated rows stay.

    A column of ``docs`` called n_tokens is replaced; all others stay, whatever they are called. They move with their digest: a
    caller that derives what it needs of the text before and drops the text after keeps it out of that shuffle.
    """
    fill_cache(docs, cache, path, text)
    known = _stored(docs.sparkSession, cache).where(F.col("version") == tokenizer_version(path))
    known = known.groupBy("digest").agg(F.max("n_tokens").alias("_n_tokens")).withColumnRenamed("digest", "_digest")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_given"), content_digest(text).alias("_key"))
    df = df.join(known, F.col("_key") == F.col("_digest"), "left")
    return df.select(*[F.col(f"_given.`{c}`") for c in docs.columns if c != "n_tokens"], F.col("_n_tokens").alias("n_tokens"))
