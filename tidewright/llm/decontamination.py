"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of item words; a document is contaminated where the whole window occurs in it. Windows are sets of
word shingles. Since containment must be complete, one shingle is a sufficient prefix: shingles are ordered by how often
they occur in the corpus, and each window joins the documents on its rarest one only. The place of the shingle in the
window and in the document gives the only possible start of the window (positional bound), which must lie inside the
stretch of text covered by benchmark shingles (length bound). The words are then compared.

Documents are read once. A Bloom filter of the benchmark's shingles, of fixed size, drops the text that has none of them; it
only saves work, since false hits fail the join. What is left is written, as stretches of words with their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key
from .words import ALNUM, Batch, batches, grams

WINDOW = 13
SHINGLE = 5
BLOOM_BITS = 1 << 23

WINDOWS = "array<struct<text: string, size: int, shingles: array<struct<at: int, gram: long>>>>"
STRETCHES = "struct<n_words: int, stretches: array<struct<start: int, text: string, shingles: array<struct<at: int, gram: long>>>>>"


def _item_windows(window: int):
    @F.arrow_udf(WINDOWS)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in batches(texts.to_pylist(), lower=True):
            b = Batch(part, ALNUM)
            for d in range(len(part)):
                lo, hi = int(b.first[d]), int(b.first[d + 1])
                size = min(window, hi - lo)
                k = min(SHINGLE, size)
                g = grams(b.h[lo:hi], k).view(np.int64).tolist() if size else []
                words = b.words(lo, hi)
                out.append([
                    {"text": b" ".join(words[i : i + size]).decode(), "size": size, "shingles": [{"at": j, "gram": g[i + j]} for j in range(size - k + 1)]}
                    for i in range(hi - lo - size + 1 if size else 0)
                ])
        return pa.array(out, run.returnType_arrow)

    run.returnType_arrow = pa.list_(pa.struct([("text", pa.string()), ("size", pa.int32()), ("shingles", pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())])))]))
    return run


def bloom_bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = gram.view(np.uint64)
    return (g % np.uint64(BLOOM_BITS)).astype(np.int64), ((g >> np.uint64(32)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _bloom(shingles: DataFrame) -> np.ndarray:
    """The filter, 32 bits to a number: at most BLOOM_BITS / 32 numbers reach the driver, however many shingles there are."""
    first = F.pmod("gram", F.lit(BLOOM_BITS)).cast("int")
    second = F.pmod(F.shiftrightunsigned("gram", 32), F.lit(BLOOM_BITS)).cast("int")
    bits = shingles.select(F.explode(F.array(first, second)).alias("bit"))
    words = bits.groupBy(F.floor(F.col("bit") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 32)).alias("v"))
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.uint32)
    return out


def bloom_has(bloom: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Which shingles pass the filter."""
    x, y = bloom_bits(gram)
    is_set = lambda bit: (bloom[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)
    return (is_set(x) & is_set(y)).astype(bool)


def _stretches(bloom, sizes: list[int]):
    """Words of each text, and its maximal stretches covered by shingles that pass the filter."""

    @F.arrow_udf(STRETCHES)
    def run(texts: pa.Array) -> pa.Array:
        flags = bloom.value
        out = []
        for part in batches(texts.to_pylist(), lower=True):
            b = Batch(part, ALNUM)
            left = b.left()
            edge = np.zeros(len(b.h) + 1, np.int32)
            at, gram = [], []
            for k in sizes:
                g = grams(b.h, k).view(np.int64)
                hit = np.flatnonzero((left >= k) & bloom_has(flags, g))
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + k, -1)
                at.append(hit)
                gram.append(g[hit])
            where, grams_ = np.concatenate(at), np.concatenate(gram)
            order = np.argsort(where, kind="stable")
            where, grams_ = where[order], grams_[order]
            # Shingles never cross texts, but two stretches may touch there.
            covered = np.zeros(len(b.h) + 2, np.int8)
            covered[1:-1] = np.cumsum(edge[:-1]) > 0
            step = np.diff(covered)
            starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            rows = [[] for _ in part]
            for s, e in zip(starts.tolist(), ends.tolist()):
                d = int(np.searchsorted(b.first, s, side="right")) - 1
                while s < e:
                    while b.first[d + 1] <= s:
                        d += 1
                    stop, base = min(e, int(b.first[d + 1])), int(b.first[d])
                    i, j = np.searchsorted(where, [s, stop])
                    rows[d].append({
                        "start": s - base, "text": b" ".join(b.words(s, stop)).decode(),
                        "shingles": [{"at": p - base, "gram": g} for p, g in zip(where[i:j].tolist(), grams_[i:j].tolist())],
                    })
                    s = stop
            out += [{"n_words": int(n), "stretches": r} for n, r in zip(np.diff(b.first), rows)]
        shingle = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.int64())]))
        return pa.array(out, pa.struct([("n_words", pa.int32()), ("stretches", pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("shingles", shingle)])))]))

    return run


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All documents with their row key and word count, and every occurrence of a window: (_row, start, size, item_id).

    ``docs`` needs doc_id and text, ``items`` item_id and text. Null or wordless texts have no words and no windows. Repeated
    documents are separate rows.
    """
    spark = docs.sparkSession
    windows = items.select("item_id", F.explode(_item_windows(window)("text")).alias("w")).select("item_id", "w.*")
    windows = materialize(windows, "windows")
    sizes = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # at most SHINGLE numbers
    # Windows that several items share are searched once.
    distinct = windows.groupBy("text").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    shingles = distinct.select("text", "size", F.explode("shingles").alias("s")).select("text", "size", F.col("s.at").alias("at"), F.col("s.gram").alias("gram"))
    bloom = spark.sparkContext.broadcast(_bloom(shingles))
    seen = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", row_key().alias("row_key"), _stretches(bloom, sizes or [SHINGLE])("text").alias("s"))
    seen = materialize(seen.select("_row", "doc_id", "row_key", F.col("s.n_words").alias("n_words"), F.col("s.stretches").alias("stretches")), "stretches")

    stretch = seen.select("_row", F.explode("stretches").alias("s")).select("_row", F.col("s.start").alias("begin"), F.col("s.text").alias("words"), "s.shingles")
    occ = stretch.select("_row", "begin", F.explode("shingles").alias("s")).select("_row", "begin", F.col("s.at").alias("at"), F.col("s.gram").alias("gram"))
    rarity = occ.groupBy("gram").agg(F.count("*").alias("n"))
    # A window with a shingle that no document has drops out here.
    ranked = shingles.join(rarity, "gram", "left").groupBy("text").agg(F.first("size").alias("size"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram")).alias("p"))
    prefix = materialize(ranked.where("p.n > 0").select(F.col("text").alias("window"), "size", F.col("p.at").alias("offset"), F.col("p.gram").alias("gram")), "prefix")
    found = occ.join(prefix, "gram").withColumn("start", F.col("at") - F.col("offset")).where(F.col("start") >= F.col("begin")).select("_row", "begin", "start", "size", "window")
    sure = found.join(stretch.select("_row", "begin", F.split("words", " ").alias("words")), ["_row", "begin"]).where(F.col("start") + F.col("size") <= F.col("begin") + F.size("words"))
    sure = sure.where(F.array_join(F.slice("words", F.col("start") - F.col("begin") + 1, F.col("size")), " ") == F.col("window"))
    # Each window once per place, whatever shingle sizes led there.
    sure = materialize(sure.select("_row", "start", "size", "window").distinct(), "occurrences")
    owners = windows.select(F.col("text").alias("window"), "item_id").distinct()
    return seen.select("_row", "doc_id", "row_key", "n_words"), sure.join(owners, "window").select("_row", "start", "size", "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (their ids as sorted strings), contaminated.

    ``contaminated``: some word is hit and ``share`` times the hit words are at least all words.
    """
    seen, found = occurrences(docs, items, window)
    places = found.select("_row", "start", "size").distinct()
    hit = places.select("_row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct().groupBy("_row").agg(F.count("*").alias("n_hit"))
    named = found.select("_row", F.col("item_id").cast("string").alias("i")).distinct().groupBy("_row").agg(F.sort_array(F.collect_set("i")).alias("items"))
    df = seen.join(hit.join(named, "_row", "left"), "_row", "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n_words").cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return df.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"), "_row", "row_key")
