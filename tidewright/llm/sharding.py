"""Sharding by longest-processing-time scheduling.

Groups that must stay together go to shards by falling size, each to the least loaded shard of a heap. The heap only
sees a bounded list: every group larger than 1/1000 of a shard by itself (there are at most 1000 per shard), and the rest
bundled by hash. Bundles come in classes that hold ten times less each, so that the last ones placed even the loads out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

PER_SHARD = 1000  # a group above total / (shards * PER_SHARD) is placed by itself
BUNDLES = 100  # bundles of each class and shard
CLASSES = 4  # of bundles, each with a tenth of the one before
BLOCK_ROWS = 1000  # rows of a shard that are numbered together


def longest_first(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each key of (size, key): largest first, ties by key, to the least loaded shard, ties by its number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle(key: str, shards: int) -> Column:
    draw = F.pmod(F.xxhash64(key, F.lit("class")), F.lit(10**6))
    level = F.least(F.floor(-F.log10((draw + 1) / F.lit(10.0**6))), F.lit(CLASSES - 1))
    return (level * shards * BUNDLES + F.pmod(F.xxhash64(key), F.lit(shards * BUNDLES))).cast("long")


def assign(rows: DataFrame, shards: int, group: str = "_group", size: str = "size") -> DataFrame:
    """Add ``shard`` to every row; rows with equal ``group`` (binary, not null) get the same one. No shuffle of ``rows``."""
    groups = materialize(rows.groupBy(F.col(group).alias("g")).agg(F.sum(size).alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") > total / (shards * PER_SHARD)
    # At most shards * PER_SHARD large groups and shards * BUNDLES * CLASSES bundles reach the driver.
    alone = [(r.bytes, bytes(r.g)) for r in groups.where(large).collect()]
    bundled = [(r.bytes, r.b) for r in groups.where(~large).groupBy(_bundle("g", shards).alias("b")).agg(F.sum("bytes").alias("bytes")).collect()]
    place = longest_first([(n, (0, k)) for n, k in alone] + [(n, (1, k)) for n, k in bundled], shards)
    spark = rows.sparkSession
    of_group = spark.createDataFrame([(bytearray(k), s) for (kind, k), s in place.items() if kind == 0], "_g binary, _s1 int")
    of_bundle = spark.createDataFrame([(k, s) for (kind, k), s in place.items() if kind == 1], "_b long, _s2 int")
    df = rows.withColumn("_bundle", _bundle(group, shards))
    df = df.join(F.broadcast(of_group), F.col(group) == F.col("_g"), "left").join(F.broadcast(of_bundle), F.col("_bundle") == F.col("_b"), "left")
    return df.withColumn("shard", F.coalesce("_s1", "_s2")).drop("_g", "_s1", "_b", "_s2", "_bundle")


def number(rows: DataFrame, order: list[str], spread: Column) -> DataFrame:
    """Add ``slot``: gapless from 0 inside each shard. Rows are numbered in hashed blocks, whose counts give the offsets."""
    counts = rows.groupBy("shard").count()
    # The block count depends on the largest shard, so that no block grows with the table.
    blocks = max(1, -(-(counts.agg(F.max("count")).first()[0] or 0) // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(spread, F.lit(blocks)))
    offsets = rows.groupBy("shard", "_block").count()
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    rows = rows.withColumn("_row", F.row_number().over(W.partitionBy("shard", "_block").orderBy(*order)) - 1)
    return rows.join(offsets, ["shard", "_block"]).withColumn("slot", F.col("_offset") + F.col("_row")).drop("_block", "_offset", "_row")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; equal texts share a shard.

    Size is the UTF-8 length plus 16; a null text has no bytes, the checksum of nothing (0) and its own group. Repeated rows
    each get a slot. The law is ``bytes``, so ``grown_shard`` is null.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    group = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2("text", 256)))
    seen = docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), group.alias("_group"))
    placed = materialize(assign(materialize(seen, "sizes"), shards), "placed")
    out = number(placed, ["doc_id", "text_crc32"], F.xxhash64("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
