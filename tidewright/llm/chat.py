"""Chat formatting after a cumulative-snapshot collapse.

Services often log a conversation again after each turn. The prefix hash of a turn covers all turns up to it; a conversation whose
full hash is a prefix hash of a longer one is a snapshot and goes, equal conversations keep the least conv_id. Only then are
turns rendered.

A prefix hash is the exclusive or of one hash for each turn (its position, role and text). So it can be computed in blocks
of turns: running values inside a block, block totals carried forward. One very long conversation spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BLOCK_TURNS = 1024  # turn numbers that are hashed together
PART_TURNS = 256  # turns of one rendered row
LANES = ("_h1", "_h2")


def _lane(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Distinct turns with their position from 1 and the two lanes of the hash of all turns up to them.

    Turns are ordered by turn, ties by role and text. Rows without conv_id or turn belong to no conversation and go.
    Repeated rows count once. A null role or text differs from an empty one.
    """
    t = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null").distinct()
    t = t.withColumn("_block", F.floor(F.col("turn") / BLOCK_TURNS).cast("long"))
    inside = W.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    counts = t.groupBy("conv_id", "_block").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select("conv_id", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    t = t.withColumn("_row", F.row_number().over(inside)).join(offset, ["conv_id", "_block"])
    t = t.withColumn("pos", F.col("_offset") + F.col("_row"))
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    digest = F.sha2(F.concat_ws("\x1f", F.col("pos").cast("string"), mark("role"), mark("text")), 256)
    t = t.withColumn("_digest", digest).select("*", _lane(F.col("_digest"), 1).alias("_t1"), _lane(F.col("_digest"), 17).alias("_t2"))
    t = materialize(t.drop("_digest", "_offset", "_row"), "turns")
    totals = t.groupBy("conv_id", "_block").agg(F.bit_xor("_t1").alias("_b1"), F.bit_xor("_t2").alias("_b2"))
    carry = totals.select("conv_id", "_block", *[F.coalesce(F.bit_xor(f"_b{i}").over(before), F.lit(0)).alias(f"_c{i}") for i in (1, 2)])
    running = W.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = t.select("*", *[F.bit_xor(f"_t{i}").over(running).alias(f"_r{i}") for i in (1, 2)]).join(carry, ["conv_id", "_block"])
    return t.select("conv_id", "turn", "role", "text", "pos", *[F.col(f"_r{i}").bitwiseXOR(F.col(f"_c{i}")).alias(f"_h{i}") for i in (1, 2)])


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of a longer one; of equal ones the least conv_id."""
    sizes = hashed.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    rows = hashed.select("conv_id", "pos", *LANES).join(sizes, "conv_id")
    full = rows.where("pos = n_turns").groupBy("pos", *LANES).agg(F.min("conv_id").alias("conv_id"))
    inner = rows.where("pos < n_turns").select("pos", *LANES).distinct()
    return full.join(inner, ["pos", *LANES], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, n_turns, part, n_parts, text.

    Each row holds at most PART_TURNS turns; the texts of a conversation's parts, in order, are the whole rendering. A null
    role is written as ``unknown``, a null text as nothing.
    """
    hashed = materialize(prefix_hashes(turns), "prefixes")
    kept = maximal_conversations(hashed)
    t = hashed.select("conv_id", "pos", "role", "text").join(kept, "conv_id")
    turn = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("pos") - 1) / PART_TURNS).cast("long")
    out = t.groupBy("conv_id", "n_turns", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", turn.alias("t")))).alias("l"))
    n_parts = F.floor((F.col("n_turns") - 1) / PART_TURNS).cast("long") + 1
    return out.select("conv_id", "n_turns", "part", n_parts.alias("n_parts"), F.array_join("l.t", "").alias("text"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n, list({{'r': role, 't': text}} ORDER BY pos) AS l FROM r GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c)),
k AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY c.l)
SELECT k.conv_id, k.n AS n_turns, (pos - 1) // {PART_TURNS} AS part, (k.n - 1) // {PART_TURNS} + 1 AS n_parts,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM k JOIN r USING (conv_id) GROUP BY ALL
"""
