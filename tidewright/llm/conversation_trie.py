"""The prefix trie of conversations: one node for each distinct sequence of first turns, with sums over its subtree.

* **Rows.** A turn is a 128-bit id. A conversation is cut into segments of SEGMENT turns; a row holds the ids of one segment and
  the key of all segments before it, so no row grows with the length of a conversation. Rows are sorted by key, ids and
  conv_id and dealt into range shards; equal conversations differ in conv_id, so a hot group spreads over shards.
* **A shard** (:func:`nodes`) is a padded matrix of turn ids. ``numpy.lexsort`` orders its rows, the changes against the row before are
  OR-accumulated along the columns, so that the mask of column d marks where the nodes of depth d start, and ``reduceat``
  sums every depth between the marks.
* **Sums over subtrees** need no tree. Each node is owned by the first row that has it; a conversation owns its nodes from some depth on.
  Then the weight of the distinct nodes below a node is a sum over its members of the part they own, and so are the numbers of
  children and leaves.
* **Boundaries.** A shard knows the last row before it and the first row after it. Nodes that reach over a boundary carry a key; their parts
  are added up by key with map-side combine. So is the parent's number sent to the few nodes whose parent was cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import materialize

SEGMENT = 64  # turns of one row
SHARD_ROWS = 20_000
BLOCK = 1024  # segments of a conversation that one window orders
PIECE = 2_000  # conv_ids of one piece of a list that is hashed across shards
GROUP = 20  # conversations that share the first turns of one of them
ROOT = "root"
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ("seg", "k1", "k2", "ids", "more", "conv_id")
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


# ---- rebuilt conversations ------------------------------------------------------------------------------


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos from 1, _id (32 hex digits), _w (words) and n (turns of the conversation) of every turn that has a conv_id.

    Turns are ordered by turn, null first; turns of equal number by the digest of role and text. Repeated rows are turns of
    their own. The rows are sorted by range, so a conversation of very many turns spreads over tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("_id"), words.alias("_w"))
    t = t.withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("_id"), F.col("_tie")]
    t = materialize(t.repartitionByRange("conv_id", *order).withColumn("_part", F.spark_partition_id()), "trie-turns")
    sizes = t.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    whole = W.partitionBy("conv_id")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("conv_id", "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    inside = W.partitionBy("conv_id", "_part").orderBy(*order)
    t = t.withColumn("_row", F.row_number().over(inside)).join(sizes, ["conv_id", "_part"])
    return t.select("conv_id", (F.col("_before") + F.col("_row")).alias("pos"), "_id", "_w", "n")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, _id, _w, total) of every turn of the rebuilt conversations, and (conv_id, total) of the conversations.

    The first h turns, h = crc32(conv_id) % 4, come from the conversation conv_id - conv_id % 20, as many as it has; the own
    turns after the first h follow.
    """
    t = materialize(numbered_turns(turns), "trie-numbered")
    convs = t.where("pos = 1").select("conv_id", "n")
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).alias("h")
    convs = convs.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = convs.where("conv_id = base").select(F.col("base").alias("_base"), F.col("n").alias("_n"))
    convs = convs.join(bases, F.col("base") == F.col("_base"), "left")
    taken = F.least(F.col("h"), F.coalesce("_n", F.lit(0)))
    convs = convs.select("conv_id", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    convs = materialize(convs, "trie-conversations")
    heads = t.where(f"pos <= 3 and conv_id % {GROUP} = 0").select(F.col("conv_id").alias("_base"), F.col("pos").alias("depth"), "_id", "_w")
    first = convs.where("taken > 0").join(heads, (F.col("base") == F.col("_base")) & (F.col("depth") <= F.col("taken")))
    own_h = F.crc32(F.col("conv_id").cast("string")) % 4
    rest = salted_join(t.where(F.col("pos") > own_h), convs.drop("base"), ["conv_id"], ["pos"])
    rest = rest.withColumn("depth", F.col("pos") - own_h + F.col("taken"))
    columns = ["conv_id", "depth", "_id", "_w", "total"]
    return first.select(*columns).unionByName(rest.select(*columns)), convs.select("conv_id", "total")


def _lane(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def _upto(df: DataFrame, wanted: dict[str, tuple], backwards: bool, include: bool) -> DataFrame:
    """Running aggregates along ``seg`` of each conversation, inside blocks first and then over the totals of blocks.

    ``wanted`` gives for each new column its source, the aggregate and how two of its values are put together.
    """
    def order(c: str) -> Column:
        return F.col(c).desc() if backwards else F.col(c).asc()

    df = df.withColumn("_block", F.floor(F.col("seg") / BLOCK))
    inside = W.partitionBy("conv_id", "_block").orderBy(order("seg")).rowsBetween(W.unboundedPreceding, 0 if include else -1)
    outside = W.partitionBy("conv_id").orderBy(order("_block")).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy("conv_id", "_block").agg(*[fn(c).alias(f"_t_{name}") for name, (c, fn, _) in wanted.items()])
    carry = totals.select("conv_id", "_block", *[F.coalesce(fn(f"_t_{name}").over(outside), F.lit(0)).alias(f"_c_{name}") for name, (_, fn, _) in wanted.items()])
    df = df.select("*", *[F.coalesce(fn(c).over(inside), F.lit(0)).alias(f"_i_{name}") for name, (c, fn, _) in wanted.items()])
    df = df.join(carry, ["conv_id", "_block"])
    both = {name: plus(F.col(f"_i_{name}"), F.col(f"_c_{name}")) for name, (_, _, plus) in wanted.items()}
    return df.withColumns(both).drop("_block", *[f"_{k}_{name}" for k in "ic" for name in wanted])


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation and segment: conv_id, seg, ids (16 bytes a turn), ws (words of each turn), more (a segment
    follows), k1 and k2 (hash of the segments before) and n1 and n2 (the hash with this one)."""
    rows, convs = rebuilt(turns)
    rows = rows.withColumn("seg", F.floor((F.col("depth") - 1) / segment).cast("long"))
    s = rows.groupBy("conv_id", "seg", "total").agg(F.array_sort(F.collect_list(F.struct("depth", "_id", "_w"))).alias("l"))
    s = s.select("conv_id", "seg", "total", F.unhex(F.array_join("l._id", "")).alias("ids"), F.col("l._w").alias("ws"))
    none = convs.where("total = 0").select("conv_id", F.lit(0).cast("long").alias("seg"), "total", F.unhex(F.lit("")).alias("ids"), F.array().cast("array<long>").alias("ws"))
    s = materialize(s.unionByName(none), "trie-segments")
    long = s.where(F.col("total") >= segment)
    digest = F.sha2(F.concat(F.col("seg").cast("string"), F.lit(":"), F.hex("ids")), 256)
    marks = long.select("conv_id", "seg", _lane(digest, 1).alias("_a"), _lane(digest, 17).alias("_b"))
    xor = lambda a, b: a.bitwiseXOR(b)
    marks = _upto(marks, {"k1": ("_a", F.bit_xor, xor), "k2": ("_b", F.bit_xor, xor)}, backwards=False, include=False)
    marks = marks.select("conv_id", "seg", "k1", "k2", xor(F.col("k1"), F.col("_a")).alias("n1"), xor(F.col("k2"), F.col("_b")).alias("n2"))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "n1", "n2")]
    both = s.where(F.col("total") < segment).select("*", *zeros).unionByName(long.join(marks, ["conv_id", "seg"]))
    return both.withColumn("more", F.col("total") > (F.col("seg") + 1) * segment).drop("total")


def sharded(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows in range shards of about ``shard_rows``, numbered in order."""
    rows = materialize(rows, "trie-rows")
    n = max(1, -(-rows.count() // shard_rows))
    return materialize(rows.repartitionByRange(n, *KEY).withColumn("shard", F.spark_partition_id()), "trie-shards")


def neighbours(shards: DataFrame) -> DataFrame:
    """For each shard the last row before (side -1) and the first row after it (side 1); one small row for each shard is ordered."""
    edge = F.struct(*KEY)
    ends = shards.groupBy("shard").agg(F.min(edge).alias("first"), F.max(edge).alias("last"))
    order = W.orderBy("shard")
    ends = ends.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    sides = [ends.where(f"{c} is not null").select("shard", F.lit(side).alias("side"), f"{c}.*") for c, side in (("before", -1), ("after", 1))]
    return sides[0].unionByName(sides[1])


# ---- one shard ------------------------------------------------------------------------------------------


class Shard:
    """The sorted rows of a shard with what they share with the row before and after."""

    def __init__(self, table: pa.Table):
        side = table["side"].to_numpy()
        column = {c: table[c].to_numpy() for c in ("seg", "k1", "k2", "conv_id")}
        more = np.array(table["more"].to_pylist(), bool)
        data = table["ids"].to_pylist()
        lens = np.array([len(x) // 16 for x in data], np.int64)
        self.width = max(int(lens.max(initial=0)), 1)
        valid = np.arange(self.width) < lens[:, None]
        matrix = np.zeros((len(data), self.width, 2), np.uint64)
        matrix[valid] = np.frombuffer(b"".join(data), ">u8").reshape(-1, 2)
        columns = [matrix[:, d, lane] for d in range(self.width - 1, -1, -1) for lane in (1, 0)]
        order = np.lexsort((column["conv_id"], more, lens, *columns, column["k2"], column["k1"], column["seg"]))
        matrix, valid, lens, side = matrix[order], valid[order], lens[order], side[order]
        changes = (matrix[1:] != matrix[:-1]).any(2) | ~(valid[1:] & valid[:-1])
        other = np.zeros(max(len(order) - 1, 0), bool)
        for c in ("seg", "k1", "k2"):
            other |= column[c][order][1:] != column[c][order][:-1]
        changes = np.logical_or.accumulate(changes | other[:, None], axis=1)
        shared = np.where(other, -1, (~changes).sum(1))  # turns shared with the row before; -1 across keys
        own = np.flatnonzero(side == 0)
        lo, hi = int(own[0]), int(own[-1]) + 1
        self.n, self.rows = hi - lo, order[lo:hi]
        self.lens, self.more = lens[lo:hi], more[order][lo:hi]
        self.conv, self.seg, self.k1, self.k2 = (column[c][order][lo:hi] for c in ("conv_id", "seg", "k1", "k2"))
        edges = np.concatenate(([-1], shared, [-1]))
        self.before, after = edges[lo:hi], edges[lo + 1 : hi + 1]
        self.after_last = int(after[-1])
        self.leaf = ~self.more & (after != self.lens)
        #: Where the nodes of each column start inside this shard.
        self.starts = np.concatenate((np.ones((1, self.width), bool), changes))[lo:hi]
        self.starts[0] = True
        words = np.zeros((self.n, self.width + 1), np.int64)
        lists = table["ws"].combine_chunks().take(pa.array(self.rows))
        words[:, :-1][valid[lo:hi]] = lists.flatten().to_numpy()
        #: Words of the turns from each column on.
        self.words = words[:, ::-1].cumsum(1)[:, ::-1]
        self.ids = [data[i] for i in self.rows]


def owned(table: pa.Table) -> pa.Table:
    """What each row owns: words, whether it ends in a leaf it owns, whether it owns its first node."""
    if not (table["side"].to_numpy() == 0).any():
        return OWNED.empty_table()
    s = Shard(table)
    own = s.words[np.arange(s.n), np.maximum(s.before, 0)]
    return pa.table([s.conv, s.seg, s.words[:, 0], own, s.leaf.astype(np.int64), s.before <= 0], OWNED)


OWNED = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("tokens", pa.int64()), ("owned", pa.int64()), ("leaves", pa.int64()), ("first", pa.bool_())])
NODES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("parent_conv_id", pa.int64()),
                   *[(c, pa.int64()) for c in SUMS], ("ends_sha256", pa.string()), ("shard", pa.int64()), ("piece_no", pa.int64()), ("piece", pa.string())])


def nodes(segment: int):
    """All nodes of a shard; those that other shards may also hold carry a key, and their lists of ends come in pieces."""

    def run(table: pa.Table) -> pa.Table:
        shard = int(table["shard"][0].as_py())
        if not (table["side"].to_numpy() == 0).any():
            return NODES.empty_table()
        s = Shard(table)
        after = {c: table[c].to_numpy(zero_copy_only=False)[s.rows] for c in ("after_tokens", "after_owned", "after_leaves", "after_first", "n1", "n2")}
        own_from = np.maximum(s.before, 0)
        leaves = s.leaf + after["after_leaves"].astype(np.int64)
        rows = np.arange(s.n)
        out: dict[str, list] = {c: [] for c in NODES.names}

        def emit(**columns):
            n = len(columns["conv_id"])
            for c, parts in out.items():
                parts.append(pa.array(columns[c], NODES.field(c).type) if c in columns else pa.nulls(n, NODES.field(c).type))

        def finish(d: int, idx: np.ndarray, s_at: np.ndarray, keys: list, parents: tuple[list, list]) -> np.ndarray:
            """Sums between the starts ``s_at`` among the rows ``idx`` that have column d (d = -1: the root)."""
            stops = np.append(s_at[1:], len(idx))
            least = np.minimum.reduceat(s.conv[idx], s_at)
            at = np.maximum(d, own_from)
            child = ((s.lens > d + 1) & (own_from <= d + 1)) | ((s.lens == d + 1) & s.more & after["after_first"].astype(bool))
            saved = s.words[:, max(d, 0)] + after["after_tokens"] - s.words[rows, at] - after["after_owned"]
            total = lambda v: np.add.reduceat(v[idx].astype(np.int64), s_at)
            n_ends = total((s.lens == d + 1) & ~s.more)
            digests: list = [NO_ENDS] * len(s_at)
            for i in np.flatnonzero(n_ends):  # the ends of a node come first, by conv_id
                ends = s.conv[idx[s_at[i] : s_at[i] + n_ends[i]]].tolist()
                if keys[i] is None:
                    digests[i] = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
                else:
                    pieces = [",".join(map(str, ends[j : j + PIECE])) for j in range(0, len(ends), PIECE)]
                    emit(conv_id=ends[::PIECE], key=[keys[i]] * len(pieces), shard=[shard] * len(pieces), piece_no=range(len(pieces)), piece=pieces)
            emit(conv_id=least, depth=s.seg[idx[s_at]] * segment + d + 1, key=keys, parent_key=parents[0], parent_conv_id=parents[1], n_convs=stops - s_at,
                 n_children=total(child), n_leaves=total(leaves), saved_tokens=total(saved), ends_sha256=digests)
            return least

        top = np.flatnonzero(s.seg == 0)
        if len(top):
            finish(-1, top, np.zeros(1, np.int64), [ROOT], ([None], [None]))
        upper: tuple = ()
        for d in range(s.width):
            idx = np.flatnonzero(s.lens > d)
            if not len(idx):
                break
            s_at = np.flatnonzero(s.starts[idx, d])
            first, last = idx[s_at], idx[np.append(s_at[1:], len(idx)) - 1]
            cut = ((first == 0) & (s.before[0] > d)) | ((last == s.n - 1) & (s.after_last > d))
            if d == segment - 1:
                cut |= np.maximum.reduceat(s.more[idx], s_at)
            keys: list = [None] * len(s_at)
            for i in np.flatnonzero(cut):
                r = first[i]
                if d == segment - 1:
                    keys[i] = f"{s.seg[r] + 1}:{after['n1'][r]}:{after['n2'][r]}"
                else:
                    keys[i] = hashlib.sha256(f"{s.seg[r]}:{s.k1[r]}:{s.k2[r]}:".encode() + s.ids[r][: 16 * (d + 1)]).hexdigest()[:32]
            if d == 0:
                parent_key = [ROOT if s.seg[r] == 0 else f"{s.seg[r]}:{s.k1[r]}:{s.k2[r]}" for r in first]
                parent_conv: list = [None] * len(first)
            else:
                above = np.searchsorted(upper[0], first, "right") - 1
                parent_key = [upper[2][i] for i in above]
                parent_conv = [None if k is not None else c for k, c in zip(parent_key, upper[1][above].tolist())]
            least = finish(d, idx, s_at, keys, (parent_key, parent_conv))
            upper = (first, least, keys)
        return pa.table([pa.concat_arrays(out[c]) for c in NODES.names], NODES)

    return run


def _hashed(batches):
    """SHA-256 of each key's pieces, which come in order; the state is one hash."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, piece in zip(batch["key"].to_pylist(), batch["piece"].to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["_key", "_ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["_key", "_ends"])


# ---- the trie -------------------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations.

    Null role or text counts as empty. Rows without conv_id belong to no conversation. Repeated rows and turns of equal number are
    turns of their own. A conversation without a rebuilt turn ends at the root; no conversation gives no node. Only conv_id,
    turn, role and text are read. Each result is exact, but for collisions of 120-bit hashes.

    A SHA-256 must be computed in order: the ends of a hot node are put together as texts of PIECE ids in its shards, and only
    these texts pass through one task, which keeps none of them.
    """
    shards = sharded(segments(turns, segment), shard_rows)
    sides = materialize(neighbours(shards), "trie-sides")
    columns = ["shard", "side", *KEY, "ws", "n1", "n2"]
    later = ["after_tokens", "after_owned", "after_leaves"]
    empty = [F.array().cast("array<long>").alias("ws"), F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2")]
    edge = sides.select("shard", "side", *KEY, *empty)
    inner = shards.withColumn("side", F.lit(0)).select(*columns)
    deep = inner.where("seg > 0").unionByName(edge).groupBy("shard").applyInArrow(owned, _ddl(OWNED))
    plus = lambda a, b: a + b
    deep = materialize(deep, "trie-owned")
    wanted = {f"after_{c}": (c, F.sum, plus) for c in ("tokens", "owned", "leaves")}
    below = _upto(deep, wanted, backwards=True, include=True).select("conv_id", (F.col("seg") - 1).alias("seg"), *later, F.col("first").alias("after_first"))
    zeros = [F.lit(0).cast("long").alias(c) for c in later] + [F.lit(False).alias("after_first")]
    full = inner.where("not more").unionByName(edge).select("*", *zeros).unionByName(inner.where("more").join(below, ["conv_id", "seg"]))
    made = full.groupBy("shard").applyInArrow(nodes(segment), _ddl(NODES))
    made = materialize(made, "trie-nodes")
    result = ["conv_id", "depth", "parent_key", "parent_conv_id", *SUMS, "ends_sha256"]
    parts = made.where("key is not null and depth is not null")
    merged = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
                                      F.max("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    pieces = made.where("piece is not null").select("key", "shard", "piece_no", "piece")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece_no").mapInArrow(_hashed, "_key string, _ends string")
    merged = merged.join(pieces, F.col("key") == F.col("_key"), "left").withColumn("ends_sha256", F.coalesce("_ends", F.lit(NO_ENDS))).drop("_key", "_ends")
    merged = materialize(merged, "trie-merged")
    known = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    whole = made.where("key is null").select(*result)
    rows = whole.where("parent_key is not null").unionByName(merged.where(f"key <> '{ROOT}' and parent_key is not null").select(*result))
    rows = salted_join(rows, known, ["parent_key"], ["conv_id", "depth"]).withColumn("parent_conv_id", F.col("_parent"))
    rest = whole.where("parent_key is null").unionByName(merged.where(f"key = '{ROOT}' or parent_key is null").select(*result))
    out = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    return rows.select(*out).unionByName(rest.select(*out))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# Bit by bit, since DuckDB has no crc32.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
l AS (SELECT conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS l FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, d, l[1:d] AS p, len(l) AS n FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM l)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS w FROM m GROUP BY d, p),
k AS (SELECT p[1:d-1] AS p, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
b AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.p = n.p),
u AS (SELECT a AS d, p[1:a] AS p, w, n_convs, n_children FROM (SELECT *, unnest(range(d + 1)) AS a FROM b)),
s AS (SELECT d, p, sum((n_convs - 1) * w) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM u GROUP BY d, p)
SELECT b.conv_id, b.d::BIGINT AS depth, q.conv_id AS parent_conv_id, b.n_convs, b.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, b.ends_sha256
FROM b JOIN s ON s.d = b.d AND s.p = b.p LEFT JOIN n q ON q.d = b.d - 1 AND q.p = b.p[1:b.d-1]
"""
