"""Near-duplicate documents: SuperMinHash signatures, banding, verification and union-find grouping.

Documents with equal shingle sets are one node. Signatures are banded, and the members of each bucket are compared on their
full sets, but never two that are known to be in one group:

* every member is compared with one centre, the member of least doc_id. Links found so far are grouped by union-find;
* buckets whose members are not all grouped yet are then compared in full between groups. Five tests come before
  the sets are read: a pair counts in its first common band only; the sizes must allow the similarity; the Jaccard distance is a metric, so
  distances from the centre may not differ by more than the threshold; the odd sketches (the parity of the number of shingles in each of
  ODD_BITS cells) may differ in no more cells than the sets may in shingles, which never rejects a link; and at most :func:`most_different`
  signature components may differ, each known by four bits (a pair at the threshold fails this with probability below 4e-6). The last
  test is for long texts, whose differences fill the odd sketch.

No bucket, however large, is skipped or cut.
"""

from __future__ import annotations


from functools import reduce
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key
from .words import MASK, SPACED, Batch, batches, grams, mix

SHINGLE = 5
MISSED = 1.4e-6  # largest probability that a pair at the threshold shares no band
PLANES = 4  # bits of each signature component that are compared before the sets
ODD_BITS = 1024
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def banding(share: int) -> tuple[int, int]:
    """Bands and rows for a threshold: the most rows, five at most, with which 150 bands miss a pair at it by MISSED at most;
    50 bands of 5 for 75. A low threshold needs bands of one row, as many as it takes."""
    for rows in (5, 4, 3, 2, 1):
        bands = ceil(log(MISSED) / log(1 - min(share / 100, 1 - 1e-9) ** rows))
        if bands <= 150 or rows == 1:
            return bands, rows


def most_different(components: int, share: int) -> int:
    """Components that may look different in a pair at the threshold: the mean and 4.4 standard deviations (88 of 250 for 75).

    The components of SuperMinHash agree with the probability of the similarity and vary less than independent ones.
    """
    p = (1 - share / 100) * (1 - 2.0**-PLANES)
    return int(components * p + 4.4 * sqrt(components * p * (1 - p)))


def superminhash(elements: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Signatures (sets x size) of the sets ``elements[first[i]:first[i + 1]]``, all sets at once.

    Step j gives each element the value j + r in the component that its own random permutation has at place j, so the
    values of an element are correlated ranks instead of independent draws. A set stops once all its components have values
    below j + 1, since later steps could only give larger ones.
    """
    counts = np.diff(first)
    sig = np.full((len(counts), size), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)
    owner = np.repeat(np.arange(len(counts)), counts)
    x, table = elements, None
    for j in range(size):
        if not len(x):
            break
        draw = mix(x + np.uint64(int(GOLDEN) * (j + 1) & MASK))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(size - j)).astype(np.int64)
        if j == 0:
            place = k
        else:
            rows = np.arange(len(x))
            place = table[rows, k].astype(np.int64)
            table[rows, k] = table[:, j]
            table[:, j] = place
        np.minimum.at(flat, owner * size + place, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        sets = np.unique(owner)
        open_ = np.zeros(len(counts), bool)
        open_[sets] = (sig[sets].max(axis=1) >> np.uint64(32)) > j
        stay = open_[owner]
        if j == 0:
            k = k[stay]
            table = np.tile(np.arange(size, dtype=np.uint16), (len(k), 1))
            rows = np.arange(len(k))
            table[rows, k] = 0
            table[:, 0] = k
        elif not stay.all():
            table = table[stay]
        if not stay.all():
            x, owner = x[stay], owner[stay]
    return sig


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Distinct shingles of the words of one text; fewer words than a shingle make one, no words none."""
    return np.unique(grams(h, min(SHINGLE, len(h)))[: max(len(h) - SHINGLE + 1, 1)]) if len(h) else h


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band, which also tells the bands apart."""
    parts = sig.reshape(len(sig), bands, rows)
    total = np.zeros((len(sig), bands), np.uint64)
    for i in range(rows):
        total = mix(total * GOLDEN + parts[:, :, i])
    return mix(total + GOLDEN * np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def _signatures(bands: int, rows: int):
    kind = pa.struct([("n_shingles", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n_shingles: long, node: binary, keys: array<long>, bits: array<long>, odd: array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        n, nodes, keys, bits, odd = [], [], [], [], []
        for part in batches(texts.to_pylist(), lower=True):
            b = Batch(part, SPACED)
            sets = [shingle_set(b.h[b.first[d] : b.first[d + 1]]) for d in range(len(part))]
            sizes = [len(s) for s in sets]
            flat = np.concatenate(sets)
            first = np.cumsum([0, *sizes])
            sig = superminhash(flat, first, bands * rows)
            keys.append(band_keys(sig, bands, rows))
            bits.append(bit_planes(sig))
            odd.append(odd_sketches(flat, first))
            n += sizes
            # The node is the set: two independent sums over its shingles.
            nodes += [np.array([mix(s).sum(), mix(s ^ GOLDEN).sum()], np.uint64).tobytes() if len(s) else None for s in sets]
        lists = [_lists(x, len(n)) for x in (keys, bits, odd)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), *lists], fields=list(kind))

    return run


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """PLANES bits of each component, each plane packed into longs."""
    x, pad = mix(sig), ((0, 0), (0, -sig.shape[1] % 64))
    planes = [np.packbits(np.pad(((x >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), pad), axis=1) for i in range(PLANES)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def odd_sketches(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of the number of elements of each set in each of ODD_BITS cells, packed into longs.

    Two sets that differ in d elements have sketches that differ in d cells at most.
    """
    counts = np.diff(first)
    cell = (mix(elements + GOLDEN) % np.uint64(ODD_BITS)).astype(np.int64)
    held = np.bincount(np.repeat(np.arange(len(counts)), counts) * ODD_BITS + cell, minlength=len(counts) * ODD_BITS)
    return np.packbits((held & 1).astype(np.uint8).reshape(len(counts), ODD_BITS), axis=1).view(np.int64)


def _lists(parts: list[np.ndarray], n: int) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty((0, 1), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))


def _set_bytes():
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(Batch([t.encode().lower()], SPACED).h).tobytes() for t in texts.to_pylist()], pa.binary())

    return run


def _overlap():
    """Sizes of the intersection and the union of two sorted shingle sets."""
    kind = pa.struct([("common", pa.int64()), ("all", pa.int64())])

    @F.arrow_udf("struct<common: long, all: long>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            at = np.searchsorted(x, y)
            common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            out.append({"common": common, "all": len(x) + len(y) - common})
        return pa.array(out, kind)

    return run


def _key() -> Column:
    return row_key()


def _local_union(pairs):
    """Union-find over the links of one task: a forest of links to roots takes their place."""
    for batch in pairs:
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = root.setdefault(root[x], root[x])
                x = root[x]
            return x

        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        links = [(x, find(x)) for x in list(root)]
        links = [p for p in links if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.binary()) for i in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the least node that can be reached.

    Links are first reduced by union-find inside each batch of a task. Then each node takes the least root among its
    neighbours and jumps to that root's own root, until nothing changes; every round is a written table.
    """
    links = materialize(links.select("a", "b").mapInArrow(_local_union, "a binary, b binary").distinct(), "links")
    both = materialize(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "both")
    label = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("m"))
        new = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = materialize(new.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")), "roots")
        if not new.where("old != root").limit(1).count():
            return new.select("node", "root")
        label = new.select("node", "root")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, all) for distinct pairs of nodes; ``sets`` gives the shingle set of each node."""
    df = pairs.select("a", "b").join(sets.toDF("b", "_right"), "b").join(sets.toDF("a", "_left"), "a")
    df = df.select("a", "b", _overlap()("_left", "_right").alias("o")).select("a", "b", "o.*")
    return materialize(df, "compared")


def _open(buckets: DataFrame) -> DataFrame:
    """Buckets (key, node, root, ...) whose members are not all in one group yet."""
    size = buckets.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b")
    return buckets.join(size.select("key"), "key")


def find_links(nodes: DataFrame, sets_of, share: int, components_: int) -> DataFrame:
    """Enough verified links (a, b) to give the groups of all pairs with 100 * common >= ``share`` * all.

    ``nodes`` has node, first (an order that puts likely originals first), size, keys (one per band), bits and odd; ``sets_of``
    gives (node, set) for the nodes of a table; a signature has ``components_`` components.
    """
    limit = 1 - share / 100 + 1e-9
    linked = F.col("common") * 100 >= F.col("all") * share
    exploded = nodes.select(F.posexplode("keys").alias("band", "key"), "node", "first", F.col("node").alias("root"))
    buckets = materialize(_open(exploded).drop("root"), "buckets")
    sets = materialize(sets_of(buckets.select("node").distinct()), "sets")
    centre = buckets.groupBy("key").agg(F.min(F.struct("first", "node"))["node"].alias("c"))
    star = buckets.join(centre, "key").where(F.col("node") != F.col("c")).select("key", "band", "node", "c")
    star = materialize(star.select("key", "band", "node", F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")), "stars")
    seen = verify(star.select("a", "b").distinct(), sets)
    links = seen.where(linked).select("a", "b")

    far = star.join(seen.select("a", "b", (1 - F.col("common") / F.col("all")).alias("far")), ["a", "b"]).select("key", "band", "node", "far")
    rest = far.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = materialize(_open(rest).join(nodes.select("node", "size", "keys", "bits", "odd"), "node"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    close = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    close &= F.abs(F.col("x.far") - F.col("y.far")) <= limit
    close &= F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * share
    words = -(-components_ // 64)
    apart = lambda name, i: F.get(f"x.{name}", F.lit(i)).bitwiseXOR(F.get(f"y.{name}", F.lit(i)))
    odd = sum(F.bit_count(apart("odd", i)) for i in range(ODD_BITS // 64))
    close &= odd * (100 + share) <= (F.col("x.size") + F.col("y.size")) * (100 - share)
    differ = sum(F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), [apart("bits", plane * words + i) for plane in range(PLANES)])) for i in range(words))
    close &= F.coalesce(differ, F.lit(0)) <= most_different(components_, share)
    earlier = lambda side: F.slice(f"{side}.keys", F.lit(1), F.col("x.band"))  # noqa: E731  the bands before this one
    close &= ~F.arrays_overlap(earlier("x"), earlier("y"))
    pairs = x.join(y, close).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return links.union(verify(pairs, sets).where(linked).select("a", "b"))


def near_duplicates(docs: DataFrame, share: int = 75, bands: int | None = None, rows: int | None = None, with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that can be reached) and kept, one row per row of ``docs``.

    Words are runs of other characters than white space, with A-Z lowered. Null or wordless texts have no shingles and are linked
    with nothing. A null doc_id is larger than any other; a row whose component has no id keeps the null. Repeated rows
    have equal sets and are all in one component. Bands and rows follow from ``share`` unless given. ``with_key`` adds the ``row_key``.
    """
    if bands is None or rows is None:
        bands, rows = banding(share)
    keyed = docs.select("doc_id", _key().alias("_key"), _signatures(bands, rows)("text").alias("s"))
    seen = materialize(keyed.select("doc_id", "_key", "s.*"), "signatures")
    some = seen.where(F.col("node").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    nodes = materialize(some.groupBy("node").agg(F.min(order).alias("first"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("odd").alias("odd")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        own = nodes.join(wanted, "node", "left_semi").select("node", F.col("first.id").alias("_id"), F.col("first.key").alias("_key"))
        text = docs.select(F.col("doc_id").alias("_id2"), _key().alias("_key"), "text")
        df = text.join(own.hint("shuffle_hash"), "_key").where(F.col("_id2").eqNullSafe(F.col("_id")))
        return df.groupBy("node").agg(F.first("text").alias("text")).select("node", _set_bytes()("text").alias("set"))

    group = materialize(components(find_links(nodes, sets_of, share, bands * rows)), "groups")
    named = group.join(nodes.select("node", "first"), "node")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of_node = nodes.join(named.join(least, "root").select("node", "least"), "node", "left")
    of_node = of_node.select("node", F.coalesce("least.id", "first.id").alias("component_id"))
    df = seen.select("doc_id", "n_shingles", "node", "_key").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return df.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *([F.col("_key").alias("row_key")] if with_key else []))
