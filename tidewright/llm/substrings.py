"""Substring dedup by seed and extend on winnowed anchors.

Seeds: among the anchors (runs of ANCHOR words) of each window the one of least hash is selected, so two documents that share a
window also select the same anchor in it. Windows in a row with the same selected anchor form a segment, which reaches as
far left and right of its anchor as any window around it.

Extension: rows that share an anchor are compared by their whole segment first. Rows with equal segments extend over it
completely, and the smallest doc_id keeps it. One row of each different segment then extends window by window, again
against the smallest doc_id. So the work is linear in the rows of an anchor, however many share it, and no pair is formed.
Covered windows join to maximal repeats, whose words are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import SPACED, Batch, batches, grams, mix

WINDOW = 50
ANCHOR = 10


def selected(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each run of ``width`` values, the last one among equals."""
    value, place, span = g, np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        a, b = value[:-step], value[step:]
        right = b <= a
        value, place, span = np.where(right, b, a), np.where(right, place[step:], place[:-step]), span + step
    return place


def segments_of(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First window, last window, anchor hash and digest of the words of each segment of one text."""
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, none, none, none
    g = grams(h, anchor)[: len(h) - anchor + 1]
    p = selected(g, window - anchor + 1)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1])
    hi = np.concatenate([lo[1:] - 1, [len(p) - 1]])
    total = _totals(h)
    inside = (total[hi + window] - total[lo]) * _odd_inverse(len(h))[lo]
    return lo, hi, g[p[lo]].view(np.int64), mix(inside + (hi - lo).astype(np.uint64)).view(np.int64)


_BASE = 0xD6E8FEB86659FD93
_up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _up, _down
    if len(_up) < n:
        size = 1 << n.bit_length()
        for name, base in (("_up", _BASE), ("_down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def _odd(n: int) -> np.ndarray:
    _grow(n)
    return _up[:n]


def _odd_inverse(n: int) -> np.ndarray:
    _grow(n)
    return _down[:n]


def _totals(h: np.ndarray) -> np.ndarray:
    """Running sums whose differences are digests of word runs."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _odd(len(h)), out=out[1:])
    return out


def _segments(window: int, anchor: int):
    kind = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64())])

    @F.arrow_udf("array<struct<lo: int, hi: int, anchor: long, digest: long>>")
    def run(texts: pa.Array) -> pa.Array:
        parts, counts = [], []
        for part in batches(texts.to_pylist(), lower=False):
            b = Batch(part, SPACED)
            for d in range(len(part)):
                s = segments_of(b.h[b.first[d] : b.first[d + 1]], window, anchor)
                parts.append(s)
                counts.append(len(s[0]))
        lo, hi, a, x = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(4))
        rows = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(a), pa.array(x)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts], dtype=np.int32)), rows)

    return run


def _windows(window: int):
    """Digests of the windows of the given ranges of a text."""
    kind = pa.struct([("start", pa.int32()), ("anchor", pa.int64()), ("digest", pa.int64())])

    @F.arrow_udf("array<struct<start: int, anchor: long, digest: long>>")
    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        starts, anchors, digests, counts, wanted, row = [], [], [], [], ranges.to_pylist(), 0
        for part in batches(texts.to_pylist(), lower=False):
            b = Batch(part, SPACED)
            for d in range(len(part)):
                h = b.h[b.first[d] : b.first[d + 1]]
                total = _totals(h)
                n = 0
                for r in wanted[row]:
                    at = np.arange(r["lo"], r["hi"] + 1)
                    starts.append(at)
                    anchors.append(np.full(len(at), r["anchor"]))
                    digests.append(mix((total[at + window] - total[at]) * _odd_inverse(len(h))[at]).view(np.int64))
                    n += len(at)
                counts.append(n)
                row += 1
        join = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.empty(0, t))
        rows = pa.StructArray.from_arrays([join(starts, np.int32), join(anchors, np.int64), join(digests, np.int64)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts], dtype=np.int32)), rows)

    return run


def _cut(window: int):
    """Word count and the words outside the windows of each text; null stays null."""
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts.to_pylist(), ranges.to_pylist()):
            words = [w for w in (t or "").translate(_SPACES).split(" ") if w]
            n = len(words)
            if r:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, [x["lo"] for x in r], 1)
                np.add.at(edge, [x["hi"] + window for x in r], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            out.append({"n_words": n, "n_removed": n - len(words), "kept": " ".join(words)})
        return pa.array(out, kind)

    return run


_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}


def _key() -> Column:
    """Rows are joined by what they hold, so that a scan may deal them out in any order."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Runs of windows that start in a document of smaller doc_id too: (doc_id, _key, ranges of first and last window).

    A null doc_id counts as larger than any other. Rows with equal doc_id do not remove each other's words.
    """
    large = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_doc")
    keyed = docs.select("doc_id", "text", _key().alias("_key"))
    seg = keyed.select(large, "_key", F.explode(_segments(window, anchor)("text")).alias("s")).select("_doc", "_key", "s.*")
    seg = materialize(seg, "segments")
    # The aggregates are written before they are joined: only a join right above its shuffles is split at a hot anchor.
    shared = seg.groupBy("anchor").agg(F.min("_doc").alias("a"), F.max("_doc").alias("b")).where("a < b").select("anchor")
    shared = materialize(shared, "anchors")
    seg = materialize(seg.join(shared, "anchor", "left_semi"), "shared")

    first = materialize(seg.groupBy("anchor", "digest").agg(F.min("_doc").alias("first")), "first")
    several = materialize(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
    seg = materialize(seg.join(first, ["anchor", "digest"]), "classes")
    whole = seg.where(F.col("_doc") > F.col("first")).select("_doc", "_key", "lo", "hi")

    # One document of each different segment goes on window by window.
    todo = seg.where(F.col("_doc") == F.col("first")).join(several, "anchor", "left_semi")
    todo = todo.groupBy("_doc", "_key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "anchor"))).alias("ranges"))
    texts = keyed.select(large, "_key", "text").join(todo.hint("shuffle_hash"), ["_doc", "_key"])
    parts = texts.select("_doc", "_key", F.explode(_windows(window)("text", "ranges")).alias("w")).select("_doc", "_key", "w.*")
    parts = materialize(parts, "windows")
    least = parts.groupBy("anchor", "digest").agg(F.min("_doc").alias("a"), F.max("_doc").alias("b")).where("a < b").select("anchor", "digest", F.col("a").alias("first"))
    least = materialize(least, "least")
    more = parts.join(least, ["anchor", "digest"]).where(F.col("_doc") > F.col("first"))
    found = whole.unionByName(more.select("_doc", "_key", F.col("start").alias("lo"), F.col("start").alias("hi")))
    return found.groupBy("_doc", "_key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Add n_words, n_removed and ``kept`` (the words that stay, joined by one space) to every row of ``docs``.

    Null text has no words and keeps the empty text. Repeated rows get the same result. Columns of ``docs`` with one of the three
    names are replaced; all others stay, whatever they are called.
    """
    found = materialize(repeats(docs, window, anchor), "repeats")
    # The columns of the input travel as one, so that none of their names can clash.
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_given"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_doc"), _key().alias("_key"))
    df = df.join(found.hint("shuffle_hash"), ["_doc", "_key"], "left")
    # Not to be repeated inside a filter on its result, which would take a second Python worker for each task.
    df = df.withColumn("_cut", _cut(window).asNondeterministic()("_given.text", "ranges"))
    given = [F.col(f"_given.`{c}`") for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    return df.select(*given, F.col("_cut.n_words").alias("n_words"), F.col("_cut.n_removed").alias("n_removed"), F.col("_cut.kept").alias("kept"))
