"""Alignment of two tokenizations of one text, and how often their tokens are linked over the corpus.

Both tokenizers cut the same bytes. Where both have a token end, a group of tokens of each side ends; inside a group
every token of one side overlaps a run of tokens of the other.

* **Galloping intersection** (:func:`gallop`): the shorter list of ends drives. For a block of its ends the place in the longer list
  is bracketed by doubling steps from the last place found, then found by binary search inside the bracket.
* **Ranks**: the rank of an end in the longer list gives the common ends (groups) where it hits, and the difference of the ranks
  of two consecutive ends gives the run of the other side's tokens that a token overlaps (links).
* **Counts**: links are counted inside each text, then added up over the corpus with map-side combine. The table of counts
  (one row for each pair of ids seen linked) is sent to the workers up to a checked number of rows; beyond it the
  pairs of each text are joined to the counts over salts. Both ways give the same result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .bpe import KEPT_PIECES, NARROW, PRETOKEN, WIDE, byte_letters
from .common import materialize, text_or_empty

BLOCK = 256  # ends of the shorter list that are looked up together
BATCH_CHARS = 1 << 20  # characters handled together
UNIT = re.compile(" +[^ ]*")
BROADCAST_PAIRS = 2_000_000  # rows of the count table that are sent to workers: 24 bytes each


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of the sorted ``short`` its rank in the sorted ``long`` (the number of smaller values)."""
    rank = np.empty(len(short), np.int64)
    at, n = 0, len(long)
    for i in range(0, len(short), BLOCK):
        part = short[i : i + BLOCK]
        step = len(part)
        while at + step < n and long[at + step] < part[-1]:
            step *= 2
        stop = min(at + step + 1, n)
        rank[i : i + len(part)] = at + np.searchsorted(long[at:stop], part)
        at = int(rank[i + len(part) - 1])
    return rank


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of two cuttings of one span: token places a and b of every link, and the number of A tokens and of B
    tokens up to each common end. Both lists of ends grow strictly and have the same last value."""
    swap = len(ends_b) < len(ends_a)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    rank = gallop(short, long)
    common = long[np.minimum(rank, len(long) - 1)] == short
    begin = np.concatenate(([0], (rank + common)[:-1]))
    runs = rank - begin + 1
    mine = np.repeat(np.arange(len(short)), runs)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(runs) - runs - begin, runs)
    cut_short = np.flatnonzero(common) + 1
    cut_long = rank[common] + 1
    return (other, mine, cut_long, cut_short) if swap else (mine, other, cut_short, cut_long)


class Known:
    """Packed ids of pieces that no merge leaves. Two generations bound its size: what is still in use moves to the young one."""

    def __init__(self, encode_many):
        self.encode_many, self.young, self.old = encode_many, {}, {}

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the pieces not seen lately, many at once; must precede :meth:`ids` for these texts."""
        if len(self.young) >= KEPT_PIECES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for piece in {p for pieces in texts for p in pieces if p not in young}:
            if (found := old.get(piece)) is None:
                new.append(piece)
            else:
                young[piece] = found
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for piece, ids in zip(part, self.encode_many(part)):
                young[piece] = array("i", ids).tobytes()

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.young.__getitem__, pieces)), np.int32)


class Pair:
    """The two tokenizers with the bytes of their tokens: A of the ``tokenizers`` library, B of ``sentencepiece``.

    The libraries encode pieces that no merge leaves, each once for a worker: pretokens for A, spaces with the word that follows
    for B, none of whose pieces has a space after another character (the constructor checks it).
    """

    def __init__(self, path_a: str, path_b: str):
        import json

        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letter = {c: bytes([b]) for b, c in byte_letters().items()}
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = b"".join(letter.get(c) or c.encode() for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(" " in x.lstrip(b" ").decode(errors="replace") for x in self.bytes_b if len(x) > 1):
            raise ValueError(f"a piece of {path_b} holds a space after another character")
        self.space = self.b.piece_to_id("▁")
        self.known_a = Known(lambda many: (x.ids for x in self.a.encode_batch_fast(many, add_special_tokens=False)))
        self.known_b = Known(self._encode_units)
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        names_a, names_b = ([str(i) for i in range(len(side))] for side in (self.bytes_a, self.bytes_b))
        #: Each id as text followed by a comma, then by the mark that ends its side of a group.
        self.text_a = [x + "," for x in names_a] + [x + "|" for x in names_a]
        self.text_b = [x + "," for x in names_b] + [x + ";" for x in names_b]

    def _encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of spaces with a word; the library puts the first space in front itself, but nothing for an empty text."""
        return [ids or [self.space] for ids in self.b.encode([u[1:] for u in units], num_threads=1)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; None for an empty text or where a side's bytes are not those of space and text."""
        wholes = [" " + t if t and "▁" not in t else "" for t in texts]  # B's mark of a space comes back as a space
        pieces_a = [(PRETOKEN if WIDE.search(t) else NARROW).findall(t) for t in wholes]
        pieces_b = [UNIT.findall(t) for t in wholes]
        self.known_a.learn(pieces_a)
        self.known_b.learn(pieces_b)
        for whole, parts_a, parts_b in zip(wholes, pieces_a, pieces_b):
            a, b, data = self.known_a.ids(parts_a), self.known_b.ids(parts_b), whole.encode()
            same = data and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == data
            yield (a.astype(np.int64), b.astype(np.int64)) if same else None

    def groups_text(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, A before B."""
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[cut_a[:-1]], group_b[cut_b[:-1]] = 1, 1
        group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
        code_a, code_b = a.copy(), b.copy()
        code_a[cut_a - 1] += len(self.bytes_a)
        code_b[cut_b - 1] += len(self.bytes_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate(([0], cut_b))[group_a]] = code_a
        codes[np.arange(len(b)) + cut_a[group_b]] = code_b + len(self.text_a)
        return "".join(map(self._text.__getitem__, codes.tolist()))[:-1]

    @property
    def _text(self) -> list[str]:
        if not hasattr(self, "_all"):
            self._all = self.text_a + self.text_b
        return self._all


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


ALIGNED = "struct<n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, keys: array<long>, times: array<int>>"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def batches(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about BATCH_CHARS characters together; a longer text comes alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BATCH_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat).cast(kind))


def _aligned(path_a: str, path_b: str) -> Column:
    @F.arrow_udf(ALIGNED)
    def run(texts: pa.Array) -> pa.Array:
        pair = pair_of(path_a, path_b)
        numbers, digests, all_keys, all_times = [], [], [], []
        for part in batches(texts.to_pylist()):
            for found in pair.encode(part):
                keys = times = np.empty(0, np.int64)
                if found is None:
                    numbers.append((0, 0, 0, 0))
                    digests.append("")
                else:
                    a, b = found
                    i, j, cut_a, cut_b = overlaps(np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b]))
                    keys, times = np.unique(a[i] << 32 | b[j], return_counts=True)
                    numbers.append((len(a), len(b), len(cut_a), len(i)))
                    digests.append(hashlib.sha256(pair.groups_text(a, b, cut_a, cut_b).encode()).hexdigest())
                all_keys.append(keys)
                all_times.append(times)
        columns = [pa.array(np.array(numbers, np.int64).reshape(-1, 4)[:, k]) for k in range(4)]
        columns += [pa.array(digests, pa.string()), _lists(all_keys, pa.int64()), _lists(all_times, pa.int32())]
        return pa.StructArray.from_arrays(columns, [*NUMBERS, "groups_sha256", "keys", "times"])

    return run(text_or_empty())


def _sums_by_table(table) -> Column:
    @F.arrow_udf("struct<n_best: long, count_sum: long>")
    def run(keys: pa.Array, times: pa.Array) -> pa.Array:
        all_keys, counts, best = table.value
        begin = keys.offsets.to_numpy()
        at = np.searchsorted(all_keys, keys.flatten().to_numpy())
        n = times.flatten().to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(n * counts[at])))
        hits = np.concatenate(([0], np.cumsum(n * best[at])))
        begin = begin - begin[0]
        return pa.StructArray.from_arrays([pa.array(np.diff(x[begin])) for x in (hits, total)], ["n_best", "count_sum"])

    return run("keys", "times")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(key, n, best): corpus-wide links of each pair of ids (A in the upper, B in the lower half), and whether no pair of the same
    B id has more. A B id has at most one row for each id of A."""
    links = aligned.select(F.explode(F.arrays_zip("keys", "times")).alias("p")).select("p.keys", "p.times")
    counts = links.groupBy(F.col("keys").alias("key")).agg(F.sum("times").alias("n"))
    top = F.max("n").over(W.partitionBy(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counts.select("key", "n", (F.col("n") == top).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A null or empty text, and one that a tokenizer does not give back byte for byte, has no tokens: zeros and an empty
    ``groups_sha256``. Each row counts, repeated rows and repeated or null doc_ids too. Only ``doc_id`` and ``text`` are read. Copies
    and very long texts need nothing special: the work is one pass over each text.
    """
    rows = docs.select("doc_id", _aligned(path_a, path_b).alias("_x")).select("doc_id", "_x.*")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(link_counts(rows), "link-counts")
    own = ["doc_id", *NUMBERS]
    if counts.count() <= broadcast_pairs:
        got = counts.orderBy("key").toArrow()
        table = docs.sparkSession.sparkContext.broadcast(tuple(got[c].to_numpy() for c in ("key", "n", "best")))
        sums = rows.withColumn("_s", _sums_by_table(table)).select(*own, "_s.n_best", "_s.count_sum", "groups_sha256")
        return sums
    links = rows.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("_row", F.col("p.keys").alias("key"), F.col("p.times").alias("t"))
    links = salted_join(links, counts, ["key"], ["_row"])
    sums = links.groupBy(F.col("_row").alias("_of")).agg(
        F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    joined = rows.drop("keys", "times").join(sums, F.col("_row") == F.col("_of"), "left")
    return joined.select(*own, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
