"""Document quality by a generalised additive model with pairwise interactions.

The log odds of a good text are a sum of table entries: one table for each feature, one for each of a few pairs of features.

* **Features** are numbers of the text alone (shares of character classes, repetition, length, word shapes). Each is cut into at most
  BINS bins at quantiles of the training rows.
* **Cyclic boosting**: round after round, each feature in turn gets one shallow tree (at most LEAVES leaves, grown on the
  bins' gradient sums), shrunk and added to its table. So no feature takes over what another explains as well.
* **Pairs**: with the single tables fixed, each pair of features is rated by the gain of the best cut into four quadrants on
  coarse bins; the best PAIRS are boosted in the same cyclic way, one quadrant tree at a time.
* **Scoring** finds the bins of a batch of texts and adds the entries: no trees are left, only vectorised lookups.

The fit uses a bounded sample of labelled rows (``max_rows``, taken by a hash of the doc_id) and numpy on the driver. The
scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MAX_ROWS = 40_000  # labelled rows of the fit
BINS = 32
COARSE = 6  # bins of a feature inside a pair
LEAVES = 4
PAIRS = 10
ROUNDS = 120
RATE = 0.1
LEAST = 8  # training rows of a leaf
RIDGE = 1.0  # added to the weight of a leaf
CUT = 0.3  # scores from here on count as good
CHUNK = 1 << 16  # characters of a text measured at once

FEATURES = ["log_words", "word_length", "symbols", "punctuation", "digits", "upper", "blank", "other", "odd_endings", "loud_words", "new_words", "repeats",
            "follow_self", "dup_lines", "line_words", "short_lines", "long_words", "sentence_words", "bars", "entropy", "worst_symbols", "worst_upper"]

# Classes of the first 256 code points; all others count as letters unless they are blanks.
LETTER, UPPER, DIGIT, BLANK, STOP, SYMBOL, OTHER = range(7)


def _classes() -> np.ndarray:
    kinds = np.full(257, LETTER, np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isspace():
            kinds[i] = BLANK
        elif c.isdigit():
            kinds[i] = DIGIT
        elif c.isupper():
            kinds[i] = UPPER
        elif not c.isalpha():
            kinds[i] = STOP if c in ".,;:!?'\"()-" else SYMBOL if i < 127 else OTHER
    return kinds


CLASS = _classes()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shares(text: str) -> tuple[np.ndarray, float, float]:
    """Characters of each class, and the largest share of symbols and of upper case in any chunk of the text."""
    total, worst_symbols, worst_upper = np.zeros(7, np.int64), 0.0, 0.0
    for i in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[i : i + CHUNK].encode("utf-32-le"), np.uint32)
        kinds = CLASS[np.minimum(codes, 256)]
        total += np.bincount(kinds, minlength=7)
        for j in range(0, len(kinds), 1024):
            part = np.bincount(kinds[j : j + 1024], minlength=7)
            n = max(part.sum() - part[BLANK], 200)
            worst_symbols, worst_upper = max(worst_symbols, (part[SYMBOL] + part[STOP]) / n), max(worst_upper, part[UPPER] / n)
    return total, worst_symbols, worst_upper


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES; an empty text has zeros."""
    words = WORD.findall(text or "")
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds, worst_symbols, worst_upper = _shares(text)
    inked = max(int(kinds.sum() - kinds[BLANK]), 1)
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    counts = np.bincount(codes)
    threes = codes[:-2] * len(ids) ** 2 + codes[1:-1] * len(ids) + codes[2:] if n > 2 and len(ids) < 1 << 20 else codes[:0]
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words)
    share = counts / n
    return [
        np.log1p(n), inked / n, kinds[SYMBOL] / inked, kinds[STOP] / inked, kinds[DIGIT] / inked, kinds[UPPER] / inked, kinds[BLANK] / n, kinds[OTHER] / inked,
        odd / n, sum(map(str.isupper, words)) / n, len(ids) / n, 1 - len(np.unique(threes)) / len(threes) if len(threes) else 0.0,
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), n / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), float((lengths > 20).mean()), n / (1 + text.count(". ") + text.count(".\n")), words.count("|") / n,
        float(-(share * np.log(share)).sum() / np.log(n + 1)), worst_symbols, worst_upper,
    ]


def measured(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """Cuts of each feature, its table, and the tables of pairs over coarser cuts."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            z += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1.0 / (1.0 + np.exp(-z))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner borders at quantiles; equal values share a bin."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher")) if len(values) else np.empty(0)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf value of each bin: the range is cut where the gain is largest until there are LEAVES leaves."""
    cg, ch, cn = (np.concatenate(([0], np.cumsum(x))) for x in (g, h, n))
    leaves = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        ok = (cn[k] - cn[a] >= LEAST) & (cn[b] - cn[k] >= LEAST)
        if not ok.any():
            return 0.0, -1
        gain = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
        gain = np.where(ok, gain, 0.0)
        i = int(gain.argmax())
        return float(gain[i]), int(k[i])

    while len(leaves) < LEAVES:
        found = [(*best(a, b), i) for i, (a, b) in enumerate(leaves)]
        gain, k, i = max(found, key=lambda f: f[0])
        if gain <= 1e-9:
            break
        a, b = leaves[i]
        leaves[i : i + 1] = [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a pair's grid into four quadrants."""
    def corner(x):
        return np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    cg, ch, cn = corner(g), corner(h), corner(n)
    best, out = 0.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            parts = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            def split(c):
                return np.array([c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b]])
            sg, sh, sn = split(cg), split(ch), split(cn)
            full = sn >= LEAST
            gain = float((_gain(sg, sh) * full).sum() - _gain(cg[-1, -1], ch[-1, -1]))
            if gain > best + 1e-9:
                best, out = gain, np.zeros_like(g)
                for where, value, ok in zip(parts, sg / (sh + RIDGE), full):
                    out[where] = value if ok else 0.0
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS) -> Model:
    """Boosted tables for labels 0 and 1. Without rows, or with one label only, the score is the smoothed share of label 1."""
    y = y.astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], [_cuts(x[:, j], COARSE) for j in range(x.shape[1])])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    z = np.full(len(y), model.base)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, at in enumerate(bins):
            size = len(model.tables[j])
            if size < 2:
                continue
            g, h = slopes()
            step = RATE * _tree(np.bincount(at, g, size), np.bincount(at, h, size), np.bincount(at, minlength=size))
            model.tables[j] += step
            z += step[at]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.coarse)]
    shapes = [len(c) + 1 for c in model.coarse]

    def grid(i: int, j: int):
        g, h = slopes()
        at, size = coarse[i] * shapes[j] + coarse[j], shapes[i] * shapes[j]
        return at, [v.reshape(shapes[i], shapes[j]) for v in (np.bincount(at, g, size), np.bincount(at, h, size), np.bincount(at, minlength=size))]

    rated = sorted(((-_quadrants(*grid(i, j)[1])[0], i, j) for i, j in combinations(range(len(cuts)), 2)))
    model.pairs = [(i, j) for gain, i, j in rated[:n_pairs] if gain < -1e-9]
    model.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for k, (i, j) in enumerate(model.pairs):
            at, sums = grid(i, j)
            step = RATE * _quadrants(*sums)[1]
            model.pair_tables[k] += step
            z += step.ravel()[at]
    return model


def _crc_mod_5(c: Column) -> Column:
    return F.crc32(c.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned; a null doc_id is held out."""
    return F.coalesce(_crc_mod_5(doc_id) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_rows`` labelled rows that are not held out, those of least hash first.

    Ids with contradictory labels and without a label are left out. The rows chosen do not depend on the partitions.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_y2"))
    known = known.where("_y = _y2").select(F.col("doc_id").alias("_id"), "_y")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most max_rows ids
    # Of the copies of an id only the first counts, so that the sample stays bounded before its texts are measured.
    rows = rows.groupBy("_id", "_y").agg(F.min("text").alias("text"))
    got = rows.select("_id", "_y", _features_column()(text_or_empty()).alias("x")).orderBy("_id").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return x, got["_y"].to_numpy()


def _features_column():
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        x = measured([t.as_py() for t in texts])
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))

    return run


def _score_column(model) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.score(measured([t.as_py() for t in texts])))

    return run(text_or_empty())


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; null and empty texts are scored as texts without words.

    Only the text enters a score. Repeated rows get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _score_column(sent).alias("score"))
    return df.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def train_and_classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    return classify(docs, fit(*training_rows(docs, labels, max_rows)))


def crc_mod_5(doc_id: int) -> int:
    """The same remainder in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5
