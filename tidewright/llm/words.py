"""Words of text batches as flat arrays of 64-bit hashes, computed on the UTF-8 bytes without an object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

BLOCK = 1 << 20  # bytes hashed at once
LONG_WORD = 1 << 12  # longer words are hashed one by one
CHUNK = 1 << 21  # bytes of the texts handled together
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
# A random factor for each place, so that no pattern of two letters cancels as it would in a polynomial modulo 2^64.
PLACE = mix(np.arange(1, LONG_WORD + 2, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(1))

# Which bytes belong to words. All bytes of a character beyond ASCII do, in both kinds.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def spans(buffer: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = kind[buffer]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: a sum of scrambled letters times a factor of their place, for very long words a byte hash."""
    out = np.empty(len(starts), np.uint64)
    long = ends - starts > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]].tobytes())
    rest = np.flatnonzero(~long)
    size = (ends - starts)[rest]
    upto = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(rest):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK)) - 1)
        own, n = rest[at:stop], size[at:stop]
        begin = upto[at:stop] - upto[at]
        place = np.arange(upto[stop] - upto[at]) - np.repeat(begin, n)
        terms = LETTER[buffer[np.repeat(starts[own], n) + place]] * PLACE[place]
        out[own] = mix(np.add.reduceat(terms, begin) + n.astype(np.uint64))
        at = stop
    return out


class Batch:
    """Some texts with their words: ``h[first[d]:first[d + 1]]`` are the hashes of text d."""

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        data = b"\n".join(texts)  # the separator belongs to no word
        self.buffer = np.frombuffer(data, np.uint8)
        self.starts, self.ends = spans(self.buffer, kind)
        self.h = hashes(self.buffer, self.starts, self.ends)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begin)
        self.data = data

    def left(self) -> np.ndarray:
        """For each word the number of words from it to the end of its text."""
        n = np.diff(self.first)
        return np.repeat(self.first[1:], n) - np.arange(self.first[-1])

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; meaningless where fewer are left."""
    out = h.copy()
    for j in range(1, k):
        out[: len(h) - j] += h[j:] * (PLACE[j] | np.uint64(1))
    return mix(out + np.uint64(k))


def batches(texts: list[str | None], lower: bool) -> Iterator[list[bytes]]:
    """Consecutive texts as UTF-8, about CHUNK bytes together; a longer text comes alone. Null is empty."""
    part, size = [], 0
    for t in texts:
        data = (t or "").encode()
        if part and size + len(data) > CHUNK:
            yield part
            part, size = [], 0
        part.append(data.lower() if lower else data)  # lowers A to Z only
        size += len(data)
    if part:
        yield part
