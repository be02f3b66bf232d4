"""Byte-level BPE as a bounded-lookahead streaming transducer, and the incremental decoder.

The transducer reads a text in chunks and holds back only what later characters could still change:

* the last pretoken seen, and its neighbours within three characters (a contraction could still be completed);
* inside a pretoken longer than a buffer, the last ``lookahead`` bytes. Tokens that end earlier are stable.

``lookahead`` is computed from the merge list. Two texts that agree on their first n bytes start with the same
segmentation up to n. A merge (u, v) of rank k can only move that common boundary left, by the bytes of u, and a later merge
(u', v') can move it again only if u lies on the left spine of v'. The longest such chain, summed over the bytes of
its left parts, bounds how far the end of a text is felt. The argument needs a merge list in which both parts of every merge
are made by earlier merges or are single bytes; the constructor checks it.

Decoding is a byte-to-text state machine: an incomplete UTF-8 sequence waits for its next bytes, an invalid one gives U+FFFD.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 18  # characters fed at once
LONG = 1 << 12  # characters or bytes of an unfinished pretoken from which on it is streamed
KEPT_PIECES = 250_000  # pretokens whose ids a worker remembers, twice
NONE = 1 << 62

# Fixed value: the pattern by which byte-level BPE splits a text before merging.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same pattern with its classes spelt out for texts up to U+024F, where it runs twice as fast.
LETTERS, NUMBERS, BLANKS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\x09-\x0d \x85\xa0"
NARROW = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
WIDE = re.compile(r"[^\x00-\u024f]")
SPACES = regex.compile(r"\s*")
RUNS = [regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), SPACES, regex.compile(r"[^\s\p{L}\p{N}]*")]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a vocabulary file: itself, or the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """Vocabulary, merge ranks and lookahead of one tokenizer file; ``lookahead`` may be raised in tests."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = {c: bytes([b]) for b, c in byte_letters().items()}
        raw = lambda token: b"".join(letter[c] for c in token)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.merge = {(vocab[a], vocab[b]): k << 24 | vocab[a + b] for k, (a, b) in enumerate(pairs)}
        self.lookahead = sufficient_lookahead(pairs)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Pieces(self)

    def segment(self, data: bytes) -> list[int]:
        """Token ids of one pretoken: the merge of lowest rank first, the leftmost among equals."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._segment_long(ids)
        find, none = self.merge.get, NONE
        ranks = [find(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), none)
        return ids

    def _segment_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []  # rank with new id, place, and the pair it was offered for

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := self.merge.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (m, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m & 0xFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class Pieces(dict):
    """Packed ids of whole pretokens. Two generations bound its size: what is still in use moves to the young one."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, text: str) -> bytes:
        if (found := self.old.get(text)) is None:
            found = array("i", self.bpe.segment(text.encode())).tobytes()
        if len(text) <= 64:
            if len(self) >= KEPT_PIECES:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes from the end of a text within which its continuation can still change the tokens (see the module's text)."""
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    most = 0
    for a, b in merges:
        if any(len(x) > 1 and x not in left for x in (a, b)) or a + b in left:
            raise ValueError("the merge list is not ordered by construction")
        x, far = b, 0
        while x is not None:
            far, x = max(far, reach.get(x, 0)), left.get(x)
        reach[a] = max(reach.get(a, 0), far + len(a))
        most = max(most, reach[a])
        left[a + b] = a
    return most


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class Encoder:
    """Feeds on chunks of one text and gives packed ids as soon as they are stable."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.tail = ""  # could begin a special token
        self.pending = ""  # unfinished pretokens
        self.run = None  # pattern of the long pretoken that is being streamed
        self.buffer = bytearray()  # its bytes whose tokens are not stable yet

    def feed(self, text: str, last: bool = False) -> bytes:
        out: list[bytes] = []
        data, self.tail = self.tail + text, ""
        parts = self.bpe.splitter.split(data) if self.bpe.splitter else [data]
        for i, part in enumerate(parts[:-1]):
            if i % 2:
                out.append(np.int32(self.bpe.special[part]).tobytes())
            else:
                self._read(part, True, out)
        rest = parts[-1]
        if not last:
            held = max((k for s in self.bpe.special for k in range(1, len(s)) if rest.endswith(s[:k])), default=0)
            rest, self.tail = rest[: len(rest) - held], rest[len(rest) - held :]
        self._read(rest, last, out)
        return b"".join(out)

    def _read(self, text: str, end: bool, out: list[bytes]) -> None:
        data, self.pending = self.pending + text, ""
        at = 0
        if self.run is not None:
            at = self.run.match(data).end()
            inside = at == len(data)
            if self.run is SPACES and at and not (inside and end):
                at -= 1  # the last one may belong to the next pretoken
            self._stream(data[:at], out, done=not inside or end)
            if inside and not end:
                self.pending = data[at:]
                return
            self.run = None
        pieces = (PRETOKEN if WIDE.search(data, at) else NARROW).findall(data, at)
        held = ""
        if not end:
            while pieces and len(held) < 3:
                held = pieces.pop() + held
        out.extend(map(self.bpe.pieces.__getitem__, pieces))
        if len(held) > LONG:
            self.run = next(r for r in RUNS if r.match(held, 1).end() == len(held)) if any(r.match(held, 1).end() == len(held) for r in RUNS) else None
            if self.run is not None:
                cut = len(held) - (self.run is SPACES)
                self._stream(held[:cut], out)
                held = held[cut:]
        self.pending = held

    def _stream(self, text: str, out: list[bytes], done: bool = False) -> None:
        for at in range(0, max(len(text), 1), LONG):
            self.buffer += text[at : at + LONG].encode()
            if len(self.buffer) > 2 * (self.bpe.lookahead + LONG):
                self._emit(len(self.buffer) - self.bpe.lookahead, out)
        if done:
            self._emit(len(self.buffer), out)

    def _emit(self, stable: int, out: list[bytes]) -> None:
        ids, used = [], 0
        for i in self.bpe.segment(bytes(self.buffer)):
            if (size := len(self.bpe.bytes_of[i])) + used > stable:
                break
            ids.append(i)
            used += size
        out.append(np.asarray(ids, np.int32).tobytes())
        del self.buffer[:used]


def encode_text(bpe: ByteBpe, text: str | None, chunk: int = CHUNK) -> np.ndarray:
    """All ids of one text; null counts as empty."""
    encoder, text = Encoder(bpe), text or ""
    parts = [encoder.feed(text[i : i + chunk], last=i + chunk >= len(text)) for i in range(0, max(len(text), 1), chunk)]
    return np.frombuffer(b"".join(parts), np.int32)


class Decoder:
    """Ids to text: bytes of a character that is not complete wait for the next ids."""

    def __init__(self, bpe: ByteBpe):
        self.bytes_of = bpe.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


def decode_ids(bpe: ByteBpe, ids: np.ndarray, chunk: int = CHUNK) -> str:
    decoder = Decoder(bpe)
    return "".join(decoder.feed(ids[i : i + chunk].tolist(), i + chunk >= len(ids)) for i in range(0, max(len(ids), 1), chunk))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """Add the array column ``out`` of token ids; null text gives an empty array. No shuffle; a column called ``out`` is replaced, all others stay."""
    return docs.withColumn(out, _encode_column(path, chunk)(F.col(f"`{text}`")))


def _encode_column(path: str, chunk: int):
    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        rows = [encode_text(bpe, t, chunk) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))

    return run


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", chunk: int = CHUNK) -> DataFrame:
    """Add the column ``out`` with the text of the ids; null ids give null. No shuffle; a column called ``out`` is replaced."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        bpe = load(path)
        ends, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        return pa.array([decode_ids(bpe, flat[a:b], chunk) if ok else None for a, b, ok in zip(ends, ends[1:], rows.is_valid().to_pylist())], pa.string())

    return df.withColumn(out, run(F.col(f"`{ids}`")))


def digest_of_ids(ids: str = "ids") -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
