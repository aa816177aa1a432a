"""Vectorised word and window hashing over Arrow text batches (used inside Spark tasks).

A *word* is a run of bytes outside ``\\x20 \\x09-\\x0D``; in UTF-8 those bytes never occur inside a longer
character, so whole batches are cut on bytes. All hashes are 64-bit polynomial sums, finished with an
avalanche step; two independent hashes are combined where an identity must hold at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 2 << 20  # text held as numpy columns at a time; a longer text is a chunk of its own
LONG_WORD = 512  # bytes from which a word is hashed by xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche a uint64 array (a new array)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


@dataclass
class Words:
    """Words of a chunk of texts: byte ranges, the text each belongs to, and the first word of each text."""

    buf: np.ndarray
    offsets: np.ndarray  # byte offset of each text, one more than there are texts
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than there are texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    offsets = text_bytes(column)[1]
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def cut_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buf)
    space = _SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
        before |= edge[:-1]
        after |= edge[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buf, offsets, start, end, doc, first)


def word_hashes(words: Words) -> np.ndarray:
    """One hash per word; equal words, equal hashes."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    lengths = words.end - words.start
    lo = int(words.start[0])
    body = words.buf[lo : int(words.end[-1])]
    spans = np.diff(np.append(words.start, words.end[-1]))
    inside = np.arange(len(body)) - np.repeat(words.start - lo, spans)
    # bytes between words are spaces, whose value is nought
    np.minimum(inside, LONG_WORD, out=inside)
    values = _BYTE[body] * powers(_MULT, LONG_WORD + 1)[inside]
    h = np.add.reduceat(values, words.start - lo) + lengths.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for i in np.flatnonzero(lengths >= LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(words.buf[words.start[i] : words.end[i]].tobytes(), 11)
    return mix(h)


class Prefix:
    """Hash of any run of consecutive words, from prefix sums over the word hashes."""

    def __init__(self, h: np.ndarray):
        self.inverse = powers(_STEP_INVERSE, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_STEP, len(h) + 1)[: len(h)], dtype=np.uint64, out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each position on (positions that have so many words after them)."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)
