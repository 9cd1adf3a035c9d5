"""Vectorised helpers on Arrow text columns, used inside tasks.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D. In UTF-8 those six
are single bytes that occur in no other character, so words can be found on the raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time; one longer document is one slice.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: near inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, n of each."""
    if len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Words(NamedTuple):
    """Words of a run of documents: byte spans in ``data``, and ``first[i]:first[i+1]`` are document i's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        """Document i's words joined by one space."""
        return self.join(np.arange(self.first[i], self.first[i + 1]))

    def join(self, index: np.ndarray) -> bytes:
        data = self.data
        return b" ".join([data[a:b].tobytes() for a, b in zip(self.start[index].tolist(), self.end[index].tolist(), strict=True)])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = offsets[0] if len(offsets) else 0
    return data[low : offsets[-1]] if len(offsets) else data[:0], offsets - low


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes; no document is cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) < 5)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the documents that ``offsets`` cuts ``data`` into."""
    offsets = offsets - offsets[0]
    word = ~is_space(data)
    before = np.empty(len(word), bool)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
        inner = offsets[:-1][offsets[:-1] < len(word)]
        before[inner] = False
        start = np.flatnonzero(word & ~before)
        after = np.empty(len(word), bool)
        after[-1] = False
        after[:-1] = word[1:] & before[1:]
        end = np.flatnonzero(word & ~after) + 1
    else:
        start = end = np.empty(0, np.int64)
    return Words(data, start, end, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes in every slice and task."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive items, one for each start from 0 to n - k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += hashes[j : j + n]
    return mix(out)


def starts_of(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of k words that lie in one document, and each one's document."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc], doc


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of ``starts``."""
    if not len(starts):
        return np.zeros(n, bool)
    edges = np.bincount(starts, minlength=n + k + 1) - np.bincount(np.asarray(starts) + k, minlength=n + k + 1)
    return np.cumsum(edges)[:n] > 0


def by_slice(texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """First document, words and word hashes of each slice of a text column."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets):
        words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
        yield a, words, span_hashes(words.data, words.start, words.end)
