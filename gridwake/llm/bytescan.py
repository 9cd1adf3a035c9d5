"""A byte automaton over whole Arrow buffers: classes by table, borders by differences, CRCs of all spans at once."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Spans beyond so many bytes get their CRC one by one, so the steps of a slice don't grow with its longest span.
LONG = 256


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z made small; all others, those of longer characters too, stay."""
    return LOWER[data]


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set bytes within the documents that ``offsets`` cut, and each document's first run."""
    inside = np.zeros(len(word) + 2, np.int8)
    inside[1:-1] = word
    step = np.diff(inside)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(word))]
    cut = cut[word[cut] & word[cut - 1]]  # a run that goes on over a border is two
    start = np.flatnonzero(step == 1)
    end = np.flatnonzero(step == -1)
    if len(cut):
        start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
    return start, end, np.searchsorted(start, offsets)


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each span, from the given ones: one step of the table for all spans that go on."""
    size = end - start
    order = np.argsort((LONG + 1 - np.minimum(size, LONG + 1)).astype(np.uint16), kind="stable")
    many = int(np.count_nonzero(size > LONG))  # these come first
    size, at, out = size[order], start[order], state[order].copy()
    for i in range(many):
        out[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(out[i] ^ _ALL)) ^ int(_ALL)
    at, size, rest = at[many:], size[many:], out[many:]
    left = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else ()
    for i, n in enumerate(left):
        now = rest[:n]
        rest[:n] = CRC[(now ^ data[at[:n] + i]) & np.uint32(255)] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def stepped(state: np.ndarray, byte: int) -> np.ndarray:
    """CRC registers after one more byte, the same for all."""
    return CRC[(state ^ np.uint32(byte)) & np.uint32(255)] ^ (state >> np.uint32(8))


def registers(n: int) -> np.ndarray:
    """CRC registers before the first byte."""
    return np.full(n, _ALL, np.uint32)


def finished(state: np.ndarray) -> np.ndarray:
    """The CRCs that registers stand for, unsigned."""
    return state ^ _ALL


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each span as a string column."""
    size = end - start
    until = np.r_[0, np.cumsum(size)]
    source = np.arange(until[-1]) + np.repeat(start - until[:-1], size)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(until.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[source])))
