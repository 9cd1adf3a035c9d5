"""Dealing documents into blocks, and asking all other blocks about a block's hashes.

A block is a set of rows that is fixed by their ids and texts (by their places where the id is null), so a
task that is run again sees the same rows. Blocks talk through buckets of the hash space: each block sends the distinct hashes
that it has in a bucket as one sorted array, and gets one bit for each hash back in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of a block and bytes of their texts, on average, so that a block fits into a small task.
BLOCK_ROWS, BLOCK_BYTES = 2000, 8_000_000


def block_count(docs: DataFrame, text: str, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> int:
    """As many blocks as give ``rows`` documents or ``size`` bytes each on average, whichever is less."""
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    return max(1, -(-n // rows), -(-(total or 0) // size))


def block_of(key: Column, text: Column, n: int) -> Column:
    """The block of a row, by its id and text; rows without an id go by their place, so that any number of them is dealt out."""
    by_place = F.xxhash64(F.monotonically_increasing_id(), F.lit("block"))
    return F.pmod(F.when(key.isNull(), by_place).otherwise(F.xxhash64(key, text)), F.lit(n)).cast("int")


def bucket_bits(n_blocks: int) -> int:
    """Leading hash bits that choose the bucket: about half as many buckets as blocks."""
    return max(2, int(n_blocks - 1).bit_length() - 1)


def by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Bucket and range of each bucket that sorted distinct hashes fall into."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), int(a), int(b)


def distinct(hashes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes with the least and the greatest value of each."""
    if not len(hashes):
        return hashes, value, value
    order = np.lexsort((value, hashes))
    hashes, value = hashes[order], value[order]
    last = np.flatnonzero(np.r_[hashes[1:] != hashes[:-1], True])
    first = np.r_[0, last[:-1] + 1]
    return hashes[first], value[first], value[last]


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def numbers(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(data, kind)
