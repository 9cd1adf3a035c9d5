"""Substring deduplication by difference-cover anchors.

A window of ``k`` words is a repeat if the same words also start in a document with a smaller id.
Only windows of ``k - V + 1`` words at the positions p with p mod V in a difference cover modulo V
are hashed at first: for any two positions some shift below V brings both onto the cover, so two
equal windows of k words share an aligned anchor. Anchors that one document alone has are dropped;
around the others the match is extended to whole windows of k words, whose hashes are compared
across all documents. With k = 13 and V = 7 the cover is {0, 1, 3}: three of seven positions.

Blocks of documents send their distinct hashes to buckets and get one bit a hash back, so neither a
passage that a third of all documents share nor a group of copies makes a large group anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, block_of, bucket_bits, by_bucket, distinct, numbers, pack, unpack
from .shared import in_small_batches
from .text import Words, by_slice, covered, starts_of, windows

#: A perfect difference cover: every residue modulo 7 is a difference of two of these.
V = 7
COVER = np.array([0, 1, 3])

_NO_ID = np.iinfo(np.int64).max
_ASK = "bucket int, block int, hashes binary, docs binary, more binary"
_TOLD = "bucket int, block int, bits binary"


def anchors(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, word position and document of each anchor of a slice."""
    at, doc = starts_of(words.first, k - V + 1)
    cover = np.isin((at - words.first[doc]) % V, COVER)
    at, doc = at[cover], doc[cover]
    return windows(hashes, k - V + 1)[at], at, doc


def extended(words: Words, hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and document of the windows of k words that hold one of the given anchors."""
    near = np.zeros(len(hashes) + 1, bool)
    for back in range(V):
        inside = at - back >= words.first[doc]
        near[(at - back)[inside]] = True
    start, doc = starts_of(words.first, k)
    keep = near[start]
    start, doc = start[keep], doc[keep]
    return windows(hashes, k)[start], start, doc


def _ids(table: pa.Table) -> np.ndarray:
    return table["id"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _asked(block: int, found: list, bits: int) -> pa.Table:
    """One row for each bucket: the block's distinct hashes, the least document and whether there are more."""
    hashes, low, high = distinct(*_all(found))
    rows = [(b, block, hashes[i:j].tobytes(), low[i:j].tobytes(), pack(high[i:j] > low[i:j])) for b, i, j in by_bucket(hashes, bits)]
    names = ("bucket", "block", "hashes", "docs", "more")
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[c] for r in rows], t) for c, (n, t) in enumerate(zip(names, kinds, strict=True))})


def _anchors_of(table: pa.Table, k: int, known: np.ndarray | None = None):
    """Each slice of a block with its anchors; with ``known`` only those whose hash is among these."""
    ids = _ids(table)
    for a, words, hashes in by_slice(table["text"]):
        value, at, doc = anchors(words, hashes, k)
        if known is not None:
            place = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
            keep = known[place] == value if len(known) else np.zeros(len(value), bool)
            value, at, doc = value[keep], at[keep], doc[keep]
        yield ids[a : a + len(words.first) - 1], words, hashes, value, at, doc


def _known(hashes: np.ndarray, told: pa.Table, bits: int) -> np.ndarray:
    """Those of a block's distinct hashes whose bit came back set."""
    answer = dict(zip(told["bucket"].to_pylist(), told["bits"].to_pylist(), strict=True))
    parts = [hashes[i:j][unpack(answer[b], j - i)] for b, i, j in by_bucket(hashes, bits) if b in answer]
    return np.concatenate(parts) if parts else hashes[:0]


def _all(found: list) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shared_windows(docs: pa.Table, told: pa.Table, k: int, bits: int):
    """Per slice: ids, words, hash, start and document of the windows that hold a shared anchor."""
    mine, _, _ = distinct(*_all([(v, ids[doc]) for ids, _, _, v, _, doc in _anchors_of(docs, k)]))
    known = _known(mine, told, bits)
    for ids, words, hashes, _, at, doc in _anchors_of(docs, k, known):
        yield (ids, words, *extended(words, hashes, at, doc, k))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, columns: tuple[str, ...] = (), blocks: int | None = None) -> DataFrame:
    """Remove the words of repeated windows from each document.

    Returns ``columns`` of ``docs``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined
    by one space) and ``kept_sha256``. Windows are judged on the input. Null or blank texts have no
    words and lose none; texts under k words lose none; rows with equal ids count as one document
    and never take words from each other; rows with a null id come after all others, as one document;
    an empty table gives an empty one. Columns of ``docs`` may have any names: only ``id_col``,
    ``text_col`` and ``columns`` are read.
    """
    if k <= V:
        raise ValueError(f"k must be over {V}")
    n = blocks or block_count(docs, text_col)
    bits = bucket_bits(n)
    kept_as = ["text" if c == text_col else f"x{i}" for i, c in enumerate(columns)]  # the text travels once
    keep = [F.col(c).alias(x) for c, x in zip(columns, kept_as, strict=True) if x != "text"]
    key, text = F.col(id_col).cast("long"), F.col(text_col)
    dealt = in_small_batches(docs).select(key.alias("id"), text.alias("text"), block_of(key, text, n).alias("block"), *keep)
    kinds = [dealt.schema[x].dataType.simpleString() for x in kept_as]

    def ask_anchors(key, table):
        return _asked(key[0].as_py(), [(v, ids[doc]) for ids, _, _, v, _, doc in _anchors_of(table, k)], bits)

    def tell_shared(key, table):
        """Set: another document has the hash, too."""
        parts = [numbers(x) for x in table["hashes"].to_pylist()]
        whole = np.sort(np.concatenate(parts))
        twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
        more = [unpack(x, len(p)) for x, p in zip(table["more"].to_pylist(), parts, strict=True)]
        return _answer(table, [m | np.isin(p, twice, assume_unique=True) for m, p in zip(more, parts, strict=True)])

    def ask_windows(key, table, told):
        return _asked(key[0].as_py(), [(v, ids[doc]) for ids, _, v, _, doc in _shared_windows(table, told, k, bits)], bits)

    def tell_earlier(key, table):
        """Set: a document that comes before all of this block's has the hash."""
        parts, lows = [numbers(x) for x in table["hashes"].to_pylist()], [numbers(x, np.int64) for x in table["docs"].to_pylist()]
        hashes, low, _ = distinct(np.concatenate(parts), np.concatenate(lows))
        return _answer(table, [low[np.searchsorted(hashes, p)] < d for p, d in zip(parts, lows, strict=True)])

    def finish(key, table, told):
        shared = told.filter(pc.equal(told["step"], 1))
        earlier = told.filter(pc.equal(told["step"], 2))
        found = list(_shared_windows(table, shared, k, bits))
        mine, low, _ = distinct(*_all([(v, ids[doc]) for ids, _, v, _, doc in found]))
        before = _known(mine, earlier, bits)
        total, removed, kept, digest = [], [], [], []
        for ids, words, value, start, doc in found:
            repeat = np.isin(value, before) | (low[np.searchsorted(mine, value)] < ids[doc]) if len(mine) else np.zeros(0, bool)
            gone = covered(start[repeat], k, len(words.start))
            lost = np.r_[0, np.cumsum(gone)]
            total.append(np.diff(words.first))
            removed.append(lost[words.first[1:]] - lost[words.first[:-1]])
            for i in range(len(ids)):
                index = np.arange(words.first[i], words.first[i + 1])
                kept.append(words.join(index[~gone[index]]))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
        whole = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        own = {f"x{i}": table[x] for i, x in enumerate(kept_as)}
        return pa.table(own | {"n_words": whole(total), "n_removed": whole(removed), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(digest, pa.string())})

    by_block = dealt.groupBy("block")
    shared = by_block.applyInArrow(ask_anchors, _ASK).drop("docs").groupBy("bucket").applyInArrow(tell_shared, _TOLD)
    windows_asked = by_block.cogroup(shared.groupBy("block")).applyInArrow(ask_windows, _ASK).drop("more")
    earlier = windows_asked.groupBy("bucket").applyInArrow(tell_earlier, _TOLD)
    told = shared.withColumn("step", F.lit(1)).unionByName(earlier.withColumn("step", F.lit(2)))
    schema = [f"x{i} {kind}" for i, kind in enumerate(kinds)] + ["n_words long", "n_removed long", "kept string", "kept_sha256 string"]
    out = by_block.cogroup(told.groupBy("block")).applyInArrow(finish, ", ".join(schema))
    return out.withColumnsRenamed({f"x{i}": c for i, c in enumerate(columns)})


def _answer(table: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    return pa.table({"bucket": table["bucket"], "block": table["block"], "bits": pa.array([pack(b) for b in bits], pa.binary())})
