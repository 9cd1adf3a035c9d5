"""Context-triggered piecewise hashing: fingerprints of whole texts that survive local edits.

A rolling hash of the last seven bytes marks chunk ends: at block size b wherever it is b - 1 modulo
b. Each chunk gives one character of a signature. Block sizes are 3 * 2^e, so the ends at 2b are
among those at b; a fingerprint holds the signatures at b and 2b and can be compared with
fingerprints at b / 2, b and 2b, by the edit distance of the signatures at a block size of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches
from .text import SLICE_BYTES, buffers, mix, slices, span_hashes

#: Bytes that the rolling hash sees, characters of a signature at most, and the least block size.
REACH, LENGTH, SMALLEST = 7, 64, 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Signatures without a common run of so many characters count as unlike.
COMMON = 5
#: Ranges of ids on the driver at most; each is sorted and streamed, so it may be of any size.
MOST_RANGES = 100_000

_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def fingerprints(texts: pa.Array) -> list[str]:
    """One fingerprint ``block_size:signature:signature_at_twice`` for each text; null is empty."""
    out: list[str] = []
    data, offsets = buffers(texts)
    for a, b in slices(offsets, SLICE_BYTES):
        out += _fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    size = np.diff(offsets)
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    rolling = np.zeros(len(data), np.uint64)
    for back in range(REACH):
        seen = np.zeros(len(data), np.uint64)
        seen[back:] = data[: max(len(data) - back, 0)]
        seen[inside < back] = 0
        rolling = rolling * np.uint64(0x100000001B3) + seen
    value = (mix(rolling) & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1
    ends = np.flatnonzero(value % SMALLEST == 0)
    value = value[ends] // SMALLEST
    level = np.log2(value & -value).astype(np.int64)
    first = np.searchsorted(ends, offsets)
    out = []
    for i, n in enumerate(size.tolist()):
        a, z = int(offsets[i]), int(offsets[i + 1])
        at, high = ends[first[i] : first[i + 1]] + 1, level[first[i] : first[i + 1]]
        e = max(0, int(np.ceil(np.log2(max(n, 1) / (SMALLEST * LENGTH)))))
        while e and np.count_nonzero(high >= e) + 1 < LENGTH // 2:
            e -= 1
        out.append((SMALLEST << e, _edges(at, high, e, LENGTH, a, z), _edges(at, high, e + 1, LENGTH // 2, a, z)))
    spans = [s for _, x, y in out for s in (x, y)]
    start, end = (np.concatenate([s[k] for s in spans]) if spans else np.empty(0, np.int64) for k in (0, 1))
    letters = _LETTERS[(span_hashes(data, start, end) & np.uint64(63)).astype(np.int64)].tobytes().decode()
    texts, at = [], 0
    for block, x, y in out:
        m, n = len(x[0]), len(y[0])
        texts.append(f"{block}:{letters[at : at + m]}:{letters[at + m : at + m + n]}")
        at += m + n
    return texts


def _edges(at: np.ndarray, high: np.ndarray, e: int, most: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of a document from a to z; the last one takes all that is left."""
    cut = at[high >= e][: most - 1]
    edges = np.concatenate(([a], cut, [z] if not len(cut) or cut[-1] < z else []))
    edges = edges.astype(np.int64)
    return (edges[:-1], edges[1:]) if z > a else (edges[:0], edges[:0])


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    for c in a:
        x = row & where.get(c, 0)
        row = ((row + x) | (row - x)) & full
    return len(b) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of two signatures that no insertion or deletion touches; the best common block size."""
    if a == b:
        return 1.0
    (p, *x), (q, *y) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    pairs = list(zip(x, y, strict=True)) if p == q else [(x[1], y[0])] if 2 * p == q else [(x[0], y[1])] if p == 2 * q else []
    return max((_like(s, t) for s, t in pairs), default=0.0)


def _like(s: str, t: str) -> float:
    k = min(COMMON, len(s), len(t))
    if not k or {s[i : i + k] for i in range(len(s) - k + 1)}.isdisjoint(t[i : i + k] for i in range(len(t) - k + 1)):
        return 0.0
    return 2 * common(s, t) / (len(s) + len(t))


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many first code points (or all) of the next one."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _bounds(ids: DataFrame, rows: int) -> list[int]:
    """First ids of the ranges, MOST_RANGES at most: ids that occur, about ``rows`` rows apart.

    Cuts come from approximate quantiles of doubles, which may lie beside the ids where these are over 2^53; one
    aggregation replaces each by the least id that isn't below it, so the bounds are exact at any size.
    """
    n, least = ids.agg(F.count("*"), F.min("id")).first()
    if not n:
        return []
    cuts = min(MOST_RANGES, n // rows)
    if cuts < 2:
        return [least]
    near = ids.select(F.col("id").cast("double").alias("at")).approxQuantile("at", [i / cuts for i in range(1, cuts)], min(0.001, 0.2 / cuts))
    near = sorted({min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in near})
    found = ids.select("id", _place(near).alias("place")).groupBy("place").agg(F.min("id").alias("id")).where("place >= 0").collect()
    return sorted({least, *(r["id"] for r in found)})


def _place(bounds: list[int]) -> Column:
    """How many of the sorted bounds an id isn't below, less one."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids, "right").astype(np.int32) - 1)

    return place(F.coalesce("id", F.lit(0)))  # a null would make all ids of its batch doubles


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000) -> DataFrame:
    """Fingerprint each text, its edited text and its successor in ascending id, and compare them.

    The ids are cut into ranges at some of their own values, so the first document of a range is known
    by its id: a copy of it closes the range before (and of the first range, the last one). A range is
    streamed in order; nothing else is held. Equal ids follow each other in the order of their texts.
    Rows with a null id have no place in the order: their next text is empty. A null text is empty.
    A single document is its own successor. An empty table gives an empty one.
    """
    key = F.col(id_col).cast("long")
    ids = docs.select(key.alias("id")).where("id is not null")
    bounds = _bounds(ids, rows)
    m = len(bounds)
    own = in_small_batches(docs).select(key.alias("id"), F.col(text_col).alias("text"))
    range_of = _place(bounds)
    own = own.withColumn("range", F.when(F.col("id").isNotNull(), range_of).otherwise(-1 - F.pmod(F.xxhash64("text"), F.lit(max(m, 1))).cast("int"))).withColumn("guard", F.lit(False))
    firsts = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in bounds], "id long"))
    guard = own.join(firsts, "id", "left_semi").withColumns({"range": F.pmod(F.col("range") - 1, F.lit(max(m, 1))).cast("int"), "guard": F.lit(True)})
    spread = own.unionByName(guard.select(*own.columns)).repartition("range").sortWithinPartitions("range", "guard", "id", "text")
    return spread.mapInArrow(_compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple | None = None
    for batch in batches:
        _, offsets = buffers(batch["text"])
        for a, b in slices(offsets, 4 * SLICE_BYTES):
            part = batch.slice(a, b - a)
            rows = list(zip(part["range"].to_pylist(), part["guard"].to_pylist(), part["id"].to_pylist(), part["text"].fill_null("").to_pylist(), fingerprints(part["text"]), strict=True))
            if last:
                rows.insert(0, last)
            last = rows.pop()
            yield _compared(rows, [*rows[1:], last])
    if last:
        yield _compared([last], [None])


def _compared(rows: list[tuple], following: list[tuple | None]) -> pa.RecordBatch:
    pairs = [(x, y if y and y[0] == x[0] and x[0] >= 0 else None) for x, y in zip(rows, following, strict=True) if not x[1]]
    texts = [edited(x[3], y[3] if y else "") for x, y in pairs]
    prints = fingerprints(pa.array(texts, pa.large_string()))
    return pa.RecordBatch.from_pydict({
        "id": pa.array([x[2] for x, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        "fingerprint": pa.array([x[4] for x, _ in pairs], pa.string()),
        "edited_fingerprint": pa.array(prints, pa.string()),
        "near_edited": pa.array([likeness(x[4], p) for (x, _), p in zip(pairs, prints, strict=True)], pa.float64()),
        "near_next": pa.array([likeness(x[4], y[4] if y else "3::") for x, y in pairs], pa.float64()),
    })
