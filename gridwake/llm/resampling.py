"""Importance resampling towards a target distribution by hashed word n-grams.

Features are the runs of one and two consecutive words; a feature's bucket is the CRC of its bytes modulo BUCKETS.
A bucket's gain compares how often the target's features fall into it with how often those of all documents do; a
document's weight is the mean gain of its features. Weights with Gumbel noise, drawn from the document's id, rank
the documents, and the first share of those with words enough is drawn.

Words and CRCs are found on whole Arrow buffers: a table classifies each byte, words begin and end where the class
changes, and the registers of all words (of all pairs, which go on from the first word's register) advance together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import advanced, finished, lowered, registers, spans, stepped
from .shared import in_small_batches, stored
from .text import buffers, slices

BUCKETS, SEED = 10_000, 7
#: Words of a document that may be drawn, and the share of these that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 25
#: Scores of one band. A gain has at most ln(2^63 * 2^63) as its logarithm and the noise is bounded by the 32 bits of
#: its draw, so there are under 400,000 different scores, in under 1,600 bands, however many documents there are.
BAND = 256

#: Bytes of words: digits, a-z and all of longer characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: buckets of single words in order, of each word with the one after it, and each document's first word."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets):
        own, edge = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        start, end, first = spans(WORD[own], edge)
        one = advanced(registers(len(start)), own, start, end)
        two = advanced(stepped(one[:-1], 32), own, start[1:], end[1:])
        yield finished(one) % np.uint32(BUCKETS), finished(two) % np.uint32(BUCKETS), first


def _inner(first: np.ndarray, n: int) -> np.ndarray:
    """Which pairs of neighbouring words lie in one document."""
    inside = np.ones(max(n - 1, 0), bool)
    cut = first[1:-1]
    inside[cut[(cut > 0) & (cut < n)] - 1] = False
    return inside


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket`` and ``n``, the features of all texts that fall into it; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for one, two, first in _features(batch["text"]):
                total += np.bincount(one, minlength=BUCKETS) + np.bincount(two[_inner(first, len(one))], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    return in_small_batches(texts).select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """The gain of each bucket: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), from BUCKETS sums of each side."""
    s, t = (np.zeros(BUCKETS, np.int64) for _ in range(2))
    for counts, side in ((bucket_counts(docs, text_col), s), (bucket_counts(target, text_col), t)):
        for bucket, n in counts.collect():  # BUCKETS rows at most
            side[bucket] = n
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (all_s + BUCKETS) / ((x + 1.0) * (all_t + BUCKETS)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(key: str) -> int:
    """floor of 1000 Gumbel draws that the id and the seed fix."""
    h = int(hashlib.sha256(f"{SEED}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigher(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for one, two, first in _features(batch["text"]):
                n = np.diff(first)
                pair = np.zeros(len(one) + 1, np.int64)
                pair[1 : len(two) + 1] = np.where(_inner(first, len(one)), gain[two], 0)
                sums = np.r_[0, np.cumsum(np.r_[gain[one], 0] + pair)]  # a pair counts at its second word
                total, count = sums[first[1:]] - sums[first[:-1]], n + np.maximum(n - 1, 0)
                words.append(n)
                features.append(count)
                weights.append(np.floor_divide(total, np.maximum(count, 1)))
            columns = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (words, features, weights)]
            drawn = np.array([noise(k or "") for k in batch["key"].to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_words": columns[0], "n_features": columns[1], "weight": columns[2], "score": columns[2] + drawn})

    return run


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null for what isn't drawn) of every row of ``docs``.

    A null or wordless text has no features, weight 0, and is never drawn. A null id draws as an empty one. Rows that
    share an id share its noise; each counts as a row, and rows equal in score and id are ranked by features, then
    weight (equal rows by chance). Without documents the result is empty; a target without features has equal gains of
    all buckets that no document uses. Columns other than id and text are not read.
    """
    weigh = _weigher(gains(docs, target, text_col))
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    scored = stored(rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    return _ranked(scored, F.col("n_words") >= least_words, percent)


def _ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` with the rank of the first ``percent`` of the eligible rows by score, then id.

    Rows are counted by score; sums over the counts say how many rows are above a score, so only rows of one score
    are put in order together. The noise spreads ids over thousands of scores, however alike the weights are.
    """
    counts = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("score") / BAND))
    bands = counts.groupBy("band").agg(F.sum("n").alias("n"))
    whole = bands.agg(F.sum("n")).first()[0] or 0
    draw = percent * whole // 100
    above_band = bands.select("band", (F.sum("n").over(Window.orderBy(F.desc("band"))) - F.col("n")).alias("above_band"))
    within = F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("score"))) - F.col("n")
    above = counts.withColumn("within", within).join(F.broadcast(above_band), "band").select("score", (F.col("above_band") + F.col("within")).alias("above")).where(F.col("above") < draw)
    above = stored(above, "above")
    lowest = above.agg(F.min("score")).first()[0]
    reaches = eligible & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")) + F.col("above")
    first = scored.where(reaches).join(F.broadcast(above), "score").withColumn("place", place)
    first = first.select(*scored.columns, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    return first.unionByName(scored.where(~F.coalesce(reaches, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
