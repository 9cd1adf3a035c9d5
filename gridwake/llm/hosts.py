"""Quality rules of documents, judged by host.

Rules fail single documents. Their failures are counted by host, each host's rate is shrunk towards
the rate of all hosts with a beta prior that is fitted to the hosts' own rates, and a host whose shrunk
rate passes a limit loses all its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches
from .text import Words, buffers, covered, find_words, mix, slices, span_hashes, starts_of, windows

#: Words of a repeated window, words of a document at least, and repeated words in 100 at most.
REPEAT, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A host goes if it is expected to fail more than this share of its documents.
MOST_FAILED = 0.5
#: Rejected hosts in a broadcast at most; beyond, they are joined by a shuffle.
MOST_BROADCAST = 100_000

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeats(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value occurs again in its document, and whether it occurred before; values in order of place."""
    value = mix(value + mix(doc.astype(np.uint64)))
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    any_, before = np.zeros(len(value), bool), np.zeros(len(value), bool)
    any_[order[1:][same]] = any_[order[:-1][same]] = before[order[1:][same]] = True
    return any_, before


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[edges[1:]] - total[edges[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five statistics of the documents that ``offsets`` cuts ``data`` into."""
    offsets = offsets - offsets[0]
    words = find_words(data, offsets)
    chars = (data & 0xC0) != 0x80
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    hashes = span_hashes(data, words.start, words.end)
    at, doc = starts_of(words.first, REPEAT)
    again, _ = repeats(windows(hashes, REPEAT)[at], doc)
    return [np.diff(words.first), _sums(chars & ~space, offsets), _sums(_SYMBOLS[data], offsets), _dup_lines(data, offsets, words), _sums(covered(at[again], REPEAT, len(hashes)), words.first)]


def _dup_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1], breaks + 1)
    start = start[start < len(data)]
    end = np.minimum(np.r_[start[1:], len(data)], len(data)) if len(start) else start
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[filled], end[filled]
    doc = np.searchsorted(offsets, start, "right") - 1
    _, before = repeats(span_hashes(data, start, end), doc)
    return np.bincount(doc[before], minlength=len(offsets) - 1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATISTICS.split(", ")]
    for batch in batches:
        data, offsets = buffers(batch["text"])
        found = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1]) for a, b in slices(offsets)]
        whole = [np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * len(names)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in whole]], [*batch.schema.names, *names])


def failed() -> Column:
    """The base rule on a row of statistics."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measured(docs: DataFrame, text_col: str = "text", others: dict[str, str] | None = None) -> DataFrame:
    """``others`` (new name: column), ``text`` and the statistics of each row's whole text; a null text has no words."""
    rows = in_small_batches(docs).select(*[F.col(c).alias(n) for n, c in (others or {}).items()], F.col(text_col).alias("text"))
    return rows.mapInArrow(_measure, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + STATISTICS)


class Prior(NamedTuple):
    alpha: float
    beta: float


def prior(hosts: DataFrame) -> Prior:
    """A beta prior with the mean and the variance of the hosts' failure rates, by moments.

    The variance that sampling itself gives is taken off; hosts that do not differ beyond it, or a single
    host, give a prior as heavy as all their documents, so each one's rate is that of all.
    """
    rate = F.col("fails") / F.col("n")
    mean, var, noise, total = hosts.agg(F.sum("fails") / F.sum("n"), F.var_pop(rate), F.avg(1 / F.col("n")), F.sum("n")).first()
    if mean is None or not 0 < mean < 1:
        return Prior(0.5, 0.5)
    spread = (var or 0.0) - mean * (1 - mean) * noise
    weight = max(mean * (1 - mean) / spread - 1, 1.0) if spread > 0 else float(total)
    weight = min(weight, float(total))
    return Prior(mean * weight, (1 - mean) * weight)


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", others: dict[str, str] | None = None) -> DataFrame:
    """``others``, ``host``, ``text``, the statistics, ``base_failed`` and ``kept`` of each row.

    A null host is a host of its own. Every row counts, so repeated ids need no care; an empty table
    gives an empty one. ``docs`` may have columns of any other name.
    """
    rows = measured(docs, text_col, {**(others or {}), "host": host_col}).withColumn("base_failed", failed())
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails")).checkpoint()
    p = prior(hosts)
    bad = hosts.where((F.col("fails") + p.alpha) / (F.col("n") + p.alpha + p.beta) > MOST_FAILED).select(F.col("host").alias("bad_host"), F.lit(True).alias("host_failed"))
    bad = F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad
    return rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").withColumn("kept", ~F.col("base_failed") & F.col("host_failed").isNull()).drop("bad_host", "host_failed")
