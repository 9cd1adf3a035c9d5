"""Quality classification by compression.

Two zstandard dictionaries hold good and bad labelled texts. A text that is like the good ones compresses better
with the first. The difference of its two compressed sizes, normalised by the square root of its own size (by
which the difference of two unrelated dictionaries varies), is the one input of the score: a logistic curve,
fitted on labelled texts that are in neither dictionary, turns it into the probability of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches

#: Bytes of a dictionary, labelled texts of each label for the fit, and their bytes of text, at most.
DICTIONARY, ROWS, BYTES = 262_144, 1_500, 6_000_000
LEVEL = 6


class Classifier(NamedTuple):
    """Two dictionaries, and the slope and place of the logistic curve."""

    good: bytes
    bad: bytes
    slope: float
    place: float

    def scorer(self):
        """A function from a text to its score; build it once for many texts."""
        sizes = _sizer(self.good), _sizer(self.bad)
        return lambda text: float(_chance(self.slope * difference(sizes, text) + self.place))


def _sizer(dictionary: bytes):
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL).compress
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress


def difference(sizes, text: str | None) -> float:
    """How much smaller the text gets with the good dictionary than with the bad, over the root of its own size."""
    data = (text or "").encode("utf-8", "replace")
    return (len(sizes[1](data)) - len(sizes[0](data))) / math.sqrt(len(data) + 1)


def _chance(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _dictionaries(texts: dict[int, list[bytes]]) -> dict[int, bytes]:
    """Whole texts of each label in order, as long as they fit; both of one size, so neither has an advantage."""
    most = min(DICTIONARY, *(sum(map(len, found)) for found in texts.values()))
    built = {}
    for y, found in texts.items():
        parts, room = [], most
        for text in found:
            if len(text) <= room:
                parts.append(text)
                room -= len(text)
        built[y] = b"".join(parts)
    return built


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """Slope (0 at least, so the score never falls as the difference grows) and place by Newton's method."""
    both = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(2), penalty * np.eye(2)
    for _ in range(60):
        p = _chance(both @ w)
        step = np.linalg.solve(both.T @ (both * (p * (1 - p))[:, None]) + ridge, both.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))))


def _drawn(place: Column, counts: dict[int, int], most: int) -> Column:
    """About ``most`` rows of each label (all of one that has fewer), by the place of their hash; so a broadcast of them is bounded."""
    limits = {y: min(1.0, most / n) for y, n in counts.items()}
    share = F.pmod(place, F.lit(1 << 30)) / (1 << 30)
    return reduce(or_, [(F.col("y") == y) & (share < limit) for y, limit in limits.items()], F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS, size: int = BYTES) -> Classifier:
    """Learn from labelled rows of ``docs``: of each label at most ``rows`` texts and ``size`` bytes, in the order of a hash of the id.

    The sample is chosen by lengths alone, before any text leaves the cluster; then only its texts do, so what
    reaches the driver is bounded by both parameters. Two in three texts fill the dictionaries, the rest fits
    the score, which is corrected for the share of each label among all labelled rows. Null labels and texts are
    left out; of repeated ids the least label and the least text count. With fewer than three texts of a label
    every score is the share of label 1 (one half if there is none).
    """
    place = F.xxhash64("id")
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.min("y").alias("y"))
    all_counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pool = marked.withColumn("place", place).where(_drawn(place, all_counts, 4 * rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    lengths = texts.select("id", F.octet_length("text").alias("n")).join(F.broadcast(pool), "id").groupBy("y", "place", "id").agg(F.max("n").alias("n")).collect()
    chosen: dict[int, list[int]] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for row in sorted(lengths):
        y = row["y"]
        if len(chosen[y]) < rows and held[y] + row["n"] <= size:
            chosen[y].append(row["id"])
            held[y] += row["n"]
    share = (all_counts.get(1, 0) + 0.5) / (sum(all_counts.values()) + 1)
    if min(map(len, chosen.values())) < 3:
        return Classifier(b"", b"", 0.0, float(np.log(share / (1 - share))))
    wanted = docs.sparkSession.createDataFrame([(i,) for ids in chosen.values() for i in ids], "id long")
    found = {r["id"]: r["text"].encode("utf-8", "replace") for r in texts.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text")).toLocalIterator()}
    built = _dictionaries({y: [found[i] for k, i in enumerate(ids) if k % 3] for y, ids in chosen.items()})
    sizes = _sizer(built[1]), _sizer(built[0])
    tuned = [(difference(sizes, found[i].decode("utf-8", "replace")), y) for y, ids in chosen.items() for i in ids[::3]]
    x, y = (np.array(c, float) for c in zip(*tuned, strict=True))
    slope, at = _logistic(x, y)
    return Classifier(built[1], built[0], slope, at + float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))))


def scored(docs: DataFrame, model: Classifier, text_col: str = "text", others: dict[str, str | Column] | None = None) -> DataFrame:
    """``others`` (new name: column) and ``score`` of each row's whole text; null and empty texts are scored as empty.

    Rows are independent; repeated rows give equal scores, and an empty table gives an empty one.
    """
    rows = in_small_batches(docs).select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (others or {}).items()], F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array([score(t) for t in batch["text"].to_pylist()], pa.float64())], [*kept, "score"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema], "score double"]))
