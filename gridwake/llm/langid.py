"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of one to three characters of lower-case words, with word
edges as a character of their own, by falling count. A document's profile is compared with that of each
language: each of its n-grams adds how far its rank is out of place, or the profile's length if the
language lacks it. The least distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import in_small_batches

#: N-grams in a profile, and the prediction for texts without a letter.
LENGTH, UNKNOWN = 300, "und"
_BITS = 21


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: 21 bits a character, 1 for a word's edge. Empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 1)
    points = np.concatenate(([1], points, [1]))
    points = points[np.r_[True, (points[1:] != 1) | (points[:-1] != 1)]]
    if len(points) < 3:
        return np.empty(0, np.int64)
    one = points[points != 1]
    two = points[:-1] << _BITS | points[1:]
    three = (two[:-1] << _BITS | points[2:])[points[1:-1] != 1]
    return np.concatenate((one, two, three))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]) if len(codes) else np.zeros(1, np.int64)
    return codes[edges[:-1]], np.diff(edges)


def top(codes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent codes; the smaller code first where counts are equal."""
    codes, n = counted(codes)
    return codes[np.argsort(-n.astype(np.int32 if len(n) and n.max() > 32767 else np.int16), kind="stable")[:length]]


class Profiles(NamedTuple):
    """Known n-grams in order, and each one's rank in each language (the profile length where it is missing)."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    length: int

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much nearer it is than the second, 0 to 1 (1 with one language)."""
        own = top(ngrams(text or ""), self.length)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        place = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[place] == own
        ranks = self.ranks[:, place]
        distance = np.where(known & (ranks < self.length), np.abs(ranks - np.arange(len(own))), self.length).sum(1)
        best, second = (*np.sort(distance)[:2], np.inf)[:2]
        return self.languages[int(np.argmin(distance))], float(1 - best / second) if second else 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each language in a task, added up every few thousand documents."""
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found.setdefault(lang, []).append(ngrams(text or ""))
            if sum(map(len, found[lang])) > 1 << 20:
                totals[lang] = _add(totals.get(lang), found.pop(lang))
        for lang, codes in found.items():
            totals[lang] = _add(totals.get(lang), codes)
        for lang, (codes, n) in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})


def _add(total: tuple[np.ndarray, np.ndarray] | None, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = counted(np.concatenate(parts))
    if total is None:
        return codes, n
    both, back = np.unique(np.concatenate((total[0], codes)), return_inverse=True)
    return both, np.bincount(back, np.concatenate((total[1], n))).astype(np.int64)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", length: int = LENGTH) -> Profiles:
    """Profiles of all languages in ``lang_col``, from every row where it isn't null.

    Counts are added up on the cluster; ``length`` rows for each language come to the driver.
    """
    rows = in_small_batches(docs).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1).where(F.col("rank") < length)
    table = best.select("lang", "code", "rank").toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    codes = np.unique(table["code"].to_numpy(np.int64))
    ranks = np.full((len(languages), len(codes)), length, np.int64)
    ranks[[languages.index(x) for x in table["lang"]], np.searchsorted(codes, table["code"].to_numpy(np.int64))] = table["rank"].to_numpy()
    return Profiles(languages, codes, ranks, length)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", others: dict[str, str | Column] | None = None) -> DataFrame:
    """``others`` (new name: column), ``lang_pred`` and ``score`` of each row's whole text.

    A null text, or one without a letter, gives ``und`` and 0; so does every text if nothing was learned.
    Equal distances go to the first language by name. Rows are independent; an empty table gives an empty one.
    """
    rows = in_small_batches(docs).select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (others or {}).items()], F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(text) for text in batch["text"].to_pylist()]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema], "lang_pred string, score double"]))
