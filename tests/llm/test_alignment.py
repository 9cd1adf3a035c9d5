"""The banded alignment of near-duplicates against a whole table, and its memory on very long texts."""

import random
import tracemalloc

import numpy as np

from gridwake.llm import omh


def _table(x, y, band):
    """Longest common subsequence by the whole table, of matches within the band."""
    last = [0] * (len(y) + 1)
    for i, a in enumerate(x):
        row = [0]
        for j, b in enumerate(y):
            row.append(max(last[j + 1], row[j], last[j] + 1 if a == b and abs(i - j) <= band else 0))
        last = row
    return last[-1]


def test_alignment_within_bands():
    draw = random.Random(1)
    for _ in range(800):
        k = draw.choice([2, 5, 50])
        x = [draw.randrange(k) for _ in range(draw.randrange(60))]
        y = [draw.randrange(k) for _ in range(draw.randrange(60))] if draw.random() < 0.5 else [c for c in x if draw.random() > 0.1] + [1] * draw.randrange(3)
        band = draw.randrange(70)
        assert omh._aligned(np.array(x, np.uint64), np.array(y, np.uint64), band) == _table(x, y, band)


def test_often_repeated_kmers():
    x, y = np.array([7] * 300 + [8], np.uint64), np.array([7] * 280, np.uint64)
    assert omh._aligned(x, y, 400) == 280 and omh._aligned(x, y, 10) == _table([7] * 300 + [8], [7] * 280, 10)


def test_very_long_near_texts_in_little_memory():
    """Two sequences that differ near both ends and between, so that nothing is cut off before the alignment."""
    n = 120_000
    x = np.random.default_rng(3).integers(0, 1 << 63, n, dtype=np.uint64)
    y = np.delete(x, np.r_[5, n - 5, np.arange(1000, n - 1000, 997)])
    tracemalloc.start()
    got = omh.similarity(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(y) / n and peak < 200 * n  # so a pair of 10 MB texts (1.7 million words) takes under 400 MB


def test_moved_halves_of_long_texts_are_not_near():
    x = np.random.default_rng(4).integers(0, 1 << 63, 40_000, dtype=np.uint64)
    assert omh.similarity(x, np.roll(x, 20_000)) < omh.NEAR
