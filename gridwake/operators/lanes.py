"""Packing intervals into lanes for display."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


def assign(starts: list, ends: list, most: int) -> list[int]:
    """First lane that is free; a new one up to ``most``; then that which frees first. Intervals come in order of start."""
    free_at: list = []
    out = []
    for a, z in zip(starts, ends, strict=True):
        lane = next((i for i, end in enumerate(free_at) if end < a), None)
        if lane is None and len(free_at) < most:
            lane = len(free_at)
            free_at.append(z)
        elif lane is None:
            lane = heapq.nsmallest(1, range(len(free_at)), key=lambda i: free_at[i])[0]
        free_at[lane] = max(free_at[lane], z)
        out.append(lane)
    return out


def pack_lanes(df: DataFrame, key: str, start: str, end: str, ties: list[str], most: int = 6) -> DataFrame:
    """``df`` with ``lane``, from each key's intervals in order; one key's intervals are one task's group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([start, end, *ties])
        return rows.assign(lane=assign(rows[start].tolist(), rows[end].tolist(), most))

    return df.groupBy(key).applyInPandas(run, df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", lane int")
