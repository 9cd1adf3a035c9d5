"""Profiles from partial states: each shard of a table is summed up alone, and sums of shards merge to those of the whole.

A state is a table of long form: for each kind of thing (signal, rule, phase, source), its name and a slot (a bin, or -1
for the whole), the rows there (``n``) and the entities as bitmaps of 32,768 ids each (``bucket``, ``bits``). Rows of
parts add up, bitmaps of parts are joined by or, so entities that occur in many shards are counted once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import BINS, bin_of

WHOLE = -2  #: the slot of a thing as a whole; bins run from -1 (under) to their number (over)
STATE = ["kind", "name", "slot", "bucket"]


def _part(rows: DataFrame, shard: list[str], kind: str, name: Column | str, slot: Column, case: str) -> DataFrame:
    name = F.lit(name) if isinstance(name, str) else name
    return rows.select(*shard, F.lit(kind).alias("kind"), name.cast("string").alias("name"), slot.cast("int").alias("slot"), F.bitmap_bucket_number(case).alias("bucket"), F.bitmap_bit_position(case).alias("_bit"))


def states(
    rows: DataFrame, case: str, shard: list[str], signals: dict[str, tuple[float, float]], phase: str | None = None, source: str | None = None, flags: DataFrame | None = None, bins: int = BINS
) -> DataFrame:
    """The states of the shards of ``rows`` (one row a case and minute) and ``flags`` (case, rule_id, one row a flagged minute).

    ``case`` is a whole number (its bitmaps need one); rows without one are left out. ``signals`` holds the range that a
    signal's bins divide. A value that is null is no minute of its signal; a null phase, source or rule is none. Each
    row of the input is one row for each signal it has a value of; they are summed before any shuffle.
    """
    rows = rows.where(F.col(case).isNotNull())
    parts = [_part(rows, shard, "case", "all", F.lit(WHOLE), case)]
    for name, (low, high) in signals.items():
        has = rows.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
        parts.append(_part(has, shard, "signal", name, bin_of(F.col(name), low, high, bins), case))
    for kind, column in (("phase", phase), ("source", source)):
        if column:
            parts.append(_part(rows.where(F.col(column).isNotNull()), shard, kind, F.col(column), F.lit(WHOLE), case))
    if flags is not None:
        parts.append(_part(flags.where(F.col(case).isNotNull() & F.col("rule_id").isNotNull()), shard, "rule", F.col("rule_id"), F.lit(WHOLE), case))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*shard, *STATE).agg(F.count("*").alias("n"), F.bitmap_construct_agg("_bit").alias("bits"))


def merged(parts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One state from the states of shards, in any order and grouping; merging merged states gives the same."""
    parts = parts if more is None else parts.select(*STATE, "n", "bits").unionByName(more.select(*STATE, "n", "bits"))
    return parts.groupBy(*STATE).agg(F.sum("n").alias("n"), F.bitmap_or_agg("bits").alias("bits"))


def counts(state: DataFrame) -> DataFrame:
    """``kind``, ``name``, ``slot``, ``n`` and the exact number of ``cases`` of each thing and bin of a merged state."""
    return state.groupBy("kind", "name", "slot").agg(F.sum("n").alias("n"), F.sum(F.bitmap_count("bits")).alias("cases"))


def totals(state: DataFrame) -> DataFrame:
    """``kind``, ``name``, ``n`` and ``cases`` of each thing, over all its bins; a case that is in several bins counts once."""
    return counts(merged(state.withColumn("slot", F.lit(WHOLE)))).drop("slot")


def with_shares(whole: DataFrame, cell: int = 11) -> DataFrame:
    """``totals`` with cells too small to show: ``cases_shown`` as a string, and ``share`` of all cases, null where it would tell a small cell."""
    top = whole.where("kind = 'case'").select(F.col("cases").alias("_all"))  # one row
    rows = whole.join(F.broadcast(top), how="left")
    small = (F.col("cases") > 0) & (F.col("cases") < cell)
    rest = F.col("_all") - F.col("cases")
    hide = small | (F.col("_all") < cell) | ((rest > 0) & (rest < cell))
    return rows.withColumns({"cases_shown": F.when(small, f"<{cell}").otherwise(F.col("cases").cast("string")), "n": F.when(~small, F.col("n")), "share": F.when(~hide, F.round(100 * F.col("cases") / F.col("_all"), 1))}).drop("_all")
