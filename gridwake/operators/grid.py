"""Aligning irregular streams on a dense grid of time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: keys whose data spans more steps than this keep their rows as they are.
MOST_STEPS = 1680


def collapse(df: DataFrame, keys: list[str], time: str, numbers: list[str], categories: list[str], unit: str = "minute", name: str = "time_bin") -> DataFrame:
    """One row per key and time step: the median of each number, the most frequent category (the least on ties)."""
    binned = df.withColumn(name, F.date_trunc(unit, F.col(time)))
    medians = [F.expr(f"percentile(`{c}`, 0.5)").alias(c) for c in numbers]
    modes = [F.mode(c, deterministic=True).alias(c) for c in categories]
    return binned.groupBy(*keys, name).agg(*medians, *modes)


def collapse_few(df: DataFrame, keys: list[str], time: str, numbers: list[str], categories: list[str], unit: str = "minute", name: str = "time_bin") -> DataFrame:
    """``collapse`` where a step has few rows, as after ``clean.last_by``: they are listed once and not counted up for each column."""
    listed = df.groupBy(*keys, F.date_trunc(unit, F.col(time)).alias(name)).agg(F.collect_list(F.struct(*numbers, *categories)).alias("_rows"))
    first, second, most = F.get("_rows", F.lit(0)), F.get("_rows", F.lit(1)), F.size("_rows") <= 2
    values = lambda c: F.array_compact(F.transform("_rows", lambda r: r[c]))

    def median(c: str) -> Column:
        n, in_order = F.size(values(c)), F.sort_array(values(c))
        half = lambda a, b: 0.5 * a + 0.5 * b
        return F.when(most, F.coalesce(half(first[c], second[c]), first[c], second[c])).otherwise(half(*[F.get(in_order, F.floor(x / 2).cast("int")) for x in (n - 1, n)])).alias(c)

    def mode(c: str) -> Column:
        told = F.transform(F.array_distinct(values(c)), lambda v: F.struct((-F.size(F.filter(values(c), lambda x: x == v))).alias("n"), v.alias("v")))
        return F.when(most, F.least(first[c], second[c])).otherwise(F.array_min(told)["v"]).alias(c)

    return listed.select(*keys, name, *[median(c) for c in numbers], *[mode(c) for c in categories])


def merge_streams(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All steps that either stream has; columns of the other are null."""
    return left.join(right, keys, "full_outer")


def dense(df: DataFrame, key: str, time: str, step: str = "1 minute", most: int = MOST_STEPS, constants: list[str] | None = None) -> DataFrame:
    """Every step from a key's first to its last, with the rows that it has; signals of the others are null.

    ``time`` must be on the grid and unique per key. ``constants`` are carried to all steps of a key. Keys that
    span more than ``most`` steps keep only their own rows. The steps are made from one row per key, so the
    grid and the rows share one exchange on (key, time).
    """
    constants = constants or []
    span = df.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), *[F.first(c, ignorenulls=True).alias(c) for c in constants])
    steps = F.sequence("_lo", "_hi", F.expr(f"interval {step}"))
    seconds = F.expr(f"unix_seconds(timestamp'1970-01-02 00:00:00' + interval {step}) - unix_seconds(timestamp'1970-01-02 00:00:00')")
    wide = (F.unix_seconds(F.col("_hi").cast("timestamp")) - F.unix_seconds(F.col("_lo").cast("timestamp"))) / seconds
    grid = span.where(wide <= most).select(key, F.explode(steps).alias(time), *constants)
    sparse = df.join(span.where(wide > most).select(key), key, "left_semi").select(key, time, *constants)
    return grid.unionByName(sparse).join(df.drop(*constants), [key, time], "left")


def placed(df: DataFrame, key: str, time: str, name: str, step: str = "1 minute", most: int = MOST_STEPS) -> DataFrame:
    """``df`` with ``name``: the number of each row's step on the grid that ``dense`` makes of it, without that grid.

    ``time`` must be on the grid and unique per key. Keys that span more than ``most`` steps have their own rows alone
    for a grid, so these are numbered one by one. A null key is on no grid.
    """
    seconds = F.expr(f"unix_seconds(timestamp'1970-01-02 00:00:00' + interval {step}) - unix_seconds(timestamp'1970-01-02 00:00:00')")
    second, order = F.unix_seconds(F.col(time).cast("timestamp")), Window.partitionBy(key).orderBy(time)
    whole = Window.partitionBy(key)
    df = df.where(F.col(key).isNotNull()).withColumns({"_lo": F.min(second).over(whole), "_hi": F.max(second).over(whole), "_row": F.row_number().over(order).cast("long")})
    place = F.when((F.col("_hi") - F.col("_lo")) / seconds <= most, ((second - F.col("_lo")) / seconds).cast("long")).otherwise(F.col("_row"))
    return df.withColumn(name, place).drop("_lo", "_hi", "_row")


def offsets(df: DataFrame, key: str, time: str, anchor: str | None = None, end: str | None = None) -> DataFrame:
    """``df`` with ``t_min`` (minutes from the anchor, or from the first row where it is null), ``case_duration_min`` and ``case_frac``.

    The duration is from the anchor to ``end``, or to the last row where that is missing; a duration that is not
    positive gives no fraction.
    """
    w = Window.partitionBy(key)
    start = F.coalesce(F.col(anchor), F.min(time).over(w)) if anchor else F.min(time).over(w)
    stop = F.coalesce(F.col(end), F.max(time).over(w)) if end else F.max(time).over(w)
    df = df.withColumn("t_min", minutes_between(F.col(time), start)).withColumn("case_duration_min", minutes_between(stop, start))
    return df.withColumn("case_frac", F.when(F.col("case_duration_min") > 0, F.col("t_min") / F.col("case_duration_min")))


def minutes_between(a, b):
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 6e7
