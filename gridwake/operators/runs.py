"""Gaps and islands: runs of rows, episodes, and missing stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "run_id") -> DataFrame:
    """``df`` with ``name``: how many rows up to this one in order begin a new run.

    ``breaks`` is true where a run begins; a null counts as false, so a first row needs no case of its own.
    One window over (keys, order); ties in ``order`` should be broken by the caller.
    """
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order)))


def previous(column: str, keys: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))


def long_runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: int, name: str) -> DataFrame:
    """``df`` with ``name``: ``flag`` where it holds for at least ``least`` rows in a row; null counts as false."""
    return all_long_runs(df, keys, order, {name: (flag, least)})


def all_long_runs(df: DataFrame, keys: list[str], order: list[str], flags: dict[str, tuple[Column, int]], place: str | None = None) -> DataFrame:
    """``df`` with a column for each of ``flags``: it holds, and does so for at least so many rows in a row; null counts as false.

    A run ends at the last row before and the first row after where the flag doesn't hold. One exchange and two
    sorts, however many flags: all look back over one window and forward over its reverse. With ``place``, a column
    of whole numbers in ``order``, rows that leave a number out are not in a row: no flag holds in what is left out.
    """
    df = df.withColumns({name: F.coalesce(flag, F.lit(False)) for name, (flag, _) in flags.items()})
    long = [name for name, (_, least) in flags.items() if least > 1]
    if not long:
        return df
    forth = Window.partitionBy(*keys).orderBy(*order)
    at = place or "_place"
    back = Window.partitionBy(*keys).orderBy(F.desc(at))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if not place:
        df = df.withColumn(at, F.row_number().over(forth).cast("long"))
    df = df.withColumns({"_before": F.col(at) - F.lag(at).over(forth), "_after": F.lead(at).over(forth) - F.col(at)})
    alone = lambda n, side, step: F.when(~F.col(n), F.col(at)).when(F.coalesce(F.col(side) > 1, F.lit(True)), F.col(at) + step)
    df = df.withColumns({f"_low_{n}": F.max(alone(n, "_before", -1)).over(upto(forth)) for n in long})
    df = df.withColumns({f"_high_{n}": F.min(alone(n, "_after", 1)).over(upto(back)) for n in long})
    rows = lambda n: F.col(f"_high_{n}") - F.col(f"_low_{n}") - 1
    return df.withColumns({n: F.col(n) & (rows(n) >= flags[n][1]) for n in long}).drop("_place", "_before", "_after", *[f"_{side}_{n}" for side in ("low", "high") for n in long])


def severity_rank(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c == "critical", 3).when(c == "warn", 2).when(c == "info", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "critical").when(rank == 2, "warn").when(rank == 1, "info")


def episodes(flags: DataFrame, keys: list[str], at: str, gap: float, value: str = "value") -> DataFrame:
    """Flags of the same keys whose places (``at``, a number) follow each other by at most ``gap``, as one row each.

    Gives start, end, the worst severity, the mean value, the first message, the phases of the first and the last
    flag that have one, the count and the inclusive duration. Flags may repeat a place.
    """
    marked = islands(flags, keys, [at], F.col(at) - previous(at, keys, [at]) > gap, "episode")
    aggregates = [
        F.min(at).alias("t_start"),
        F.max(at).alias("t_end"),
        severity_name(F.max(severity_rank("severity"))).alias("severity"),
        F.avg(value).alias("value_mean"),
        F.count("*").alias("n_flags"),
    ]
    if "message" in flags.columns:
        aggregates.append(F.expr(f"min_by(message, {at}) filter (where message is not null)").alias("message"))
    if "phase" in flags.columns:
        aggregates += [F.expr(f"min_by(phase, {at}) filter (where phase is not null)").alias("phase"), F.expr(f"max_by(phase, {at}) filter (where phase is not null)").alias("phase_end")]
    return marked.groupBy(*keys, "episode").agg(*aggregates).withColumn("duration", F.col("t_end") - F.col("t_start") + 1).drop("episode")


def low_runs(df: DataFrame, keys: list[str], at: str, value: str, threshold: float, max_gap: float, least: int = 2, longer_than: float = 0) -> DataFrame:
    """Runs of readings under ``threshold``: a reading at or above it, or a gap over ``max_gap``, ends a run.

    Kept are runs with ``least`` readings that span more than ``longer_than``. Null readings are no readings.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_low", F.col(value) < threshold)
    breaks = (F.col(at) - previous(at, keys, [at]) > max_gap) | (F.col("_low") != previous("_low", keys, [at]))
    marked = islands(rows, keys, [at], breaks, "_run").where("_low")
    found = marked.groupBy(*keys, "_run").agg(F.min(at).alias("t_start"), F.max(at).alias("t_end"), F.count("*").alias("n_readings"), F.min(value).alias("lowest"))
    return found.where((F.col("n_readings") >= least) & (F.col("t_end") - F.col("t_start") > longer_than)).drop("_run")


def gap_runs(grid: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Stretches of a dense grid without a value, between the first and the last value of a key."""
    whole = Window.partitionBy(*keys)
    seen = F.when(F.col(value).isNotNull(), F.col(at))
    rows = grid.withColumn("_first", F.min(seen).over(whole)).withColumn("_last", F.max(seen).over(whole))
    rows = rows.where(F.col(at).between(F.col("_first"), F.col("_last"))).withColumn("_missing", F.col(value).isNull())
    marked = islands(rows, keys, [at], ~F.col("_missing"), "_run").where("_missing")
    return marked.groupBy(*keys, "_run").agg(F.min(at).alias("gap_start"), F.max(at).alias("gap_end"), F.count("*").alias("gap_length")).drop("_run")


def gaps_of_rows(rows: DataFrame, key: str, at: str, values: list[str], most: int | None = None) -> DataFrame:
    """The ``gap_runs`` of each of ``values`` (named in ``signal``) on the grid of all steps from a key's first row to its last, without that grid.

    ``at`` is the number of a step, unique per key. A gap lies between two rows with a value that follow each other, so
    only the rows themselves are sorted, once for all values, however many steps lie between. With ``most``, the grid is
    that of ``grid.dense``: keys that span more steps have their own rows alone. A null key or step is on no grid.
    """
    order = Window.partitionBy(key).orderBy(at)
    whole, before = Window.partitionBy(key), order.rowsBetween(Window.unboundedPreceding, -1)
    held = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, *[F.when(F.col(v).isNotNull(), F.col(at)).alias(v) for v in values])
    last = {f"_last_{v}": F.last(v, ignorenulls=True).over(before) for v in values}
    if most is not None:
        held = held.withColumns({"_place": F.row_number().over(order).cast("long"), "_next": F.lead(at).over(order), "_prior": F.lag(at).over(order), "_wide": F.max(at).over(whole) - F.min(at).over(whole) > most})
        last |= {f"_row_{v}": F.last(F.when(F.col(v).isNotNull(), F.struct(F.col("_place").alias("place"), F.col("_next").alias("next"))), ignorenulls=True).over(before) for v in values}
    held = held.withColumns(last)

    def gap(v: str) -> Column:
        start, end, length = F.col(f"_last_{v}") + 1, F.col(at) - 1, F.col(at) - F.col(f"_last_{v}") - 1
        if most is not None:
            own = lambda rows, step: F.when(F.col("_wide"), rows).otherwise(step)
            start, end, length = own(F.col(f"_row_{v}.next"), start), own(F.col("_prior"), end), own(F.col("_place") - F.col(f"_row_{v}.place") - 1, length)
        return F.when(F.col(v).isNotNull() & (length > 0), F.struct(F.lit(v).alias("signal"), start.alias("gap_start"), end.alias("gap_end"), length.alias("gap_length")))

    return held.select(key, F.inline(F.array_compact(F.array(*[gap(v) for v in values]))))


def gap_spans(gaps: DataFrame, step: float = 1.0) -> DataFrame:
    """``gap_runs`` (with places as numbers) as spans that reach half a step beyond their first and last missing place."""
    half = step / 2
    return gaps.withColumns({"span_start": F.col("gap_start") - half, "span_end": F.col("gap_end") + half, "span": F.col("gap_end") - F.col("gap_start") + step})


def covering(intervals: DataFrame, points: DataFrame, keys: list[str], at: str, start: str = "t_start", end: str = "t_end", width: int = 24) -> DataFrame:
    """Intervals joined with the points of the same keys that they cover, both ends included.

    Time is cut into buckets of ``width``; an interval is noted in each bucket that it touches, so a key with
    many intervals and points meets bucket by bucket and not all with all.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    noted = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return noted.join(points.withColumn("_bucket", bucket(at)), [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")
