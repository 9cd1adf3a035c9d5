"""Derived signals of a minute series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import AGENT_NAMES, MAC_AGE40, MAC_AGE_COEF, N2O_MAC_AGE40
from .runs import islands


def rolling_slopes(df: DataFrame, values: dict[str, str], keys: list[str], order: list[str], rows: int = 10, least: int = 5, place: str | None = None) -> DataFrame:
    """``df`` with a column for each of ``values`` (new name: column): its least-squares slope against the row's place over the last ``rows`` rows.

    Null with fewer than ``least`` values; a null value keeps its place. Places count back from the row itself, so a
    long series loses no digits; each is a lag, and their sums are plain arithmetic. With ``place``, a column of whole
    numbers in ``order``, rows count by their number: those that are left out have no value.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    lags = {f"_{k}_{n}": F.lag(F.col(v).cast("double"), k).over(w) if k else F.col(v).cast("double") for n, v in values.items() for k in range(rows)}
    if place:
        lags |= {f"_{k}_": (F.lag(place, k).over(w) - F.col(place)).cast("double") for k in range(1, rows)}
    df = df.withColumns(lags)
    for n in values:
        at = [(F.lit(float(-k)), F.col(f"_{k}_{n}")) for k in range(rows)]
        if place:
            at[1:] = [(F.col(f"_{k}_"), F.when(F.col(f"_{k}_") > -rows, F.col(f"_{k}_{n}"))) for k in range(1, rows)]
        total = lambda f, at=at: reduce(lambda s, t: s + t, [F.when(y.isNotNull(), f(x, y)).otherwise(0.0) for x, y in at])
        df = df.withColumns({f"_n_{n}": total(lambda x, y: F.lit(1.0)), f"_x_{n}": total(lambda x, y: x)})
        middle = F.col(f"_x_{n}") / F.col(f"_n_{n}")
        df = df.withColumns({f"_xy_{n}": total(lambda x, y, m=middle: (x - m) * y), f"_xx_{n}": total(lambda x, y, m=middle: (x - m) * (x - m))})
        df = df.withColumn(n, F.when(F.col(f"_n_{n}") >= least, F.try_divide(f"_xy_{n}", f"_xx_{n}")))
    return df.drop(*lags, *[f"_{a}_{n}" for n in values for a in ("n", "x", "xy", "xx")])


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("double"))


def rolling_median(df: DataFrame, value: str, keys: list[str], order: list[str], name: str, rows: int = 15, least: int = 5, place: Column | None = None) -> DataFrame:
    """``df`` with the median of the last ``rows`` rows of the same keys; null with fewer than ``least`` values.

    With ``place``, whole numbers in ``order``, rows count by their number: those that are left out have no value.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    lags = {f"_{k}": F.lag(F.col(value).cast("double"), k).over(w) if k else F.col(value).cast("double") for k in range(rows)}
    if place is not None:
        lags |= {f"_{k}": F.when(place - F.lag(place, k).over(w) < rows, lags[f"_{k}"]) for k in range(1, rows)}
    held = df.withColumns(lags).withColumn("_sorted", F.sort_array(F.array_compact(F.array(*lags)))).drop(*lags)
    n = F.size("_sorted")
    low, high = (F.get("_sorted", F.floor(x / 2).cast("int")) for x in (n - 1, n))
    return held.withColumn(name, F.when(n >= least, low + (high - low) * 0.5)).drop("_sorted")


def potency(agent: Column, age: Column) -> Column:
    """An agent's MAC at an age: that at 40, times 10 to the coefficient times the years beyond; age 40 if unknown."""
    at40 = F.create_map(*[F.lit(x) for pair in MAC_AGE40.items() for x in pair])[agent]
    return at40 * F.pow(F.lit(10.0), MAC_AGE_COEF * (F.coalesce(age, F.lit(40.0)) - 40))


def add_features(series: DataFrame, place: str | None = None) -> DataFrame:
    """Ratios, agent potency, slopes, drift and the main agent of each case.

    With ``place``, the number of each row's step, steps without a row may be left out; a phase lasts over them.
    """
    main = series.groupBy("PID").agg(F.coalesce(F.mode(F.when(F.col("Agent") != "N", F.col("Agent")), deterministic=True), F.mode("Agent", deterministic=True), F.lit("N")).alias("primary_agent"))
    series = series.join(main, "PID")
    age = F.coalesce("Age", F.lit(40.0))
    mac = potency(F.col("Agent"), F.col("Age"))
    df = series.withColumns({
        "TV_mlkg": F.try_divide("TV", "IBW_kg"),
        "MAC_1pct": mac,
        "MAC_Et": F.try_divide(F.col("Agent_Et"), mac),
        "MAC_Fi": F.try_divide(F.col("Agent_Fi"), mac),
        "Agent_Fi_Et_gap": F.abs(F.col("Agent_Fi") - F.col("Agent_Et")),
        "likely_mech_vent": F.coalesce((F.col("TV") >= 200) & (F.col("RR") >= 6), F.lit(False)),
    })
    nitrous = F.col("ETN2O") / (N2O_MAC_AGE40 * F.pow(F.lit(10.0), MAC_AGE_COEF * (age - 40)))
    df = df.withColumn("MAC_total_Et", F.when(F.col("MAC_Et").isNotNull() | nitrous.isNotNull(), F.coalesce("MAC_Et", F.lit(0.0)) + F.coalesce(nitrous, F.lit(0.0))))
    if "phase" in df.columns:
        df = df.withColumn("_phase_before", F.lag("phase").over(Window.partitionBy("PID").orderBy("Obs_time")))
    if not place:
        df = numbered(df, ["PID"], ["Obs_time"])
    df = rolling_slopes(df, {"PIP_slope": "PIP", "TV_slope": "TV"}, ["PID"], ["Obs_time"], place=place)
    at = F.col(place) if place else F.col("_row").cast("long")
    if "phase" in df.columns:
        df = islands(df, ["PID"], ["Obs_time"], ~F.col("phase").eqNullSafe(F.col("_phase_before")), "_phase_run")
        at += F.col("_phase_run") * 2**32  # rows of another phase are too far away
    df = rolling_median(df.withColumn("_at", at), "Agent_Et", ["PID"], ["Obs_time"], "Agent_Et_rollmed", place=F.col("_at")).drop("_phase_run", "_phase_before", "_at")
    df = df.withColumn("Agent_Et_drift", F.abs(F.col("Agent_Et") - F.col("Agent_Et_rollmed"))).drop("_row")
    names = F.create_map(*[F.lit(x) for pair in AGENT_NAMES.items() for x in pair])
    return df.withColumn("primary_agent_name", names[F.col("primary_agent")])
