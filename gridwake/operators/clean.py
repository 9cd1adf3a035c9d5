"""Typing and cleaning of raw tables whose columns are all strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import AGENT_MAX, AGENT_NAMES, CLEAN_RANGES
from .grid import minutes_between

#: Cells that mean null, and the formats of timestamps.
NULL_TOKENS = ("\\N", "\\n", "NA", "NaN", "nan", "")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yy H:mm", "M/d/yyyy H:mm", "yyyy-MM-dd")
#: Height (cm) and weight (kg) beyond which body-weight measures are not trusted.
HEIGHT, WEIGHT = (140.0, 215.0), (20.0, 400.0)

VENT_SIGNALS = ["Agent_Fi", "Agent_Et", "ETCO2", "FICO2", "TV", "RR", "PEEP", "PIP", "FIN2O", "ETN2O", "FIO2", "ETO2"]
VITAL_SIGNALS = ["HRe", "HRp", "nSBP", "nMAP", "nDBP", "SPO2"]


def known(c: str | Column) -> Column:
    """A string without white space around it, null if it is one of the null tokens."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~c.isin(*NULL_TOKENS), c)


def number(c: str | Column) -> Column:
    """A finite double, else null: NaN would compare above every number."""
    value = known(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def timestamp(c: str | Column) -> Column:
    """The first of the formats that fits; null if none does."""
    c = known(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS])


def clamp(c: str | Column, low: float, high: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.between(low, high), c)


def clamp_all(df: DataFrame, ranges: dict[str, tuple] | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Every column that has a range, nulled outside of it; ``columns`` maps a range's name to another column."""
    ranges = ranges or CLEAN_RANGES
    targets = {(columns or {}).get(name, name): bounds for name, bounds in ranges.items()}
    return df.withColumns({c: clamp(c, *bounds) for c, bounds in targets.items() if c in df.columns})


def with_columns(df: DataFrame, names: list[str], kind: str = "string") -> DataFrame:
    """``df`` with a null column for each name that it lacks, so that later expressions are total."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an order without ties; most rows go before they are shuffled."""
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row.alias("_last")).select("_last.*")


def dose_kind(start: Column, end: Column) -> Column:
    """``bolus`` without an end or with one at its start, ``infusion`` with a later, ``reversed`` with an earlier one."""
    return F.when(end.isNull() | (end == start), "bolus").when(end > start, "infusion").otherwise("reversed")


def ideal_weight(height: Column, gender: Column) -> Column:
    """Devine's formula in kg; null outside the heights that it holds for."""
    base = F.when(gender == "M", 50.0).when(gender == "F", 45.5).otherwise(47.75)
    weight = base + 2.3 * (height / 2.54 - 60)
    return F.when(height.between(*HEIGHT) & (weight > 0), weight)


def anthropometric_reasons(height: Column, weight: Column) -> Column:
    """Why body-weight measures cannot be trusted, joined by ``; ``; empty if they can."""

    def reason(c: Column, name: str, unit: str, low: float, high: float) -> Column:
        out = F.concat(F.lit(f"{name} "), F.format_string("%.0f", F.bround(c, 0)), F.lit(f" {unit} outside {low:.0f}-{high:.0f}"))
        return F.when(c.isNull() | (c <= 0), F.lit(f"{name} missing")).when(~c.between(low, high), out)

    return F.concat_ws("; ", reason(height, "height", "cm", *HEIGHT), reason(weight, "weight", "kg", *WEIGHT))


def clean_cases(raw: DataFrame, most_hours: float = 24.0) -> DataFrame:
    """The entity dimension: one row per raw row, typed, with derived measures and the data window."""
    times = ["OR_start", "OR_end", "Surgery_start", "Surgery_end"]
    df = with_columns(raw, ["Age", "Ht", "Wt", "Gender", "Procedure", *times])
    df = df.withColumns({"PID": F.trim("PID")} | {c: timestamp(c) for c in times} | {c: number(c) for c in ("Age", "Ht", "Wt")})
    gender = F.trim("Gender")
    df = df.withColumn("Gender", F.when(gender.isin("M", "F", "U"), gender).otherwise("U"))
    df = df.withColumns({
        "BMI": clamp(F.try_divide(F.col("Wt"), F.pow(F.col("Ht") / 100, 2)), 10, 80),
        "dq_reasons": anthropometric_reasons(F.col("Ht"), F.col("Wt")),
        "OR_duration_min": clamp(minutes_between(F.col("OR_end"), F.col("OR_start")), 0, most_hours * 60),
        "Surgery_duration_min": clamp(minutes_between(F.col("Surgery_end"), F.col("Surgery_start")), 0, most_hours * 60),
        "Procedure": F.trim(F.regexp_replace("Procedure", r"\s+", " ")),
        "case_start": F.coalesce("Surgery_start", "OR_start"),
        "case_end": F.coalesce("Surgery_end", "OR_end"),
    })
    outside = F.coalesce(F.coalesce("OR_start", "case_start") > F.col("case_start"), F.lit(False)) | F.coalesce(F.coalesce("OR_end", "case_end") < F.col("case_end"), F.lit(False))
    return df.withColumns({
        "dq_anthropometrics_ok": F.col("dq_reasons") == "",
        "IBW_kg": F.when(F.col("dq_reasons") == "", ideal_weight(F.col("Ht"), F.col("Gender"))),
        "Procedure_short": F.substring("Procedure", 1, 80),
        "window_start": F.when(outside, F.col("case_start")).otherwise(F.coalesce("OR_start", "case_start")),
        "window_end": F.when(outside, F.col("case_end")).otherwise(F.coalesce("OR_end", "case_end")),
    })


def _stream(raw: DataFrame, signals: list[str]) -> DataFrame:
    df = with_columns(raw, ["PID", "Obs_time", *signals])
    df = df.withColumn("_place", F.monotonically_increasing_id())
    return df.withColumns({"PID": F.trim("PID"), "Obs_time": timestamp("Obs_time")} | {c: number(c) for c in signals})


def clean_ventilator(raw: DataFrame) -> DataFrame:
    """Typed ventilator rows, the last of each (PID, time) in file order; exact zeros of ETCO2 are kept."""
    df = with_columns(_stream(raw, VENT_SIGNALS), ["Agent"])
    agent = F.upper(F.trim("Agent"))
    df = df.withColumns({"Agent": F.when(agent.isin(*AGENT_MAX), agent), "_zero": F.col("ETCO2") == 0})
    df = clamp_all(df)
    names = F.create_map(*[F.lit(x) for pair in AGENT_NAMES.items() for x in pair])
    cap = F.coalesce(F.create_map(*[F.lit(x) for pair in AGENT_MAX.items() for x in pair])[F.col("Agent")], F.lit(float("inf")))
    df = df.withColumns({c: F.when(F.col(c) <= cap, F.col(c)) for c in ("Agent_Et", "Agent_Fi")} | {"Agent_name": names[F.col("Agent")], "ETCO2": F.when(F.col("_zero"), 0.0).otherwise(F.col("ETCO2"))})
    return last_by(df.where("Obs_time is not null"), ["PID", "Obs_time"], [F.col("_place")]).drop("_place", "_zero")


def clean_vitals(raw: DataFrame) -> DataFrame:
    """Typed vital signs; the heart rate is the electrical one, else that of the pulse."""
    df = _stream(raw, VITAL_SIGNALS)
    df = clamp_all(df.withColumn("HR", F.coalesce("HRe", "HRp")))
    df = df.withColumns({c: clamp(c, *CLEAN_RANGES["HR"]) for c in ("HRe", "HRp")})
    return last_by(df.where("Obs_time is not null"), ["PID", "Obs_time"], [F.col("_place")]).drop("_place")


def clean_events(raw: DataFrame) -> DataFrame:
    """Point events with a time; without the usual names the second and third columns are time and name."""
    names = raw.columns
    time, name = ("Event_time" if "Event_time" in names else names[1]), ("Event_name" if "Event_name" in names else names[2])
    return raw.select(F.trim("PID").alias("PID"), timestamp(time).alias("Event_time"), F.trim(name).alias("Event_name")).where("Event_time is not null")


def in_window(df: DataFrame, windows: DataFrame, key: str, time: str, low: str, high: str, pad: str = "5 minutes") -> DataFrame:
    """Rows inside their key's window and ``pad`` around it.

    Rows whose key has no window start stay; those with a start but no end go. The first window of a key counts.
    """
    bounds = windows.groupBy(key).agg(F.min_by(low, F.struct(low, high)).alias("_lo"), F.min_by(high, F.struct(low, high)).alias("_hi"))
    joined = df.join(bounds, key, "left")
    inside = F.coalesce(F.col(time).between(F.expr(f"_lo - interval {pad}"), F.expr(f"_hi + interval {pad}")), F.lit(False))
    return joined.where(F.col("_lo").isNull() | inside).drop("_lo", "_hi")
