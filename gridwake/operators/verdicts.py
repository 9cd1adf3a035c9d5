"""Verdicts on the result of a run: each check with the rows that it looked at, those that fail, and whether it holds.

Each frame is read once for all its checks of single rows; keys are compared by joins. No rows come to the driver but
the few lines of verdicts, when a caller asks for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities, shares of rows that may lie outside of a case's window or have no time, columns of counts.
SEVERITIES = ("info", "warn", "critical")
OUTSIDE, TIMELESS = 0.05, 0.5
COUNTS = ("anomaly_score", "n_warn", "n_critical")
NEEDED = {"cases": ("PID", *COUNTS), "series": ("PID", "Obs_time"), "flags": ("PID", "Obs_time", "rule_id", "severity"), "episodes": ("PID", "rule_id", "t_start", "t_end")}
#: Frames that may be empty.
MAY_BE_EMPTY = ("flags", "episodes")


class Invalid(ValueError):
    """A result that fails a check; the message names the checks, and no row."""


def _lines(df: DataFrame, frame: str, checks: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """One line for each check (rows looked at, rows that fail, share allowed) from one pass over a frame."""
    sums = df.agg(*[x.alias(f"{side}{i}") for i, (of, bad, _) in enumerate(checks.values()) for side, x in (("n", F.count_if(of)), ("b", F.count_if(of & bad)))])
    told = [F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("n_bad"), F.lit(share).alias("allowed")) for i, (name, (_, _, share)) in enumerate(checks.items())]
    lines = sums.select(F.inline(F.array(*told))).select(F.lit(frame).alias("frame"), "check", "n", "n_bad", "allowed")
    return lines


def _repeated(df: DataFrame, frame: str, name: str, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_bad")).select(F.lit(frame).alias("frame"), F.lit(name).alias("check"), "n", "n_bad", F.lit(0.0).alias("allowed"))


def _subset(part: DataFrame, whole: DataFrame, frame: str, name: str, key: str) -> DataFrame:
    ids = part.select(key).where(F.col(key).isNotNull()).distinct()
    found = ids.join(whole.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("_there").isNull()).alias("n_bad")).select(F.lit(frame).alias("frame"), F.lit(name).alias("check"), "n", "n_bad", F.lit(0.0).alias("allowed"))


def form(frames: dict[str, DataFrame]) -> list[str]:
    """Faults of the frames' form: columns that are not there; these end a validation before any row is read."""
    return [f"{frame}: no column {c}" for frame, columns in NEEDED.items() if frame in frames for c in columns if c not in frames[frame].columns]


def verdicts(frames: dict[str, DataFrame], key: str = "PID", time: str = "Obs_time", window: tuple[str, str] = ("case_start", "case_end"), pad_minutes: float = 5.0) -> DataFrame:
    """``frame``, ``check``, ``n``, ``n_bad``, ``allowed`` (a share) and ``ok`` of the checks of cases, series, flags and episodes.

    A share is that of the rows that a check looks at; with no such rows it holds. A frame that must not be empty
    fails ``not empty`` with one bad row. Rows of the series without a window are not looked at by ``in window``, whose
    window has a minute more than the pad on both sides.
    """
    faults = form(frames)
    if faults:
        raise Invalid("; ".join(faults))
    yes, lines = F.lit(True), []
    for frame, df in frames.items():
        if frame not in MAY_BE_EMPTY:
            lines.append(df.agg(F.count("*").alias("n")).select(F.lit(frame).alias("frame"), F.lit("not empty").alias("check"), "n", (F.col("n") == 0).cast("long").alias("n_bad"), F.lit(0.0).alias("allowed")))
    if "cases" in frames:
        cases, checks = frames["cases"], {}
        for c in COUNTS:
            there = F.col(c).isNotNull()
            checks[f"{c} not negative"] = (there, F.col(c) < 0, 0.0)
            checks[f"{c} whole"] = (there, F.abs(F.col(c) - F.round(c)) > 1e-8, 0.0)
        lines += [_lines(cases, "cases", checks), _repeated(cases, "cases", "unique", [key])]
    if "series" in frames:
        series = frames["series"]
        checks = {"key": (yes, F.col(key).isNull(), 0.0), "time": (yes, F.col(time).isNull(), 0.0)}
        if "t_min" in series.columns:
            checks["place in time"] = (yes, F.col("t_min").isNull(), TIMELESS)
        if set(window) <= set(series.columns):
            at, low, high = (F.unix_timestamp(F.col(c).cast("timestamp")) / 60 for c in (time, *window))
            pad = pad_minutes + 1
            checks["in window"] = (low.isNotNull() & high.isNotNull() & at.isNotNull(), (at < low - pad) | (at > high + pad), OUTSIDE)
        lines += [_lines(series, "series", checks), _repeated(series, "series", "unique times", [key, time])]
    if "flags" in frames:
        flags = frames["flags"]
        lines.append(_lines(flags, "flags", {"key": (yes, F.col(key).isNull(), 0.0), "rule": (yes, F.col("rule_id").isNull(), 0.0), "severity": (yes, ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), 0.0)}))
    if "episodes" in frames:
        lines.append(_lines(frames["episodes"], "episodes", {"end after start": (yes, F.col("t_end") < F.col("t_start"), 0.0)}))
    for part, whole in (("flags", "cases"), ("cases", "series")):
        if part in frames and whole in frames:
            lines.append(_subset(frames[part], frames[whole], part, f"known in {whole}", key))
    return reduce(DataFrame.unionByName, lines).withColumn("ok", F.col("n_bad") <= F.col("allowed") * F.col("n"))


def validate(frames: dict[str, DataFrame], **options) -> DataFrame:
    """The verdicts, after all of them hold; else Invalid, with the names of those that don't."""
    told = verdicts(frames, **options)
    rows = told.collect()  # a line a check
    bad = [f"{r['frame']}: {r['check']} ({r['n_bad']} of {r['n']})" for r in rows if not r["ok"]]
    if bad:
        raise Invalid("; ".join(sorted(bad)))
    return told.sparkSession.createDataFrame(rows, told.schema)
