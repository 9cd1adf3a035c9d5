"""The rule engine: rules become columns of the row that they judge, so rules over rules need no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPOSITES, rules
from .runs import all_long_runs, severity_name, severity_rank


def two_step(value: Column, warn: float, critical: float, above: bool) -> Column:
    """``critical``, ``warn`` or null; both thresholds count."""
    beyond = (lambda t: value >= t) if above else (lambda t: value <= t)
    return F.when(beyond(critical), "critical").when(beyond(warn), "warn")


def active(phase: Column | None, skip: tuple) -> Column:
    """Whether a rule speaks in a row's phase; an unknown phase is never skipped."""
    return ~F.coalesce(phase.isin(*skip), F.lit(False)) if phase is not None and skip else F.lit(True)


def rule_columns(series: DataFrame, catalog: dict | None = None, keys: list[str] | None = None, order: list[str] | None = None, place: str | None = None) -> tuple[DataFrame, list[str]]:
    """``series`` with ``rule_<id>``, the severity at which a rule fires in the row or null, and the ids.

    A rule whose signal ``series`` lacks is left out, and so is a composite without its parts. Phases are taken
    out before rows in a row are counted, by ``place`` as in ``runs.all_long_runs``.
    """
    keys, order = keys or ["PID"], order or ["Obs_time"]
    catalog = catalog if catalog is not None else rules()
    phase = F.col("phase") if "phase" in series.columns else None
    fires, severities = {}, {}
    for name, rule in catalog.items():
        if rule["signal"] not in series.columns:
            continue
        value = F.col(rule["signal"])
        where = F.coalesce(F.expr(rule["where"]), F.lit(False)) if "where" in rule else F.lit(True)
        step = "above" if "above" in rule else "below" if "below" in rule else None
        severities[name] = two_step(value, *rule[step], step == "above") if step else F.lit(rule["severity"])
        on = where & active(phase, rule.get("skip", ())) & severities[name].isNotNull() & value.isNotNull()
        fires[f"_on_{name}"] = on, rule.get("run", 1)
    df = all_long_runs(series, keys, order, fires, place)
    df = df.withColumns({f"rule_{n}": F.when(F.col(f"_on_{n}"), s) for n, s in severities.items()}).drop(*fires)
    over = {}
    for name, rule in COMPOSITES.items():
        parts = [p for p in rule.get("any", ()) if p in severities]
        if rule["signal"] not in series.columns or not set(rule["all"]) <= set(severities) or ("any" in rule and not parts):
            continue
        on = F.lit(True)
        for p in rule["all"]:
            on &= F.col(f"rule_{p}").isNotNull()
        if parts:
            on &= F.coalesce(*[F.col(f"rule_{p}") for p in parts]).isNotNull()
        if "where" in rule:
            on &= F.coalesce(F.expr(rule["where"]), F.lit(False))
        over[name] = F.when(on, rule["severity"])
    return df.withColumns({f"rule_{n}": c for n, c in over.items()}), [*severities, *over]


def flags(series: DataFrame, catalog: dict | None = None, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row for each rule that fires in a row of ``series``."""
    catalog = catalog if catalog is not None else rules()
    return flag_rows(*rule_columns(series, catalog, keys, order), catalog, keys, order)


def flag_rows(df: DataFrame, ids: list[str], catalog: dict, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row for each rule column of ``df`` that isn't null."""
    signal = {name: {**catalog, **COMPOSITES}[name]["signal"] for name in ids}
    hits = [F.when(F.col(f"rule_{n}").isNotNull(), F.struct(F.lit(n).alias("rule_id"), F.col(f"rule_{n}").alias("severity"), F.col(signal[n]).cast("double").alias("value"))) for n in ids]
    keep = [c for c in (*(keys or ["PID"]), *(order or ["Obs_time"]), "t_min", "phase") if c in df.columns]
    rows = df.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(*keep, "hit.*")
    return rows.withColumn("message", F.concat_ws(" ", "rule_id", F.format_string("%.2f", "value")))


def catalog_rows(catalog: dict | None = None) -> list[tuple]:
    every = {**(catalog if catalog is not None else rules()), **COMPOSITES}
    rows = []
    for name, rule in every.items():
        steps = rule.get("above") or rule.get("below") or (None, None)
        rows.append((name, rule["signal"], "high" if "above" in rule else "low" if "below" in rule else "condition", *[float(x) if x is not None else None for x in steps], rule.get("where", ""), rule.get("run", 1), ",".join(rule.get("skip", ()))))
    return rows


def catalog_frame(spark: SparkSession, catalog: dict | None = None) -> DataFrame:
    """The rules as rows, for search and reference."""
    return spark.createDataFrame(catalog_rows(catalog), "rule_id string, signal string, direction string, warn double, critical double, condition string, run int, skip_phases string")


def search_catalog(frame: DataFrame, text: str) -> DataFrame:
    """Rules in which ``text`` occurs anywhere, whatever its case."""
    blob = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in frame.columns]))
    return frame.where(blob.contains(text.lower())).orderBy("rule_id")


__all__ = ["active", "catalog_frame", "flags", "rule_columns", "search_catalog", "severity_name", "severity_rank", "two_step"]
