"""What lists and briefings of cases show: filters, neighbours of a row, ranks, marks and short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import placed


def filtered(df: DataFrame, equal: dict | None = None, least: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Rows that equal, reach and contain (whatever the case) what is asked; a null matches nothing."""
    for name, value in (equal or {}).items():
        df = df.where(F.col(name) == value)
    for name, value in (least or {}).items():
        df = df.where(F.col(name) >= value)
    for name, value in (contains or {}).items():
        df = df.where(F.contains(F.lower(name), F.lit(value.lower())))
    return df


def typed_filter(df: DataFrame, typed: str, names: list[str], labels: str) -> DataFrame:
    """Rows in which the typed text occurs in one of ``names`` or in one of the array ``labels``, whatever the case."""
    within = lambda c: F.contains(F.lower(c), F.lit(typed.lower()))
    hit = F.coalesce(F.exists(labels, within), F.lit(False))
    for name in names:
        hit |= F.coalesce(within(F.col(name)), F.lit(False))
    return df.where(hit)


def around(df: DataFrame, keys: list[str], order: list[str], selected: Column, rows: int) -> DataFrame:
    """The first selected row of each key with so many rows before and after it; ``off`` is the distance. Keys without one are left out."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_rn", F.row_number().over(ordered))
    at = F.min(F.when(selected, F.col("_rn"))).over(Window.partitionBy(*keys))
    return placed.withColumn("off", (F.col("_rn") - at).cast("long")).where(F.abs("off") <= rows).drop("_rn")


def marks(start: Column, end: Column) -> list[Column]:
    """``incision`` at 0, and ``closure`` the minutes to the end if that is later."""
    minutes = F.expr("null") if end is None else (F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 60
    return [F.lit(0).cast("long").alias("incision"), F.when(end > start, F.floor(minutes)).cast("long").alias("closure")]


def rule_counts(df: DataFrame, column: str) -> DataFrame:
    """A row for each ``rule(n)`` of a text like ``a(3), b(1)``."""
    parts = F.regexp_extract_all(column, F.lit(r"(\w+)\(\d+\)"), F.lit(1))
    counts = F.regexp_extract_all(column, F.lit(r"\w+\((\d+)\)"), F.lit(1))
    return df.withColumn("_pair", F.explode(F.arrays_zip(parts.alias("rule_id"), counts.alias("n")))).select("*", F.col("_pair.rule_id").alias("rule_id"), F.col("_pair.n").cast("long").alias("n")).drop("_pair")


def ranked_both(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """``up`` and ``down``: ranks by value in both directions, a null always the lowest, ties by ids, which leave none."""
    up = placed(df, [F.col(value).asc_nulls_first(), *ties], "up")
    return placed(up, [F.col(value).desc_nulls_last(), *ties], "down")


def first_of(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The ``most`` first rows of each key with their ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("place") <= most)


def facts(signals: DataFrame, names: list[str], flags: DataFrame, key: str, gaps: DataFrame | None = None) -> DataFrame:
    """One line of text a case: the signals that it has, the rules that it raised, and with ``gaps`` (key, ``signal``) those that it lacks between readings, each in order."""
    raised = flags.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ", ").alias("_raised"))
    there = F.concat_ws(", ", *[F.when(F.col(n), F.lit(n)) for n in sorted(names)])
    said = F.when(F.col("_raised").isNull(), F.lit("No rule raised.")).otherwise(F.concat(F.lit("Rules raised: "), F.col("_raised"), F.lit(".")))
    rows = signals.join(raised, key, "left")
    if gaps is None:
        return rows.select(key, F.concat(F.lit("Signals: "), there, F.lit(". "), said).alias("facts"))
    missing = gaps.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("signal")), ", ").alias("_gaps"))
    inside = F.when(F.col("_gaps").isNotNull(), F.concat(F.lit(" Interior gaps: "), F.col("_gaps"), F.lit("."))).otherwise(F.lit(""))
    return rows.join(missing, key, "left").select(key, F.concat(F.lit("Signals: "), there, F.lit(". "), said, inside).alias("facts"))


def key_observation(grid: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The first step of each key without a value (``missing``), else that with the greatest, the first on ties (``peak``)."""
    gap = F.min(F.when(F.col(value).isNull(), F.col(at)))
    peak = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col(at).alias("at"))))
    found = grid.groupBy(key).agg(gap.alias("_gap"), peak.alias("_peak"))
    return found.select(key, F.when(F.col("_gap").isNull(), "peak").otherwise("missing").alias("kind"), F.coalesce("_gap", "_peak.at").alias("at"))


def management(steps: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """A case's steps and medians with its score and its most frequent rules as ``rule n; ...`` (0 and empty where nothing was raised)."""
    rules = F.regexp_replace(F.regexp_replace("top_rules", r"\(", " "), r"\)(, )?", "; ")
    told = scores.select(key, F.col("anomaly_score").alias("score"), F.regexp_replace(rules, "; $", "").alias("rules"))
    return steps.join(told, key, "left").fillna(0, ["score"]).fillna("", ["rules"])


def newest_first(df: DataFrame, key: str, turn: str, found: str) -> DataFrame:
    """``ids``: the distinct entries of the arrays ``found``, those of later turns first, each in the order of its turn."""
    every = F.sort_array(F.collect_list(F.struct((-F.col(turn)).alias("t"), F.col(found).alias("f"))))
    return df.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(every, lambda x: x["f"]))).alias("ids"))


def preferred_source(df: DataFrame, keys: list[str], best: str, other: str, names: tuple[str, str]) -> DataFrame:
    """``reading`` and ``source``: the readings of ``best`` for keys that have any, else those of ``other``."""
    has = F.count(best).over(Window.partitionBy(*keys)) > 0
    rows = df.withColumn("_has", has).where(~F.col("_has") | F.col(best).isNotNull())
    return rows.withColumns({"reading": F.when(F.col("_has"), F.col(best)).otherwise(F.col(other)), "source": F.when(F.col("_has"), names[0]).otherwise(names[1])}).drop("_has")
