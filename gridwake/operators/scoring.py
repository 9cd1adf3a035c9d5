"""Scores of entities from their flags, in one aggregation per level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import COMPOSITES, WEIGHTS
from .runs import episodes, severity_rank


def worst_per_step(flags: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The worst severity rank of each (keys, at)."""
    return flags.groupBy(*keys, at).agg(F.max(severity_rank("severity")).alias("worst"))


def top_rules(flags: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """``top_rules``: the ``most`` most frequent rules as ``rule(n), ...``; by name where counts are equal."""
    counts = flags.groupBy(*keys, "rule_id").agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "rule_id"))), 1, most)
    text = F.array_join(F.transform(best, lambda x: F.concat(x["rule_id"], F.lit("("), (-x["n"]).cast("string"), F.lit(")"))), ", ")
    return counts.groupBy(*keys).agg(text.alias("top_rules"))


def weighted(warn: Column, critical: Column, composite: Column) -> Column:
    return WEIGHTS["warn"] * warn + WEIGHTS["critical"] * critical + WEIGHTS["composite"] * composite


def per_hour(score: Column, minutes: Column) -> Column:
    """Score per observed hour to two decimals; null without minutes."""
    return F.when(minutes > 0, F.bround(score / (minutes / 60), 2))


def scores_of_steps(steps: DataFrame, ids: list[str], keys: list[str], place: str, gap: float = 1.5, composites: list[str] | None = None, also: list[Column] | None = None, order: Column | None = None) -> DataFrame:
    """The scores of ``scores`` for a catalogue of a few rules, from one row a step with a column ``rule_<id>`` for each rule, and ``n_steps``, the steps of an entity.

    One window and one aggregation over the same keys, so one exchange; no flag becomes a row of its own. Entities
    without a flag have no row, unless there are aggregates of all steps to add (``also``). A composite's episode begins
    where its last hit is more than ``gap`` before. ``order`` is that of ``place`` or its reverse, if rows are sorted so.
    """
    composites = [c for c in (COMPOSITES if composites is None else composites) if c in ids]
    before = Window.partitionBy(*keys).orderBy(place if order is None else order).rowsBetween(Window.unboundedPreceding, -1)
    begins = {}
    for c in composites:
        on = F.col(f"rule_{c}").isNotNull()
        last = F.last(F.when(on, F.col(place)), ignorenulls=True).over(before)
        begins[f"_begin_{c}"] = on & (last.isNull() | (F.abs(F.col(place) - last) > gap))
    worst = F.greatest(F.lit(0), *[severity_rank(f"rule_{i}") for i in ids])
    rows = steps.withColumns({**begins, "_worst": worst})
    counted = {s: sum((F.count_if(F.col(f"rule_{i}") == s) for i in ids[1:]), F.count_if(F.col(f"rule_{ids[0]}") == s)) for s in ("info", "warn", "critical")}
    df = rows.groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        F.count_if(F.col("_worst") == 2).alias("worst_warn"),
        F.count_if(F.col("_worst") == 3).alias("worst_critical"),
        F.count_if(F.col("_worst") > 0).alias("flagged_steps"),
        *[c.alias(f"n_{s}") for s, c in counted.items()],
        *[F.count(f"rule_{i}").alias(f"_n_{i}") for i in ids],
        sum((F.count_if(c) for c in begins), F.lit(0)).cast("long").alias("composite_episodes"),
        *(also or []),
    ).where(F.lit(True) if also else F.col("flagged_steps") > 0)
    hits = F.filter(F.array(*[F.struct((-F.col(f"_n_{i}")).alias("n"), F.lit(i).alias("rule_id")) for i in ids]), lambda x: x["n"] < 0)
    shown = F.transform(F.slice(F.sort_array(hits), 1, 5), lambda x: F.concat(x["rule_id"], F.lit("("), (-x["n"]).cast("string"), F.lit(")")))
    score = weighted(F.col("worst_warn"), F.col("worst_critical"), F.col("composite_episodes"))
    return df.withColumns({"rule_types": F.size(hits), "top_rules": F.array_join(shown, ", "), "anomaly_score": score}).drop(*[f"_n_{i}" for i in ids])


def scores(flags: DataFrame, keys: list[str], at: str, place: str, gap: float = 1.5, composites: list[str] | None = None) -> DataFrame:
    """Per entity: steps at each worst severity, distinct flagged steps, rule types, composite episodes, score, top rules.

    ``at`` is the time step and ``place`` its number for episodes (same steps, ``gap`` apart at most).
    """
    composites = list(COMPOSITES) if composites is None else composites
    worst = worst_per_step(flags, keys, at).groupBy(*keys).agg(F.count_if(F.col("worst") == 2).alias("worst_warn"), F.count_if(F.col("worst") == 3).alias("worst_critical"), F.count("*").alias("flagged_steps"))
    kinds = flags.groupBy(*keys).agg(
        F.count_distinct("rule_id").alias("rule_types"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("info", "warn", "critical")],
    )
    runs = episodes(flags.where(F.col("rule_id").isin(composites)), [*keys, "rule_id"], place, gap).groupBy(*keys).agg(F.count("*").alias("composite_episodes"))
    df = worst.join(kinds, keys).join(runs, keys, "left").fillna(0, ["composite_episodes"]).join(top_rules(flags, keys), keys)
    return df.withColumn("anomaly_score", weighted(F.col("worst_warn"), F.col("worst_critical"), F.col("composite_episodes")))
