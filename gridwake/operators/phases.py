"""Labelled intervals of a case, from its events where it has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PHASES
from .clean import VENT_SIGNALS


def role(name: Column, phases: dict = PHASES) -> Column:
    """``extubation`` or ``intubation`` if a pattern occurs in the name, whatever its case; the first wins."""
    tests = {r: name.rlike("(?i)" + "|".join(f"(?:{p})" for p in phases[r])) for r in ("extubation", "intubation")}
    return F.when(tests["extubation"], "extubation").when(tests["intubation"], "intubation")


def boundaries(series: DataFrame, events: DataFrame, cases: DataFrame, phases: dict = PHASES) -> DataFrame:
    """One row per PID of ``series``: when each phase begins (null: it never does), and where that comes from.

    Events count from ``event_pad_min`` before the first minute to as long after the last. The first intubation
    and the last extubation after it are taken. What has no event falls back to the first ventilated minute, and
    to the case's own start and end; boundaries are moved so that they never go back.
    """
    minute = lambda n: F.expr(f"interval {int(n)} minutes")
    ventilated = F.coalesce(*[F.col(c) for c in VENT_SIGNALS if c in series.columns]).isNotNull()
    span = series.groupBy("PID").agg(F.min("Obs_time").alias("first"), F.max("Obs_time").alias("last"), F.min(F.when(ventilated, F.col("Obs_time"))).alias("vent_start"))
    marks = events.withColumn("role", role(F.col("Event_name"), phases)).where("role is not null").withColumn("at", F.date_trunc("minute", "Event_time"))
    pad = minute(phases["event_pad_min"])
    marks = marks.join(span.select("PID", "first", "last"), "PID").where(F.col("at").between(F.col("first") - pad, F.col("last") + pad))
    first, last = F.min(F.when(F.col("role") == "intubation", F.col("at"))), F.max(F.when(F.col("role") == "extubation", F.col("at")))
    airway = marks.groupBy("PID").agg(first.alias("intub"), last.alias("extub"))
    airway = airway.withColumn("extub", F.when(F.col("intub").isNull() | (F.col("extub") > F.col("intub")), F.col("extub")))
    one = cases.groupBy("PID").agg(F.min("case_start").alias("case_start"), F.max("case_end").alias("case_end"))
    df = span.join(airway, "PID", "left").join(one, "PID", "left")
    df = df.withColumns({
        "pre_end": F.coalesce("intub", F.least("vent_start", "case_start")),
        "ind_end": F.when(F.col("intub").isNotNull(), F.col("intub") + minute(phases["induction_after_min"])).otherwise(F.coalesce("case_start", F.least("vent_start", "case_start"))),
        "emerg_start": F.when(F.col("extub").isNotNull(), F.col("extub") - minute(phases["emergence_before_min"])).otherwise(F.col("case_end")),
        "post_start": F.col("extub"),
        "phase_source": F.when(F.col("intub").isNotNull() & F.col("extub").isNotNull(), "events").when(F.col("intub").isNotNull() | F.col("extub").isNotNull(), "mixed").otherwise("fallback"),
    })
    # greatest() skips nulls, but a boundary that is null must stay so
    later = lambda c, *before: F.when(F.col(c).isNotNull(), F.greatest(c, *before))
    df = df.withColumn("ind_end", later("ind_end", "pre_end")).withColumn("emerg_start", later("emerg_start", "ind_end"))
    return df.withColumn("post_start", later("post_start", "emerg_start")).select("PID", "pre_end", "ind_end", "emerg_start", "post_start", "phase_source")


def label(series: DataFrame, bounds: DataFrame) -> DataFrame:
    """``series`` with ``phase`` and ``phase_source``: the latest phase whose begin has come."""
    reached = lambda c: F.coalesce(F.col("Obs_time") >= F.col(c), F.lit(False))
    phase = F.when(reached("post_start"), "post_emergence").when(reached("emerg_start"), "emergence").when(reached("ind_end"), "maintenance").when(reached("pre_end"), "induction").otherwise("pre_induction")
    return series.join(bounds, "PID", "left").withColumn("phase", phase).drop("pre_end", "ind_end", "emerg_start", "post_start")
