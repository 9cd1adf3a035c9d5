"""Verdicts on frames with one fault at a time, and what a run does with them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridwake.operators import grid, runs, verdicts

AT = dt.datetime(2024, 1, 1, 8)


def _frames(spark):
    minutes = [(p, AT + dt.timedelta(minutes=i), float(i), AT, AT + dt.timedelta(minutes=60)) for p in "ab" for i in range(50)]
    return {
        "cases": spark.createDataFrame([("a", 3.0, 1, 0), ("b", 0.0, 0, 0)], "PID string, anomaly_score double, n_warn int, n_critical int"),
        "series": spark.createDataFrame(minutes, "PID string, Obs_time timestamp, t_min double, case_start timestamp, case_end timestamp"),
        "flags": spark.createDataFrame([("a", AT, "r", "warn")], "PID string, Obs_time timestamp, rule_id string, severity string"),
        "episodes": spark.createDataFrame([("a", "r", 1.0, 1.0)], "PID string, rule_id string, t_start double, t_end double"),
    }


def _bad(frames, **options):
    return {(r["frame"], r["check"]) for r in verdicts.verdicts(frames, **options).where("not ok").collect()}


def test_a_sound_run_holds(spark):
    told = verdicts.validate(_frames(spark))
    assert told.count() == 20 and told.where("not ok").isEmpty()


@pytest.mark.parametrize(
    "frame, change, check",
    [
        ("cases", lambda df: df.union(df.limit(1)), "unique"),
        ("cases", lambda df: df.withColumn("n_warn", -F.col("n_warn")), "n_warn not negative"),
        ("cases", lambda df: df.withColumn("anomaly_score", F.col("anomaly_score") + 0.25), "anomaly_score whole"),
        ("series", lambda df: df.union(df.where("PID = 'a'").limit(1)), "unique times"),
        ("series", lambda df: df.withColumn("t_min", F.when(F.col("t_min") > 25, F.col("t_min"))), "place in time"),
        ("series", lambda df: df.withColumn("case_end", F.expr("case_start + interval 40 minutes")), "in window"),
        ("series", lambda df: df.withColumn("PID", F.when(F.col("t_min") > 0, F.col("PID"))), "key"),
        ("flags", lambda df: df.withColumn("severity", F.lit("grave")), "severity"),
        ("flags", lambda df: df.withColumn("rule_id", F.lit(None).cast("string")), "rule"),
        ("flags", lambda df: df.withColumn("PID", F.lit("z")), "known in cases"),
        ("cases", lambda df: df.withColumn("PID", F.concat("PID", F.lit("z"))), "known in series"),
        ("episodes", lambda df: df.withColumn("t_end", F.lit(0.0)), "end after start"),
        ("series", lambda df: df.where("false"), "not empty"),
    ],
)
def test_each_fault_is_found(spark, frame, change, check):
    frames = _frames(spark)
    frames[frame] = change(frames[frame])
    assert (frame, check) in _bad(frames)
    with pytest.raises(verdicts.Invalid, match=check):
        verdicts.validate(frames)


def test_what_is_allowed(spark):
    frames = _frames(spark)
    frames["series"] = frames["series"].withColumn("case_end", F.expr("case_start + interval 43 minutes"))  # and six more
    assert _bad(frames) == set()
    assert _bad(frames, pad_minutes=0.0) == {("series", "in window")}
    frames["flags"], frames["episodes"] = frames["flags"].limit(0), frames["episodes"].limit(0)
    assert _bad(frames) == set()
    with pytest.raises(verdicts.Invalid, match="no column severity"):
        verdicts.verdicts(frames | {"flags": frames["flags"].drop("severity")})


def test_gap_spans(spark):
    grid = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, None, 2.0, None, 3.0, None])], "k string, at long, v double")
    got = runs.gap_spans(runs.gap_runs(grid, ["k"], "at", "v")).orderBy("gap_start").collect()
    assert [(r["span_start"], r["span_end"], r["span"], r["gap_length"]) for r in got] == [(1.5, 3.5, 2.0, 2), (4.5, 5.5, 1.0, 1)]


def test_gaps_of_rows_are_those_of_the_grid(spark):
    chance = random.Random(5)
    rows = [(k, at, chance.choice([1.0, None]), chance.choice([1.0, None, None])) for k in range(12) for at in sorted(chance.sample(range(30 if k < 8 else 90), 14))]
    rows += [(None, 3, 1.0, 1.0), (None, 9, 1.0, 1.0), (20, 5, 1.0, None), (21, 7, None, None)]
    frame = spark.createDataFrame(rows, "k long, at long, v double, w double")
    timed = frame.withColumn("t", F.timestamp_seconds(F.col("at") * 3600))
    dense = grid.dense(timed.drop("at"), "k", "t", "1 hour", most=40).withColumn("at", F.expr("unix_seconds(t) div 3600"))
    want = sorted((r["k"], n, r["gap_start"], r["gap_end"], r["gap_length"]) for n in ("v", "w") for r in runs.gap_runs(dense, ["k"], "at", n).collect())
    found = runs.gaps_of_rows(frame, "k", "at", ["v", "w"], most=40)
    assert sorted(tuple(r) for r in found.select("k", "signal", "gap_start", "gap_end", "gap_length").collect()) == want and len(want) > 50


def test_gap_queries_make_no_grid(spark):
    from gridwake.plans import REGISTRY

    from .oracle import DATA

    for name in ("gap_runs", "case_facts_with_gaps"):
        assert "sequence(" not in REGISTRY[name].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
