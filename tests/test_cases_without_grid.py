"""Cases from the minutes that have rows: the same as from the whole grid, without its rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridwake import cases
from gridwake.operators import features, grid, runs
from gridwake.session import cut

START = dt.datetime(2024, 1, 1, 8)
SIGNALS = ["Agent_Fi", "Agent_Et", "ETCO2", "TV", "RR", "PEEP", "PIP", "ETN2O", "FIO2"]


def at(minute: float) -> str:
    return (START + dt.timedelta(minutes=minute)).strftime("%Y-%m-%d %H:%M:%S")


def tables(spark):
    """Cases with gaps of one to thirty minutes, one that spans more than the grid takes, one without a known start, and rows without a case."""
    rng = random.Random(11)
    minutes = {p: sorted(rng.sample(range(120), 80) if p != "gaps" else rng.sample(range(600), 60)) for p in ("a", "b", "gaps", "unknown")}
    minutes["wide"] = [*range(0, 40), *range(5000, 5040)]
    minutes["one"], minutes[None] = [3], [1, 5]
    vent, vitals = [], []
    for pid, places in minutes.items():
        now = {}
        for m in places:
            for name, values in {"Agent_Fi": (1, 2.5, 4), "Agent_Et": (0.5, 1, 2), "ETCO2": (0, 20, 55, 62), "TV": (60, 250, 480, 1200), "RR": (3, 12, 25), "PEEP": (0, 13), "PIP": (18, 31, 36), "ETN2O": (0, 40), "FIO2": (21, 60, 95)}.items():
                if name not in now or rng.random() < 0.2:
                    now[name] = str(rng.choice(values)) if rng.random() < 0.9 else None
            now["PIP"] = str(20 + (m % 30) * 0.7)
            vent.append((pid, at(m), rng.choice(["S", "D", "N", "x", None]), *[now[s] for s in SIGNALS]))
            if m % 3:
                vitals.append((pid, at(m + 0.5), "80", rng.choice(["85", "99", None]), rng.choice(["45", "70"])))
    vent += [vent[0], ("a", "never", *[None] * 10), ("gaps", at(250.2), *[None] * 10)]
    people = [(p, "50", "170", "70", "M", at(2) if p == "a" else None, at(100) if p == "a" else None, "P") for p in ("a", "b", "gaps", "wide", "one", "none")]
    events = [("a", at(10), "Intubation"), ("a", at(90), "Extubation"), ("gaps", at(4), "intubated"), ("b", at(50), "Airway removed")]
    return (
        spark.createDataFrame(people, "PID string, Age string, Ht string, Wt string, Gender string, Surgery_start string, Surgery_end string, Procedure string"),
        spark.createDataFrame(vent, "PID string, Obs_time string, Agent string, " + ", ".join(f"{s} string" for s in SIGNALS)),
        spark.createDataFrame(vitals, "PID string, Obs_time string, HRe string, SPO2 string, nMAP string"),
        spark.createDataFrame(events, "PID string, Event_time string, Event_name string"),
    )


def test_cases_are_those_of_the_grid(spark):
    raw = tables(spark)
    whole, told = cases.process(*raw), cases.scored(*raw)
    assert told.dtypes == whole.cases.dtypes
    want = sorted(whole.cases.collect(), key=lambda r: r["PID"])
    assert sorted(told.collect(), key=lambda r: r["PID"]) == want and {r["PID"] for r in want} == {"a", "b", "gaps", "wide", "one", "unknown"}
    assert sum(r["composite_episodes"] for r in want) > 5 and len({r["rule_id"] for r in whole.flags.collect()}) > 15
    rows = cut(cases.labelled(*raw, whole=False))
    assert rows.count() == rows.select("PID", "Obs_time").distinct().count() < whole.series.count() - 500
    assert {*whole.series.columns} == {*rows.columns} - {cases.PLACE}
    assert rows.select(whole.series.columns).exceptAll(whole.series).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_left_out_steps_count(spark, seed):
    """Runs, slopes and medians of rows that leave steps out are those of the rows with the steps put in."""
    rng = random.Random(seed)
    steps = [(k, i, *((rng.random() < 0.8, rng.choice([None, 1.0, 2.5, 7.0])) if rng.random() < 0.85 else (None, None))) for k in "xy" for i in range(150)]
    frame = spark.createDataFrame(steps, "k string, at long, flag boolean, v double")

    def judged(rows, place):
        rows = runs.all_long_runs(rows, ["k"], ["at"], {"long": (F.col("flag"), 4), "any": (F.col("flag"), 1)}, place)
        rows = features.rolling_slopes(rows, {"slope": "v"}, ["k"], ["at"], place=place)
        rows = features.rolling_median(rows, "v", ["k"], ["at"], "median", place=F.col(place) if place else None)
        return sorted(rows.where("flag is not null").collect())

    assert judged(frame.where("flag is not null"), "at") == judged(frame, None)


def test_few_rows_a_step_are_collapsed_as_many(spark):
    rng = random.Random(5)
    rows = [(k, START + dt.timedelta(seconds=rng.randrange(1200)), rng.choice([None, 0.0, 1.5, -2.25, 7.1]), rng.choice([None, 3.3]), rng.choice(["a", "b", "c", None])) for k in ("x", "y", None) for _ in range(90)]
    frame = spark.createDataFrame(rows, "k string, at timestamp, v double, w double, c string")
    few, many = (sorted(f(frame, ["k"], "at", ["v", "w"], ["c"]).collect(), key=str) for f in (grid.collapse_few, grid.collapse))
    assert few == many and len(few) > 50
