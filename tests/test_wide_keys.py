"""Gaps of users whose events span more hours than the grid's limit."""

import datetime as dt

import duckdb
import pytest

from gridwake.operators.grid import MOST_STEPS
from gridwake.plans import REGISTRY

from .oracle import differences

#: user -> hour -> (value, k): narrow, wide in one step, wide with a row between, wide with one signal that stops.
USERS = {
    1: {0: (1.0, 1), 1: (2.0, 2), 4: (3.0, 3)},
    2: {0: (1.0, 1), 3 * MOST_STEPS: (2.0, 2)},
    3: {0: (1.0, 1), MOST_STEPS: (None, 2), 2 * MOST_STEPS: (3.0, 3), 2 * MOST_STEPS + 1: (4.0, 4)},
    4: {0: (1.0, 1), 1: (200.0, None), MOST_STEPS + 1: (None, 3)},
    5: {7: (5.0, 5)},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide"))
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=9), "click", v, f'{{"k": {k}}}' if k else "{}") for u, steps in USERS.items() for h, (v, k) in steps.items()]
    rows = [(i, *r) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def by_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    return con.execute(REGISTRY[name].sql).df()


def lengths(signal):
    """Of all gaps, by plain Python."""
    at = {u: sorted(h for h, values in steps.items() if values[signal] is not None) for u, steps in USERS.items()}
    return {u: [b - a - 1 for a, b in zip(hours, hours[1:]) if b - a > 1] for u, hours in at.items()}


def test_facts_tell_gaps_of_any_length(spark, folder):
    got = REGISTRY["case_facts_with_gaps"].run(spark, folder).toPandas()
    inside = {u: ", ".join(n for n, signal in (("k", 1), ("value", 0)) if lengths(signal)[u]) for u in USERS}
    assert inside == {1: "k, value", 2: "k, value", 3: "k, value", 4: "k", 5: ""}
    assert {u: f.partition(" Interior gaps: ")[2].rstrip(".") for u, f in zip(got["user_id"], got["facts"])} == inside
    assert not differences(got, by_sql("case_facts_with_gaps", folder))


def test_profile_counts_gaps_of_any_length(spark, folder):
    got = REGISTRY["gap_profile"].run(spark, folder).toPandas()
    gaps = [n for found in lengths(0).values() for n in found]
    assert (got["n_gaps"][0], got["longest"][0], got["n_long_cases"][0]) == (len(gaps), max(gaps), 2) == (3, 3 * MOST_STEPS - 1, 2)
    assert not differences(got, by_sql("gap_profile", folder))
