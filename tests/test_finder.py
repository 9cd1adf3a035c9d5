"""Filters as data with their counts, shortlists, extracts and memoised results, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridwake.operators import finder
from gridwake.operators.finder import Filter
from gridwake.sources.memo import Memo

SETS = {
    "a": [Filter("age", "near", (50, 10)), Filter("sex", "eq", "f"), Filter("text", "any", ["knee", "HIP"])],
    "b": [Filter("has", "is", True), Filter("age", "least", 40), Filter("age", "most", 45)],
    "c": [],
    "d": [Filter("sex", "eq", "x"), Filter("age", "least", 0)],
}


def _records(spark, n=300):
    draw = random.Random(1)
    rows = [(f"p{i:03d}", draw.choice([None, draw.randrange(100)]), draw.choice(["F", "m", None]), draw.choice(["Knee swap", "hip", "heart", None]), draw.choice([True, False])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, age int, sex string, text string, has boolean")


def test_rows_left_after_each_filter(spark):
    rows, frame = _records(spark)
    plain = {
        "a": [lambda r: r[1] is not None and abs(r[1] - 50) <= 10, lambda r: (r[2] or "").lower() == "f", lambda r: any(w in (r[3] or "").lower() for w in ("knee", "hip"))],
        "b": [lambda r: r[4], lambda r: r[1] is not None and r[1] >= 40, lambda r: r[1] <= 45],
        "c": [],
        "d": [lambda r: False, lambda r: True],
    }
    want = {}
    for name, tests in plain.items():
        left = rows
        want[name, 0] = len(left)
        for i, test in enumerate(tests, 1):
            left = [r for r in left if test(r)]
            want[name, i] = len(left)
    assert {(r["name"], r["step"]): r["left"] for r in finder.step_counts(frame, SETS).collect()} == want
    assert frame.where(finder.passes(SETS["a"])).count() == want["a", 3]
    assert {r["left"] for r in finder.step_counts(frame.limit(0), SETS).collect()} == {0} and finder.step_counts(frame, {}).collect() == []


def test_filters_of_a_table(spark):
    table = spark.createDataFrame([("x", 2, "sex", "eq", '"F"'), ("x", 1, "age", "near", "[50, 10]"), ("y", 1, "has", "is", "false")], "name string, step int, field string, op string, value string")
    assert finder.from_table(table) == {"x": [Filter("age", "near", [50, 10]), Filter("sex", "eq", "F")], "y": [Filter("has", "is", False)]}
    with pytest.raises(ValueError):
        finder.condition(Filter("a", "like", "b"))


CASES = [("7", "high airway pressure. calm", True), ("8", "pressure rose. the airway was clear", False), ("9", "nothing of it", True), ("10", "airway", False), ("11", None, False)]


def test_a_shortlist_by_words(spark):
    frame = spark.createDataFrame(CASES, "id string, text string, has boolean")
    got = [(r["id"], r["place"], r["method"]) for r in finder.shortlist(frame, "id", "text", "airway pressure").orderBy("place").collect()]
    assert got == [("7", 1, "keyword"), ("8", 2, "keyword"), ("10", 3, "keyword")]
    named = [r["id"] for r in finder.shortlist(frame, "id", "text", "is 9 like airway pressure?", most=2).orderBy("place").collect()]
    assert named == ["9", "7"]
    kept = [r["id"] for r in finder.shortlist(frame, "id", "text", "airway pressure", [Filter("has", "is", True)]).orderBy("place").collect()]
    assert kept == ["7", "9"]  # 9 passes the filter, though no word is in it
    assert finder.shortlist(frame, "id", "text", "airway", [Filter("text", "eq", "none")]).collect() == []


def test_a_shortlist_by_vectors_keeps_places_for_words(spark):
    frame = spark.createDataFrame(CASES, "id string, text string, has boolean")
    vectors = spark.createDataFrame([("9", [1.0, 0.0]), ("10", [1.0, 1.0]), ("11", [0.0, 1.0]), ("99", [1.0, 0.0])], "id string, vector array<double>")
    got = finder.shortlist(frame, "id", "text", "airway pressure", vectors=vectors, query_vector=[1.0, 0.0], most=3)
    assert {(r["id"], r["method"]) for r in got.collect()} == {("7", "keyword"), ("8", "keyword"), ("9", "embedding")}
    first = finder.extracts(got, frame, "id", "text", "has", most=2, chars=8)
    assert sorted((r["place"], r["id"], r["extract"]) for r in first.collect()) == [(1, "7", "high air …"), (2, "9", "nothing  …")]


def test_results_are_computed_once_for_what_they_depend_on(spark, tmp_path):
    asked = []

    def compute(ids):
        asked.append(sorted(r["id"] for r in ids.collect()))
        return ids.where("id <> 'none'").select("id", F.length("id").alias("n"))

    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    memo = Memo(spark, str(tmp_path), "id string, n int", source="s", preset="p", thresholds={"a": 1})
    rows, n = memo.fetch(ids("a", "bb", "a", None, "none"), compute)
    assert n == 3 and sorted(map(tuple, rows.collect())) == [("a", 1), ("bb", 2)]
    rows, n = memo.fetch(ids("bb", "ccc", "none"), compute)
    assert n == 1 and sorted(map(tuple, rows.collect())) == [("bb", 2), ("ccc", 3)] and asked == [["a", "bb", "none"], ["ccc"]]
    again = Memo(spark, str(tmp_path), "id string, n int", thresholds={"a": 1}, preset="p", source="s")
    assert again.fetch(ids("a"), compute)[1] == 0
    other = Memo(spark, str(tmp_path), "id string, n int", source="s", preset="p", thresholds={"a": 2})
    assert other.fetch(ids("a"), compute)[1] == 1
    with pytest.raises(Exception, match="broken"):
        memo.fetch(ids("d"), lambda rows: rows.select("id", F.raise_error(F.lit("broken")).cast("int").alias("n")))
    assert memo.fetch(ids("d"), compute)[1] == 1
