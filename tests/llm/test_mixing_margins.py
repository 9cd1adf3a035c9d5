"""Margins of the mix are met for rare cells and tied margins, too."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwake.llm import mixing


def test_mixing_meets_targets_of_rare_cells(spark):
    """A hot source and a rare one whose rates are far over the mean's: nothing is capped, all margins are met."""
    shape = [("hot", "en", 3300), ("a", "en", 2500), ("a", "de", 900), ("b", "en", 2200), ("b", "de", 1095), ("rare", "de", 5)]
    rows = [(i, s, t) for i, (s, t) in enumerate((s, t) for s, t, n in shape for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string")
    out = mixing.mixed(docs, {"source": F.col("source"), "lang": F.col("lang")}, F.lit(100), "doc_id").cache()
    report = mixing.reached(out, ["source", "lang"]).collect()
    assert {(r["margin"], r["value"]) for r in report} == {("source", s) for s in ("hot", "a", "b", "rare")} | {("lang", "en"), ("lang", "de")}
    assert all(abs(r["expected"] / r["target"] - 1) <= mixing.TOLERANCE for r in report)
    assert all(abs(r["kept"] - r["target"]) < 0.06 for r in report)
    assert out.agg(F.max("mix_probability")).first()[0] == 1.0 and out.agg(F.avg("mix_probability")).first()[0] < 1 / 4.0


def test_raking_goes_on_until_margins_are_met(spark):
    cells = spark.createDataFrame([("a", "x", 1000), ("a", "y", 10), ("b", "x", 10), ("b", "y", 1000)], "s string, l string, tokens long")
    shares = lambda c, *v: spark.createDataFrame(v, f"{c} string, share double")
    targets = {"s": shares("s", ("a", 0.6), ("b", 0.4)), "l": shares("l", ("x", 0.4), ("y", 0.6))}
    got = mixing.raked(cells, ["s", "l"], targets).toPandas()
    for m, goal in (("s", {"a": 0.6, "b": 0.4}), ("l", {"x": 0.4, "y": 0.6})):
        assert all(abs(w / 2020 / goal[v] - 1) <= 1.01 * mixing.TOLERANCE for v, w in got.groupby(m)["weight"].sum().items())
    with pytest.warns(UserWarning, match="off by"):
        mixing.raked(cells.where("tokens > 10"), ["s", "l"], targets)


def test_few_and_many_cells_are_fitted_alike(spark, monkeypatch):
    rows = [(f"s{i % 7}", f"l{i % 3}", 10 + i * 37 % 101) for i in range(60)] + [("s8", "l0", 0)]
    cells = spark.createDataFrame(rows, "s string, l string, tokens long").groupBy("s", "l").agg(F.sum("tokens").alias("tokens"))
    weights = []
    for few in (1000, 0):
        monkeypatch.setattr(mixing, "FEW_CELLS", few)
        weights.append({(r["s"], r["l"]): r["weight"] for r in mixing.raked(cells, ["s", "l"]).collect()})
    assert weights[0].keys() == weights[1].keys() and all(abs(weights[0][k] - v) <= 1e-9 * max(1.0, abs(v)) for k, v in weights[1].items())
