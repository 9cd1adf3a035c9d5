"""States of shards that merge, and scans that go on: counts equal those of the whole, and only what changed is computed."""

import random

import pytest
from pyspark.sql import functions as F

from gridwake.operators import partials
from gridwake.sources.scan import Scan, SourceChanged, by_content, by_file, with_file


def _rows(spark, n=600):
    draw = random.Random(9)
    rows = [(draw.randrange(-3, 100_000) if i % 7 else 5, i % 6, draw.choice([None, float("nan"), -1.0, 0.0, 10.0, 10.5, draw.uniform(0, 10)]), draw.choice([None, "a", "b"])) for i in range(n)]
    rows = [(abs(c), s, v, p) for c, s, v, p in rows] + [(None, 0, 1.0, "a")]
    return rows, spark.createDataFrame(rows, "case long, shard int, x double, phase string")


def test_merged_states_are_those_of_the_whole(spark):
    rows, frame = _rows(spark)
    state = lambda f, keys: partials.states(f, "case", keys, {"x": (0.0, 10.0)}, phase="phase")
    parts = state(frame, ["shard"])
    halves = [partials.merged(parts.where(f"shard % 2 = {i}")) for i in (0, 1)]
    got = {r[:3]: r[3:] for r in map(tuple, partials.counts(partials.merged(*halves)).collect())}
    assert got == {r[:3]: r[3:] for r in map(tuple, partials.counts(state(frame, [])).collect())}
    known = [r for r in rows if r[0] is not None]
    assert got["case", "all", partials.WHOLE] == (len(known), len({r[0] for r in known}))
    assert got["phase", "a", partials.WHOLE] == (sum(r[3] == "a" for r in known), len({r[0] for r in known if r[3] == "a"}))
    assert got["signal", "x", -1][0] == sum(r[2] == -1.0 for r in known) and got["signal", "x", 100][0] == sum(r[2] == 10.5 for r in known)
    assert got["signal", "x", 99][1] == len({r[0] for r in known if r[2] is not None and 9.9 <= r[2] <= 10})
    whole = {r[:2]: r[2:] for r in map(tuple, partials.totals(parts).collect())}
    assert whole["signal", "x"][1] == len({r[0] for r in known if r[2] is not None and r[2] == r[2]})


def test_small_cells_are_hidden(spark):
    kinds = "kind string, name string, n long, cases long"
    rows = [("case", "all", 900, 100), ("rule", "few", 5, 3), ("rule", "most", 90, 95), ("rule", "half", 60, 50), ("rule", "every", 100, 100), ("rule", "none", 0, 0)]
    got = {r["name"]: (r["n"], r["cases_shown"], r["share"]) for r in partials.with_shares(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {"all": (900, "100", 100.0), "few": (None, "<11", None), "most": (90, "95", None), "half": (60, "50", 50.0), "every": (100, "100", 100.0), "none": (0, "0", 0.0)}


def test_no_rows(spark):
    none = _rows(spark)[1].where("false")
    assert partials.counts(partials.merged(partials.states(none, "case", ["shard"], {"x": (0.0, 1.0)}, phase="phase"))).collect() == []


class _Table:
    """A table that changes, and a computation that tells which shards it saw."""

    def __init__(self, spark, rows):
        self.spark, self.rows = spark, rows

    def open(self):
        return self.spark.createDataFrame(self.rows, "shard string, x long")

    def prints(self, rows):
        return by_content(rows, "shard")

    def compute(self, rows):
        return rows.groupBy("shard").agg(F.sum("x").alias("x"))


def _held(scan):
    return {r["shard"]: r["x"] for r in scan.results().collect()}


def test_only_changed_shards_are_computed(spark, tmp_path):
    table, scan = _Table(spark, [("a", 1), ("a", 2), ("b", 5), ("c", 7)]), Scan(spark, str(tmp_path / "scan"))
    run = lambda: scan.update(table.open, table.prints, table.compute)
    assert scan.results() is None and not scan.matches(table.open(), table.prints)
    assert (run(), _held(scan)) == (3, {"a": 3, "b": 5, "c": 7})
    table.rows.reverse()
    assert (run(), scan.version()) == (0, 1) and scan.matches(table.open(), table.prints)
    table.rows = [("a", 1), ("a", 2), ("b", 6), ("b", 6), ("d", 1)]  # b changed, c is gone, d is new
    assert not scan.matches(table.open(), table.prints)
    assert (run(), _held(scan)) == (2, {"a": 3, "b": 12, "d": 1})
    table.rows = [("a", 1), ("a", 2)]
    assert (run(), _held(scan), scan.version()) == (0, {"a": 3}, 3)
    scan.tidy()
    assert _held(scan) == {"a": 3} and len(list((tmp_path / "scan" / "results").glob("run=*"))) == 1


def test_a_source_that_changes_during_a_scan_publishes_nothing(spark, tmp_path):
    table, scan = _Table(spark, [("a", 1)]), Scan(spark, str(tmp_path / "scan"))
    scan.update(table.open, table.prints, table.compute)

    def meddling(rows):
        out = table.compute(rows)
        table.rows = [*table.rows, ("b", 3)]
        return out

    table.rows = [("a", 1), ("b", 2)]
    with pytest.raises(SourceChanged):
        scan.update(table.open, table.prints, meddling)
    assert _held(scan) == {"a": 1} and scan.version() == 1
    assert not list((tmp_path / "scan" / "work").iterdir())


def test_a_run_that_fails_leaves_what_was_there(spark, tmp_path):
    table, scan = _Table(spark, [("a", 1)]), Scan(spark, str(tmp_path / "scan"))
    scan.update(table.open, table.prints, table.compute)
    table.rows = [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        scan.update(table.open, table.prints, lambda rows: rows.select("shard", (F.col("x") / F.lit(0)).alias("x")))
    (tmp_path / "scan" / "manifest" / "v2").mkdir()  # a manifest without its mark of success
    assert _held(scan) == {"a": 1} and scan.version() == 1


def test_files_are_shards_by_their_size_and_time(spark, tmp_path):
    home = tmp_path / "table"
    spark.range(10).coalesce(1).write.parquet(str(home))
    opened = lambda: with_file(spark.read.schema("id long").parquet(str(home)))
    scan = Scan(spark, str(tmp_path / "scan"))
    total = lambda rows: rows.groupBy("shard").agg(F.sum("id").alias("x"))
    assert scan.update(opened, by_file, total) == 1
    spark.range(100, 110).coalesce(1).write.mode("append").parquet(str(home))
    assert scan.update(opened, by_file, total) == 1 and sum(_held(scan).values()) == 45 + 1045
