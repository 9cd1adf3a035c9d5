"""Sources and sinks on small files."""

from __future__ import annotations

import base64
import struct

import pytest
from pyspark.errors import AnalysisException

from gridwake.sources import inspect, raw, sinks, waveform


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' PID , Obs_time\nx,1\n\\N,2\ny,\\N\nx,O\n')
    df = raw.read_csv(spark, str(tmp_path / "a.csv"), {"Obs_time": "at"})
    assert df.columns == ["PID", "at"] and [tuple(r) for r in df.collect()] == [("x", "1"), (None, "2"), ("y", None), ("x", "O")]
    assert raw.read_csv(spark, str(tmp_path / "none.csv"), optional=["PID"]).count() == 0
    with pytest.raises(AnalysisException):
        raw.read_csv(spark, str(tmp_path / "none.csv"))
    assert [tuple(r) for r in raw.sample_entities(df, "PID", 2, 5).collect()] == [("x", 2)]
    assert raw.of_entities(df, df.where("at = '1'"), "PID").count() == 2
    shards = {r["PID"]: r["shard"] for r in raw.sharded(df, "PID", 4).collect()}
    assert shards[None] == 0 and all(0 <= s < 4 for s in shards.values())


def test_json_lines_and_articles(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","title":"t","abstract":"a","year":"2001"}\n\nnot json\n{"id":"1","title":"u"}\n{"id":"","title":"v"}\n{"id":"3","title":"w","year":"x"}\n{"id":"4","title":"w"}\n[1]\n')
    good, bad = raw.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id string, title string, abstract string, year string")
    assert sorted(r["line"] for r in bad.collect()) == ["[1]", "not json"] and good.count() == 5
    taken, left = raw.import_articles(good, good.where("id = '4'"))
    assert [(r["id"], r["title"]) for r in taken.collect()] == [("1", "t")]
    assert sorted((r["id"], r["reason"]) for r in left.collect()) == [("", "no id"), ("1", "duplicate id"), ("3", "bad year"), ("4", "known id")]
    taken, left = raw.import_articles(good.limit(0))
    assert taken.count() == left.count() == 0


def test_waveform(spark, tmp_path):
    wave = base64.b64encode(struct.pack("<6h", 1, 2, -32768, -32767, 5, 600) + b"\0").decode()
    flat = base64.b64encode(struct.pack("<2h", 7, 7)).decode()
    entry = lambda n, v: f'<m name="{n}">{v}</m>'
    one = "".join(entry(*x) for x in (("Wave", wave), ("Gain", "0.5"), ("Offset", "1"), ("Hz", "2")))
    two = entry("Wave", flat) + entry("Hz", "1")
    (tmp_path / "a.xml").write_text(f'<cpcArchive><cpc seq="1" datetime="2020-01-01T00:00:00"><mg name="ART">{one}</mg><mg name="PAP">{two}</mg><mg name="BAD">{entry("Wave", "%%")}</mg></cpc></cpcArchive>')
    packets = waveform.read(spark, str(tmp_path / "a.xml")).cache()
    values = {r["signal"]: r["values"] for r in packets.collect()}
    assert [x for x in values["ART"] if x == x] == [1.5, 2.0, 3.5, 301.0] and len(values["ART"]) == 6 and values["PAP"] == [7.0, 7.0] and values["BAD"] == []
    times = [str(r["at"].time()) for r in waveform.timed(packets).where("signal = 'ART'").orderBy("at").collect()]
    assert times == ["00:00:00", "00:00:00.500000", "00:00:02", "00:00:02.500000"]
    assert {r["signal"]: r["state"] for r in waveform.channel_states(packets, ["ART"]).collect()} == {"ART": "implausible", "PAP": "idle", "BAD": "nodata"}
    assert {r["signal"]: r["values"] for r in waveform.read(spark, str(tmp_path / "a.xml"), {"PAP": 2.0}).collect()}["PAP"] == [14.0, 14.0]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.write_whole(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.preview(spark.range(9), str(tmp_path / "p"), ["id"], 2)
    assert [r["id"] for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()] == ["0", "1"]
    sinks.write_meta(spark, {"b": 1}, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"b": 1}'


def test_inspect(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None, "1"), ("2", "2", "y", "", "1"), ("1", "1.5", "x", None, "1"), ("4", "1", "3", None, "z")], "a string, b string, c string, d string, `e f` string")
    got = {r["column"]: (r["kind"], r["null_pct"], r["n_distinct"]) for r in inspect.columns(df).collect()}
    assert got == {"a": ("integer", 0, 3), "b": ("number", 0, 3), "c": ("text", 0, 3), "d": ("empty", 100, 0), "e f": ("mixed", 0, 2)}
    assert inspect.duplicates(df) == 1 and inspect.duplicates(df.limit(0)) == 0
    assert inspect.linked(df, df.where("a = '1'"), "a") == pytest.approx(100 / 3)
