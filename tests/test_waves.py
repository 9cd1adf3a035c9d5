"""Waveforms of many files on one time axis, and channels from counts of values, against plain Python."""

import base64
import datetime as dt
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.sources import waveform

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def _write(path, packets):
    """An archive of packets (seconds after START or None, signal, rate, raw samples)."""
    body = ""
    for seq, (at, signal, hz, raw) in enumerate(packets):
        when = f' datetime="{(START + dt.timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")}"' if at is not None else ""
        wave = base64.b64encode(struct.pack(f"<{len(raw)}h", *raw)).decode()
        body += f'<cpc seq="{seq}"{when}><mg name="{signal}"><m name="Wave">{wave}</m><m name="PointsBytes">2</m><m name="Gain">0.25</m><m name="Hz">{hz}</m></mg></cpc>\n'
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"<cpcArchive>\n{body}</cpcArchive>\n")


def _axis(packets, gap):
    """Plain Python: (session, second, value) of each sample that stays, for packets (second, file, seq, hz, values)."""
    reached, session, out = None, 0, []
    for at, _, _, hz, values in sorted(packets):
        if reached is None or at - reached > gap:
            session += 1
        for i, v in enumerate(values):
            if reached is None or at + i / hz >= reached - 1e-9:
                out.append((session, round(at + i / hz, 6), v))
        reached = max(reached if reached is not None else at, at + len(values) / hz)
    return out


@pytest.fixture
def archives(tmp_path):
    draw = random.Random(7)
    want = {}
    for case in ("one", "two"):
        for f in range(5):
            packets = []
            for _ in range(12):
                signal, hz = draw.choice([("ART", 4), ("PLETH", 8)])
                at = draw.randrange(0, 400) / 2
                raw = [draw.choice([-32768, *range(300, 500, 7)]) for _ in range(draw.randrange(0, 30))]
                packets.append((at, signal, hz, raw))
                if raw:
                    want.setdefault((case, signal), []).append((at, f"{f}.xml", len(packets) - 1, hz, [None if x == -32768 else x * 0.25 for x in raw]))
            _write(tmp_path / "waves" / case / f"{f}.xml", packets)
    return str(tmp_path / "waves" / "*" / "*.xml"), want


def test_many_files_make_one_axis(spark, archives):
    path, packets = archives
    rows = waveform.assembled(waveform.read(spark, path), ["case", "signal"], ["file", "seq"], gap=3)
    at = F.col("at").cast("double") + F.col("place") / F.col("hz")
    each = rows.select("case", "signal", "session", "at", "hz", F.posexplode("values").alias("place", "value")).select("case", "signal", "session", F.round(at - START.timestamp(), 6).alias("t"), F.when(~F.isnan("value"), F.col("value")).alias("v"))
    got = {}
    for r in each.collect():
        got.setdefault((r["case"], r["signal"]), []).append((r["session"], r["t"], r["v"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(_axis(v, 3), key=str) for k, v in packets.items()}
    assert max(s for v in got.values() for s, _, _ in v) > 2
    told = {(r["case"], r["signal"], r["session"]): r["samples"] for r in waveform.sessions(rows, ["case", "signal"]).collect()}
    for key, samples in got.items():
        for session in {s for s, _, _ in samples}:
            assert told[(*key, session)] == sum(s == session for s, _, _ in samples)


def _packets(spark, rows):
    kinds = "case string, signal string, file string, seq long, start timestamp, hz double, values array<double>"
    return spark.createDataFrame(rows, kinds)


def test_packets_without_a_place_come_whole(spark):
    at = START.replace(tzinfo=None)
    rows = [("c", "S", "f", 1, None, 4.0, [1.0]), ("c", "S", "f", 2, at, None, [2.0]), ("c", "S", "f", 3, at, 0.0, [3.0]), ("c", "S", "f", 4, at, 4.0, []), ("c", "S", "f", 5, at, 4.0, None), ("c", "S", None, 6, at, 4.0, [6.0])]
    got = {r["seq"]: (r["session"], r["values"]) for r in waveform.assembled(_packets(spark, rows), ["case", "signal"], ["file", "seq"], 1).collect()}
    assert got == {1: (None, [1.0]), 2: (None, [2.0]), 3: (None, [3.0]), 4: (None, []), 5: (None, None), 6: (1, [6.0])}
    assert waveform.assembled(_packets(spark, []), ["case", "signal"], ["file", "seq"], 1).collect() == []


def test_quantiles_from_counts_are_exact_and_merge(spark):
    draw = random.Random(3)
    values = {s: [draw.choice([float("nan"), draw.randrange(-2000, 2000) * 0.25]) for _ in range(draw.randrange(1, 300))] for s in "ABCD"} | {"E": [float("nan")] * 3, "F": [7.0]}
    rows = [("c", s, "f", i, None, 4.0, v[i : i + 20]) for s, v in values.items() for i in range(0, len(v), 20)]
    packets = _packets(spark, rows)
    parts = [waveform.value_counts(packets.where(f"seq % 40 = {k}"), ["signal"]) for k in (0, 20)]
    merged = parts[0].unionByName(parts[1]).groupBy("signal", "value").agg(F.sum("n").alias("n"))
    for counts in (merged, waveform.value_counts(packets, ["signal"])):
        got = {r["signal"]: r for r in waveform.quantiles(counts, ["signal"], (0.05, 0.5, 0.95)).collect()}
        for s, v in values.items():
            data = [x for x in v if x == x]
            assert (got[s]["n"], got[s]["whole"]) == (len(data), len(v))
            if data:
                assert np.allclose(got[s]["q"], np.percentile(data, [5, 50, 95])) and (got[s]["low"], got[s]["high"]) == (min(data), max(data))


def test_significant_bits_bound_the_state(spark):
    values = [random.Random(i).uniform(1, 2) for i in range(3000)] + [-5e-300, 0.0, 1e300]
    packets = _packets(spark, [("c", "S", "f", 1, None, 4.0, values)])
    counts = waveform.value_counts(packets, ["signal"], bits=8)
    assert counts.count() <= 128 + 1 + 3
    q = waveform.quantiles(counts, ["signal"], (0.5,)).first()["q"][0]
    assert abs(q - np.median(values)) < np.median(values) / 128


def test_states_and_coverage(spark):
    calm, wild = [80 + (i % 40) * 1.0 for i in range(200)], [450.0 if i % 2 else -450.0 for i in range(200)]
    rows = [("c", "ART", "f", 1, None, 100.0, calm), ("c", "BAD", "f", 1, None, 100.0, wild), ("c", "IDLE", "f", 1, None, 100.0, [5.0] * 50), ("c", "NONE", "f", 1, None, 100.0, [float("nan")] * 50), ("c", "VOID", "f", 1, None, 100.0, [])]
    got = {r["signal"]: r for r in waveform.summary(_packets(spark, rows), ["case", "signal"], ["ART", "BAD"]).collect()}
    assert {s: r["state"] for s, r in got.items()} == {"ART": "active", "BAD": "implausible", "IDLE": "idle", "NONE": "nodata", "VOID": "nodata"}
    assert (got["ART"]["seconds"], got["ART"]["valid"], got["ART"]["median"]) == (2.0, 1.0, 99.5) and got["NONE"]["valid"] == 0.0 and got["VOID"]["seconds"] == 0.0
