"""From raw CSV files to scores; every rule, the presets, features and phases against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest

from gridwake import cases, config
from gridwake.operators import features, phases, rules, runs
from gridwake.sources import raw

START = dt.datetime(2024, 1, 1, 8)
VENT = "PID,Obs_time,Agent,Agent_Fi,Agent_Et,ETCO2,FICO2,TV,RR,PEEP,PIP,FIN2O,ETN2O,FIO2,ETO2"


def write_tables(folder):
    at = lambda i: str(START + dt.timedelta(minutes=i))
    short = lambda i: (START + dt.timedelta(minutes=i)).strftime("%-m/%-d/%y %-H:%M")
    (folder / "cases.csv").write_text("PID,Age,Ht,Wt,Gender,OR_start,OR_end,Surgery_start,Surgery_end,Procedure\n" f"A,50,170,70,M,{at(0)},{at(30)},{at(0)},{at(25)},  Long   name \n" f"B,\\N,0,60,x,{short(0)},{short(30)},\\N,\\N,Other\n")
    vent = [f"A,{at(i)},s,3.0,2.5,{55 if i > 10 else 40},0,480,12,5,{18 + 0.8 * i:.1f},0,0,50,45" for i in range(25)]
    vent += [f"B,{short(i)},\\N,\\N,\\N,38,0,450,12,5,18,0,0,50,45" for i in range(20) if i != 7]
    vent += [f"B,{short(3)},\\N,\\N,\\N,0,0,450,12,5,99,0,0,50,45", f"B,{at(500)},S,1,1,1,1,1,1,1,1,1,1,1,1"]
    (folder / "vent.csv").write_text("\n".join([VENT, *vent]) + "\n")
    vitals = [f"A,{at(i)},80,\\N,120,80,60,{90 if i > 20 else 98}" for i in range(25)] + [f"B,{short(i)},\\N,70,,,,97" for i in range(20) if i != 7]
    (folder / "vitals.csv").write_text("\n".join(["PID,Obs_time,HRe,HRp,nSBP,nMAP,nDBP,SPO2", *vitals]) + "\n")
    (folder / "events.csv").write_text(f"PID,Event_time,Event_name\nA,{at(2)},Intubation done\nA,{at(24)},EXTUBATED\nA,{at(9)},Incision\nA,\\N,Intubated\n")


def test_from_files_to_scores(spark, tmp_path):
    write_tables(tmp_path)
    tables = [raw.read_csv(spark, str(tmp_path / f"{n}.csv")) for n in ("cases", "vent", "vitals", "events")]
    out = cases.process(*tables, validate=True)
    series = {(r["PID"], int(r["t_min"])): r for r in out.series.collect()}
    assert {p for p, _ in series} == {"A", "B"} and len([1 for p, _ in series if p == "A"]) == 25 and len([1 for p, _ in series if p == "B"]) == 20
    a = series[("A", 12)]
    assert a["IBW_kg"] == pytest.approx(50 + 2.3 * (170 / 2.54 - 60)) and a["TV_mlkg"] == pytest.approx(480 / a["IBW_kg"]) and a["BMI"] == pytest.approx(70 / 1.7**2)
    assert a["MAC_Et"] == pytest.approx(2.5 / (1.8 * 10 ** (-0.00269 * 10))) and a["PIP_slope"] == pytest.approx(0.8) and a["HR"] == 80 and a["Agent"] == "S"
    assert (a["phase"], series[("A", 1)]["phase"], series[("A", 3)]["phase"], series[("A", 15)]["phase"], series[("A", 24)]["phase"]) == ("maintenance", "pre_induction", "induction", "emergence", "post_emergence")
    b = series[("B", 3)]
    assert b["ETCO2"] == 0 and b["PIP"] is None and b["HR"] == 70 and b["IBW_kg"] is None and b["Gender"] == "U" and b["phase_source"] == "fallback"
    assert b["dq_reasons"] == "height missing" and series[("B", 7)]["SPO2"] is None and series[("B", 7)]["phase"] is not None
    hits = {(r["PID"], r["rule_id"], int(r["t_min"])): r["severity"] for r in out.flags.collect()}
    assert {m: s for (p, r, m), s in hits.items() if (p, r) == ("A", "etco2_high")} == {m: "warn" for m in range(11, 25)}
    assert {m: s for (p, r, m), s in hits.items() if (p, r) == ("A", "spo2_low")} == {m: "warn" for m in range(21, 25)}
    assert {m: s for (p, r, m), s in hits.items() if (p, r) == ("A", "pip_high")} == {m: "critical" if 18 + 0.8 * m >= 35 else "warn" for m in range(15, 25)}
    assert {m for p, r, m in hits if (p, r) == ("A", "desat_with_vent_issue")} == {21, 22, 23, 24}
    assert {m for p, r, m in hits if (p, r) == ("A", "pip_rising")} == set(range(4, 25)) == {m for p, r, m in hits if (p, r) == ("A", "compliance_concern")}
    episodes = {(r["PID"], r["rule_id"]): (r["t_start"], r["t_end"], r["severity"], r["n_flags"], r["duration"]) for r in out.episodes.collect()}
    assert episodes[("A", "pip_high")] == (15, 24, "critical", 10, 10) and episodes[("A", "spo2_low")] == (21, 24, "warn", 4, 4)
    found = {r["PID"]: r for r in out.cases.collect()}
    worst = {}
    for (p, _, m), s in hits.items():
        worst[(p, m)] = max(worst.get((p, m), 0), {"info": 1, "warn": 2, "critical": 3}[s])
    score = sum({1: 0, 2: 1, 3: 3}[w] for (p, _), w in worst.items() if p == "A") + 5 * sum(1 for p, r in episodes if p == "A" and r in config.COMPOSITES)
    assert found["A"]["anomaly_score"] == score and found["A"]["n_minutes"] == 25 and found["A"]["score_per_hour"] == pytest.approx(round(score / (25 / 60), 2))
    assert found["B"]["n_minutes"] == 19 and found["A"]["primary_agent"] == "S" and found["B"]["primary_agent"] == "N" and found["A"]["Procedure_short"] == "Long name"
    first = cases.worst_first(out.episodes.where("PID = 'A'"), 3).collect()
    assert [r["severity"] for r in first][0] == "critical" and len(first) == 3
    strict, lenient = ({(r["PID"], r["rule_id"], int(r["t_min"])) for r in cases.judged(out.series, p).flags.collect()} for p in ("strict", "lenient"))
    assert lenient < set(hits) and {m for p, r, m in strict if (p, r) == ("A", "pip_high")} == {m for m in range(25) if 18 + 0.8 * m >= 28 - 1e-9}
    empty = cases.process(*[t.limit(0) for t in tables])
    assert empty.cases.count() == empty.flags.count() == empty.episodes.count() == 0


MAINTENANCE = ("maintenance",)
#: Each rule again: severity of a minute, phases that it is silent in, minutes in a row.
BUT_MAINTENANCE, AWAKE = {"pre_induction", "induction", "emergence", "post_emergence"}, {"pre_induction", "emergence", "post_emergence"}


def above(x, warn, critical):
    return None if x is None else "critical" if x >= critical else "warn" if x >= warn else None


def below(x, warn, critical):
    return None if x is None else "critical" if x <= critical else "warn" if x <= warn else None


def ok(*tests):
    return all(x is not None for x in tests)


def expected(t, preset):
    pip, etco2, spo2 = {"default": ((30, 35), (50, 60), (92, 88)), "strict": ((28, 32), (48, 55), (94, 90)), "lenient": ((35, 40), (55, 65), (90, 85))}[preset]
    both = lambda *x: all(v is not None for v in x)
    say = lambda cond, s: s if cond else None
    tv, rr, agent = t["TV"], t["RR"], t["Agent"]
    return {
        "pip_high": (above(t["PIP"], *pip), (), 1),
        "pip_rising": (say(both(t["PIP_slope"], t["PIP"]) and t["PIP_slope"] >= 0.5 and t["PIP"] >= 20, "warn"), (), 5),
        "peep_high": (above(t["PEEP"], 12, 15), (), 1),
        "peep_zero_long": (say(both(t["PEEP"], tv, rr) and t["PEEP"] <= 0 and tv >= 200 and rr >= 6, "info"), BUT_MAINTENANCE, 15),
        "tv_low_mlkg": (below(t["TV_mlkg"], 4, 3) if t["likely_mech_vent"] else None, AWAKE, 1),
        "tv_high_mlkg": (above(t["TV_mlkg"], 10, 12), AWAKE, 1),
        "tv_abs_extreme": (say(tv is not None and (t["Age"] is None or t["Age"] >= 16) and (tv < 100 or tv > 1000), "warn"), AWAKE, 1),
        "rr_low": (below(rr, 6, 4) if tv is not None and tv >= 200 else None, AWAKE, 1),
        "rr_high": (above(rr, 20, 30), AWAKE, 1),
        "etco2_high": (above(t["ETCO2"], *etco2), (), 1),
        "etco2_low": (below(t["ETCO2"], 28, 22) if t["ETCO2"] is not None and t["ETCO2"] > 0 else None, {"pre_induction", "induction", "post_emergence"}, 1),
        "etco2_zero_vent": (say(both(t["ETCO2"], tv, rr) and t["ETCO2"] == 0 and tv >= 200 and rr >= 8, "critical"), {"pre_induction", "post_emergence"}, 3),
        "fio2_high_long": (say(both(t["FIO2"]) and t["FIO2"] >= 90 and t["t_min"] >= 15, "info"), BUT_MAINTENANCE, 30),
        "fio2_room_air_vent": (say(both(t["FIO2"], tv, rr) and t["FIO2"] <= 25 and tv >= 200 and rr >= 6, "warn"), {"pre_induction", "post_emergence"}, 5),
        "agent_high": (above(t["MAC_total_Et"], 1.5, 2.0), (), 1),
        "agent_low_maint": (say(both(t["MAC_Et"], agent) and 0.2 <= t["case_frac"] <= 0.8 and agent != "N" and t["MAC_Et"] < 0.3 and (t["ETN2O"] or 0) < 30, "warn"), BUT_MAINTENANCE, 1),
        "agent_drift": (say(both(t["Agent_Et_drift"], agent) and t["Agent_Et_drift"] >= (1.5 if agent == "D" else 0.5), "info"), BUT_MAINTENANCE, 5),
        "agent_fi_et_gap": (say(both(t["Agent_Fi_Et_gap"]) and 0.15 <= t["case_frac"] <= 0.85 and agent in ("S", "I", "D") and t["Agent_Fi_Et_gap"] >= {"S": 1, "I": 1, "D": 3}[agent], "info"), BUT_MAINTENANCE, 10),
        "spo2_low": (below(t["SPO2"], *spo2), (), 1),
        "hr_high": (above(t["HR"], 120, 140), (), 1),
        "hr_low": (below(t["HR"], 45, 40), (), 1),
        "map_low": (below(t["nMAP"], 60, 50), (), 1),
    }


def brute_flags(series, preset):
    out = {}
    for pid in {r["PID"] for r in series}:
        rows = sorted((r for r in series if r["PID"] == pid), key=lambda r: r["Obs_time"])
        judged = [expected(r, preset) for r in rows]
        for rule in judged[0]:
            on = [j[rule][0] if r["phase"] not in j[rule][1] else None for r, j in zip(rows, judged, strict=True)]
            at = 0
            while at < len(on):
                to = at
                while to < len(on) and on[to]:
                    to += 1
                if to - at >= judged[0][rule][2]:
                    out.update({(pid, rows[i]["Obs_time"], rule): on[i] for i in range(at, to)})
                at = max(to, at + 1)
        for r in rows:
            has = lambda *x: any((pid, r["Obs_time"], n) in out for n in x)  # noqa: E731, B023
            if has("pip_rising") and (r["TV_slope"] or 0) <= 5:
                out[(pid, r["Obs_time"], "compliance_concern")] = "warn"
            if has("etco2_high") and has("tv_low_mlkg", "rr_low"):
                out[(pid, r["Obs_time"], "hypoventilation_pattern")] = "warn"
            if has("spo2_low") and has("pip_high", "etco2_zero_vent", "tv_low_mlkg"):
                out[(pid, r["Obs_time"], "desat_with_vent_issue")] = "critical"
    return out


def random_series():
    rng = random.Random(7)
    choices = {
        "PIP": [None, 15, 21, 28, 30, 32, 34.9, 35, 40], "PIP_slope": [None, 0.2, 0.5, 0.9], "TV_slope": [None, 0, 5, 6], "PEEP": [None, 0, 0, 5, 12, 15], "TV": [None, 90, 150, 200, 480, 1100], "RR": [None, 3, 4, 6, 8, 12, 20, 30],
        "TV_mlkg": [None, 2, 3, 4, 7, 10, 12], "likely_mech_vent": [True, True, False], "Age": [None, 10, 16, 60], "ETCO2": [None, 0, 0, 20, 22, 28, 40, 48, 50, 55, 60, 65], "FIO2": [None, 21, 25, 50, 90, 95], "MAC_total_Et": [None, 1, 1.5, 2],
        "MAC_Et": [None, 0.1, 0.29, 0.3, 1], "ETN2O": [None, 0, 29, 30], "Agent_Et_drift": [None, 0.4, 0.5, 1.4, 1.5], "Agent_Fi_Et_gap": [None, 0.5, 1, 2.9, 3], "SPO2": [None, 85, 88, 90, 92, 94, 99], "HR": [None, 40, 45, 80, 120, 140], "nMAP": [None, 50, 60, 80],
        "Agent": [None, "S", "I", "D", "N"], "phase": [None, "pre_induction", "induction", "maintenance", "maintenance", "maintenance", "emergence", "post_emergence"],
    }
    out = []
    for pid in "xyz":
        now = {c: rng.choice(v) for c, v in choices.items()}
        for i in range(400):
            for c, v in choices.items():
                if rng.random() < (0.02 if c in ("phase", "FIO2", "PEEP", "TV", "RR", "Agent") else 0.12):
                    now[c] = rng.choice(v)
            if pid == "z" and 100 <= i < 180:
                now |= {"phase": "maintenance", "FIO2": 95, "PEEP": 0, "TV": 480, "RR": 12}
            numbers = {c: float(x) if isinstance(x, int) and not isinstance(x, bool) else x for c, x in now.items()}
            out.append({"PID": pid, "Obs_time": START + dt.timedelta(minutes=i), "t_min": float(i), "case_frac": i / 400, **numbers})
    return out


def test_every_rule_and_preset(spark):
    rows = random_series()
    kinds = {"PID": "string", "Obs_time": "timestamp", "Agent": "string", "phase": "string", "likely_mech_vent": "boolean"}
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in rows[0])).cache()
    fired = set()
    for preset in config.PRESETS:
        got = {(r["PID"], r["Obs_time"], r["rule_id"]): r["severity"] for r in rules.flags(frame, config.rules(preset)).collect()}
        assert got == brute_flags(rows, preset)
        fired |= {k[2] for k in got}
    assert fired == {*config.RULES, *config.COMPOSITES} and len(config.RULES) == 22


def test_features_against_plain_python(spark):
    rng = random.Random(3)
    rows = [("p", START + dt.timedelta(minutes=i), rng.choice([None, 10.0, 12.5, 20.0, 31.0]), rng.choice([400.0, None, 480.0]), 12.0, rng.choice([1.0, 2.0, None, 2.5]), 3.0, rng.choice([None, 0.0, 40.0]), "SDI N"[i // 20] if i // 20 != 3 else None, 60.0, 70.0, ["a", "b", None, "b"][i // 25 % 4]) for i in range(100)]
    frame = spark.createDataFrame(rows, "PID string, Obs_time timestamp, PIP double, TV double, RR double, Agent_Et double, Agent_Fi double, ETN2O double, Agent string, Age double, IBW_kg double, phase string")
    got = sorted(features.add_features(frame).collect(), key=lambda r: r["Obs_time"])
    begins = [i for i in range(100) if i and rows[i][11] != rows[i - 1][11]]
    for i, r in enumerate(got):
        for name, column in (("PIP_slope", 2), ("TV_slope", 3)):
            points = [(j, rows[j][column]) for j in range(max(0, i - 9), i + 1) if rows[j][column] is not None]
            if len(points) < 5:
                assert r[name] is None
            else:
                mx, my = statistics.mean(x for x, _ in points), statistics.mean(y for _, y in points)
                assert r[name] == pytest.approx(sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points))
        begin = max([b for b in begins if b <= i], default=0)
        near = [rows[j][5] for j in range(max(begin, i - 14), i + 1) if rows[j][5] is not None]
        want = statistics.median(near) if len(near) >= 5 else None
        assert r["Agent_Et_rollmed"] == want and r["Agent_Et_drift"] == (abs(rows[i][5] - want) if want is not None and rows[i][5] is not None else None)
        mac = {"S": 1.8, "I": 1.2, "D": 6.6}.get(rows[i][8])
        mac = mac and mac * 10 ** (-0.00269 * 20)
        share = rows[i][5] / mac if mac and rows[i][5] is not None else None
        nitrous = None if rows[i][7] is None else rows[i][7] / (104 * 10 ** (-0.00269 * 20))
        assert r["MAC_Et"] == (share if share is None else pytest.approx(share))
        assert r["MAC_total_Et"] == (None if share is None and nitrous is None else pytest.approx((share or 0) + (nitrous or 0)))
        assert r["likely_mech_vent"] == (rows[i][3] is not None) and r["primary_agent"] in ("D", "I", "S")


def test_phases_without_events_and_in_a_wrong_order(spark):
    t = lambda i: START + dt.timedelta(minutes=i)
    series = spark.createDataFrame([(p, t(i), 400.0 if i >= 5 else None) for p in "abc" for i in range(60)], "PID string, Obs_time timestamp, TV double")
    events = spark.createDataFrame([("a", t(30), "Airway removed"), ("a", t(10), "LMA #4 placed"), ("a", t(20), "intubation"), ("b", t(8), "Extubation"), ("a", t(200), "extubated")], "PID string, Event_time timestamp, Event_name string")
    case = spark.createDataFrame([("a", t(0), t(50)), ("b", t(2), t(40)), ("c", None, None)], "PID string, case_start timestamp, case_end timestamp")
    got = {r["PID"]: r for r in phases.boundaries(series, events, case).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["pre_end"], a["ind_end"], a["emerg_start"], a["post_start"], a["phase_source"]) == (t(10), t(20), t(20), t(30), "events")
    assert (b["pre_end"], b["ind_end"], b["emerg_start"], b["post_start"], b["phase_source"]) == (t(2), t(2), t(2), t(8), "mixed")
    assert (c["pre_end"], c["ind_end"], c["emerg_start"], c["post_start"], c["phase_source"]) == (t(5), t(5), None, None, "fallback")
    assert runs.severity_rank("x") is not None


def test_configuration():
    with pytest.raises(config.ConfigError):
        config.rules("none")
    with pytest.raises(config.ConfigError):
        config.check_parameters(n_cases=0)
    assert len(config.preset_hash(config.rules())) == 16 and config.preset_hash(config.rules()) != config.preset_hash(config.rules("strict"))
