"""Grades of handoffs: hits, claims that the timeline doesn't have, and readings that are missing."""

import pytest

from gridwake.operators import handoff

ART = [(m, 60.0, None, 98.0) for m in range(10, 17)]
DESAT = [(20, 80.0, None, 88.0), (21, 80.0, None, 86.0)]
PHENYL, NOREPI = ("Phenylephrine", 12, None), ("Norepinephrine", 2, 10)
HIT, MISS, BAD = "mentioned", "missed", "unsupported"
CASES = [
    (ART, [PHENYL], "Arterial hypotension was sustained under 65 mmHg for minutes 10 to 16. Phenylephrine 100 mcg at minute 12.", {(HIT, "hypotension"), (HIT, "vasopressor")}),
    ([(m, 60.0, None, 98.0) for m in range(6)], [], "Hypotension lasted 5 minutes.", {(BAD, "hypotension")}),
    ([(4, 80.0, None, 88.0), (5, 80.0, None, 97.0)], [], "stable", set()),
    (DESAT, [], "nothing", {(MISS, "desaturation")}),
    ([(20, 80.0, None, 88.0), (22, 80.0, None, 86.0)], [], "nothing", set()),
    ([(0, None, 60.0, 98.0), (6, None, 58.0, 97.0)], [], "low MAP of 58 at minute 6", {(HIT, "hypotension")}),
    ([(0, None, 60.0, 98.0), (5, None, 58.0, 97.0)], [], "ok", set()),
    ([(0, None, 60.0, 98.0), (12, None, 58.0, 97.0)], [], "ok", set()),
    ([(0, 80.0, 50.0, 98.0), (6, 82.0, 48.0, 97.0)], [], "ok", set()),
    ([(0, 10.0, None, 40.0), (1, 300.0, None, 101.0)], [], "ok", {(MISS, "missing_map"), (MISS, "missing_spo2")}),
    ([(m, 60.0, None, 98.0) for m in range(8)], [NOREPI], "hypotension", {(MISS, "hypotension"), (MISS, "vasopressor")}),
    ([(m, 60.0, None, 98.0) for m in range(8)], [NOREPI], "There was no hypotension. Norepinephrine infusion from minute 2 to minute 10.", {(BAD, "hypotension"), (MISS, "hypotension"), (HIT, "vasopressor")}),
    ([(0, 80.0, None, 98.0)], [("Phenylephrine nasal", 3, None)], "Phenylephrine nasal drops were given.", set()),
    ([(0, 80.0, None, 98.0)], [("Phenylephrine nasal", 3, None)], "Phenylephrine 100 mcg was given.", {(BAD, "medication")}),
    (ART, [], "hypotension at minute 99", {(BAD, "hypotension"), (MISS, "hypotension")}),
    (ART, [], "Hypotension at minute 12.", {(HIT, "hypotension")}),
    (ART, [], "hypotension sustained", {(MISS, "hypotension")}),
    (DESAT, [], "SpO2 was 98%", {(BAD, "desaturation"), (MISS, "desaturation")}),
    (DESAT, [], "Desaturation from minute 20 to minute 21.", {(HIT, "desaturation")}),
    (DESAT, [], "SpO2 fell from 98 to 86", {(HIT, "desaturation")}),
    (DESAT, [("epinephrine  ", 5, 3)], "No epinephrine; SpO2 below 90 at minute 20", {(HIT, "desaturation"), (BAD, "vasopressor"), (MISS, "vasopressor")}),
    (DESAT, [("Milrinone", 5, 9)], "milrinone at minute 30. Dobutamine too", {(MISS, "desaturation"), (BAD, "inotrope"), (MISS, "inotrope"), (BAD, "medication")}),
    ([(m, 82.0, None, None) for m in range(4)], [], "SpO2 missing", {(HIT, "missing_spo2")}),
    ([(m, None, None, 97.0) for m in range(4)], [], "No hypotension", {(MISS, "missing_map")}),
    ([(m, None, None, 97.0) for m in range(4)], [], "no blood pressure", {(HIT, "missing_map")}),
    ([(m, 82.0, None, None) for m in range(4)], [], "SpO2 was 97", {(BAD, "missing_spo2")}),
    (ART + [(m, 55.0, None, 98.0) for m in range(40, 50)], [], "hypotension in minutes 10 to 16 and at minute 45", {(HIT, "hypotension")}),
    (DESAT, [], None, {(MISS, "desaturation")}),
    ([(0, 80.0, None, 98.0)], [], "A vasopressor was given, no inotrope", {(BAD, "vasopressor")}),
]


@pytest.fixture(scope="module")
def graded(spark):
    samples = [(i, *s) for i, c in enumerate(CASES) for s in c[0]]
    doses = [(i, *d) for i, c in enumerate(CASES) for d in c[1]]
    events = handoff.timeline(spark.createDataFrame(samples, "case long, minute long, map_art double, nmap double, spo2 double"), spark.createDataFrame(doses, "case long, drug string, minute long, end_minute long"))
    said = handoff.claims(spark.createDataFrame([(i, c[2]) for i, c in enumerate(CASES)], "case long, text string"))
    return handoff.grades(events, said).cache()


def test_grades(graded):
    got = {}
    for r in graded.collect():
        got.setdefault(r["case"], set()).add((r["status"], r["kind"]))
    assert [(i, c[2], got.get(i, set())) for i, c in enumerate(CASES) if got.get(i, set()) != c[3]] == []


def test_counts(graded):
    got = {r["case"]: (r["mentioned"], r["missed"], r["unsupported"]) for r in handoff.counts(graded).collect()}
    assert got[0] == (2, 0, 0) and got[11] == (1, 1, 1) and got[26] == (2, 0, 0)


def test_no_rows(spark):
    none = handoff.timeline(spark.createDataFrame([], "case long, minute long, map_art double, nmap double, spo2 double"), spark.createDataFrame([], "case long, drug string, minute long, end_minute long"))
    assert handoff.grades(none, handoff.claims(spark.createDataFrame([], "case long, text string"))).collect() == []
