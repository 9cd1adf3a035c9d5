"""Numbers of answers against those of their sources, and the join of bands that decides it."""

import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwake.operators import grounding
from gridwake.operators.bands import band_join
from gridwake.plans import REGISTRY

from .oracle import DATA

CASES = [
    ("PIP reached 45 cmH2O", "PIP max 22.09 cmH2O", False),
    ("PIP reached 22.09 cmH2O", "PIP max 22.09 cmH2O", True),
    ("peaked at 19.5 cmH2O", "max 19.509 cmH2O", True),
    ("peaked at 19.51 cmH2O", "max 19.509 cmH2O", True),
    ("peaked at 19.6 cmH2O", "max 19.509 cmH2O", False),
    ("peaked at 19.5091 cmH2O", "max 19.509 cmH2O", False),
    ("peaked at 20 cmH2O", "max 19.509 cmH2O", True),
    ("peaked at 20.0 cmH2O", "max 19.509 cmH2O", False),
    ("peaked at 20 cm H₂O", "max 19.5 cmH2O", True),
    ("peaked at 19 cmH2O", "max 19.5 cmH2O", False),
    ("peaked at about 19 cmH2O", "max 19.509 cmH2O", True),
    ("peaked at ~20 cmH2O", "max 19.2 cmH2O", True),
    ("approximately 18 to 20 cmH2O", "18.5 cmH2O and max 19.2 cmH2O", True),
    ("peaked at about 25 cmH2O", "max 22.09 cmH2O", False),
    ("FiO2 of 40%", "FiO2: median 40.0 %", True),
    ("a volume of 1,200 mL", "volume 1200 mL", True),
    ("a volume of 1200 mL", "volume 1,200 mL", True),
    ("a volume of 1,300 mL", "volume 1200 mL", False),
    ("it fell to −5 mmHg", "delta -5 mmHg", True),
    ("it fell by 5 mmHg", "delta -5 mmHg", True),
    ("it fell to -6 mmHg", "delta -5 mmHg", False),
    ("it rose to -5 mmHg", "delta 5 mmHg", False),
    ("between 18 to 22 cmH2O", "range 18-22 cmH2O", True),
    ("between 18 and 25 cmH2O", "range 18–22 cmH2O", False),
    ("it was 5 mmHg", "5 mL and 6 mmHg", False),
    ("it was 5", "5 mL and 6 mmHg", True),
    ("it rose by 7 mmHg", "from 3 mmHg to 10.2 mmHg", True),
    ("it rose by 6 mmHg", "from 3 mmHg to 10.2 mmHg", False),
    ("it was 7 mmHg", "from 3 mmHg to 10.2 mmHg", False),
    ("that is 25%", "7 of 28", True),
    ("that is 26%", "7 of 28", False),
    ("twenty-two readings", "22 readings", True),
    ("See [1], [2-3] and [A2]; the 1st case\n2. next", "none", True),
    ("SpO2 and N2O of 0123456789abcdef", "none", True),
    ("no figures", "none", True),
    ("9 of them", None, False),
    (None, "9 of them", True),
    ("x" * 100_000 + " 7", "7 " + "y" * 100_000, True),
]


def _frames(spark):
    kinds = "case long, text string, value string, unit string"  # names that the operator uses itself
    return [spark.createDataFrame([(i, c[side], "v", "u") for i, c in enumerate(CASES)], kinds).drop("value", "unit") for side in (0, 1)]


def test_allowances_and_limits(spark):
    answers, sources = _frames(spark)
    judged = grounding.grounded(grounding.numbers(answers, "text"), grounding.numbers(sources, "text"), ["case"]).collect()
    bad = {r["case"] for r in judged if not r["grounded"]}
    assert [c for i, c in enumerate(CASES) if (i not in bad) != c[2]] == []


def test_each_number_is_judged_by_itself(spark):
    texts = spark.createDataFrame([(1, "between 17–22 mmHg, 1,250 mL and −3"), (2, None)], "id long, text string")
    given = spark.createDataFrame([(1, "range 18-22 mmHg"), (1, "range 18-22 mmHg")], "id long, text string")
    judged = grounding.grounded(grounding.numbers(texts, "text"), grounding.numbers(given, "text"), ["id"])
    rows = sorted(tuple(r) for r in judged.select("place", "token", "unit", F.col("value").cast("double"), "negative", "grounded").collect())
    assert rows == [(1, "17", "mmhg", 17.0, False, False), (2, "22", "mmhg", 22.0, False, True), (3, "1,250", "ml", 1250.0, False, False), (4, "3", "", -3.0, True, False)]
    kept = {r["id"]: (r["kept"], r["n_removed"]) for r in grounding.without(texts, judged, ["id"], "text").collect()}
    assert kept[1] == (f"between {grounding.REMOVED}–22 mmHg, {grounding.REMOVED} mL and −{grounding.REMOVED}", 3)
    assert kept[2] == ("", 0)


def test_no_rows(spark):
    none = grounding.numbers(spark.createDataFrame([], "id long, text string"), "text")
    assert grounding.grounded(none, none, ["id"]).collect() == []


@pytest.mark.parametrize("n", [0, 400])
def test_bands_against_all_pairs(spark, n):
    draw = random.Random(4)
    bands = [(i, i % 3, x := draw.uniform(-50, 50), x + draw.choice([0, 1e-6, 0.3, 7, 90])) for i in range(n)] + [(-1, 0, 5.0, 4.0), (-2, 0, None, 4.0)]
    values = [(j, j % 3, draw.choice([draw.uniform(-60, 60), float(draw.randint(-5, 5))])) for j in range(n)] + [(-1, 0, None)]
    values += [(1000 + i, b[1], b[2]) for i, b in enumerate(bands[: n // 10])]
    got = band_join(spark.createDataFrame(bands, "i long, k long, low double, high double"), spark.createDataFrame(values, "j long, k long, v double"), ["k"], "low", "high", "v")
    want = sorted((i, j) for i, a, lo, hi in bands for j, b, v in values if a == b and None not in (lo, v) and lo <= v <= hi)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


ABOUT = "case long, value decimal(18,6), decimals int, negative boolean, hedged boolean, unit string, differs boolean, place int"


def _random_numbers(draw, scopes, n):
    units = ["", "%", "mmhg", "ml", "min", "other"]
    some = lambda: draw.choice([0, 7, -3, 0.5, 12.345678, "999999999999.999999", round(draw.uniform(0, 120), draw.choice([0, 1, 2, 6]))])
    rows = [(draw.choice([*range(scopes), None]), Decimal(str(some())), draw.choice([0, 1, 2, 6, 9]), False, draw.random() < 0.3, draw.choice(units), draw.random() < 0.5, i) for i in range(n)]
    return [(c, v, d, v < 0, h, u, f, i) for c, v, d, _, h, u, f, i in rows]


def _by_hand(claim, values):
    """Whether a claim is grounded, by all values and pairs as fractions."""
    _, x, decimals, negative, hedged, unit, differs, _ = claim
    x, half = Fraction(x), Fraction(5, 10 ** (min(decimals, 6) + 1))
    own = [Fraction(v) for v, u in values if u == unit]
    every = [Fraction(v) for v, _ in values]
    pool = own if unit in grounding.MEASURES and own else every
    near = lambda v: (abs(v) >= abs(x) - half and abs(v) < abs(x) + half and (x - half <= v <= x + half or not negative and x > 0 and -x - half <= v <= half - x))
    if any(near(v) or hedged and abs(v - x) <= max(2 * half, abs(x) / 20) for v in pool):
        return True
    if x < 0:
        return False
    if unit in ("%", "vol%"):
        return x <= 100 and any(b > 0 and 0 <= a <= b and (x - half) * b <= 100 * a < (x + half) * b for a in every for b in every)
    return unit != "" and (differs or unit in ("min", "sec", "hour")) and any(a < b and x - half <= b - a < x + half for a in own for b in own)


def test_scopes_of_any_size_by_hand(spark):
    draw = random.Random(5)
    claims, sources = _random_numbers(draw, 12, 300), _random_numbers(draw, 12, 200)
    want = {c[-1]: c[0] is not None and _by_hand(c, [(v[1], v[5]) for v in sources if v[0] == c[0]]) for c in claims}
    assert 50 < sum(want.values()) < 250
    frames = [spark.createDataFrame(rows, ABOUT) for rows in (claims, sources)]
    for wide in (grounding.WIDE, 35, 0):  # each scope in one task, some dealt out, all dealt out
        assert {r["place"]: r["grounded"] for r in grounding.grounded(*frames, ["case"], wide=wide).collect()} == want


def test_scopes_that_span_batches(monkeypatch):
    draw = random.Random(6)
    claims, sources = _random_numbers(draw, 9, 200), _random_numbers(draw, 9, 200)
    rows = sorted([(r[0] if r[0] is not None else -1, r, k) for k, rs in ((0, sources), (1, claims)) for r in rs], key=lambda r: r[0])
    column = lambda f, kind: pa.array([f(r, k) for _, r, k in rows], kind)
    table = pa.table({
        "case": column(lambda r, k: r[0], pa.int64()),
        "_claim": column(lambda r, k: {"place": r[7]} if k else None, pa.struct([("place", pa.int32())])),
        "_x": column(lambda r, k: int(r[1] * grounding._SCALE), pa.int64()),
        "_unit": column(lambda r, k: r[5], pa.string()),
        "_decimals": column(lambda r, k: min(r[2], 6) if k else None, pa.int32()),
        "_flags": column(lambda r, k: r[3] + 2 * r[4] + 4 * r[6] if k else None, pa.int32()),
    })
    told = []
    for chunk, pairs in ((10**6, 10**6), (17, 40), (1, 1)):
        monkeypatch.setattr(grounding, "CHUNK", chunk)
        monkeypatch.setattr(grounding, "PAIRS", pairs)
        out = pa.Table.from_batches(grounding._judged(iter(table.to_batches(max_chunksize=7)), ["case"]))
        told.append(sorted((p["place"], g) for p, g in zip(out["_claim"].to_pylist(), out["grounded"].to_pylist(), strict=True)))
    assert len(told[0]) == 200 and told[0] == told[1] == told[2]


def test_percentages_beyond_64_bits():
    b = np.array([2 * 10**18 - 1, 3, 10**18 + 7], np.int64)
    x, half = np.array([200 * 10**6, 0, 33_333_333], np.int64), np.array([1, 10**6, 1000], np.int64)
    low, high = grounding._share(x, half, b)
    of = 100 * grounding._SCALE
    want = [(max(-(-(i - h) * j // of), 0), min(-(-(i + h) * j // of) - 1, j)) for i, h, j in zip(x.tolist(), half.tolist(), b.tolist(), strict=True)]
    assert list(zip(low.tolist(), high.tolist(), strict=True)) == want


def test_pairs_of_a_scope_are_no_rows(spark):
    answers, sources = _frames(spark)
    judged = grounding.grounded(grounding.numbers(answers, "text"), grounding.numbers(sources, "text"), ["case"])
    assert "Join" not in judged._jdf.queryExecution().optimizedPlan().toString()


def test_answers_meet_their_marks_alone(spark):
    kept = REGISTRY["answers_without_ungrounded"].run(spark, DATA)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_bucket" not in plan  # texts with what is to go; no pairs of values
