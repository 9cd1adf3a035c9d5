"""Masking of texts, and whose the details of a text are, on texts written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridwake.operators import attribution, deidentify

ONE, TWO, LOOSE = "0123456789abcdef", "SYN00aa11bb22", "ffffffffffffffff"
EXTRACT = f"""Procedure: Smithson Knee Arthroplasty. Age: 47. Sex: F.
## Demographics & procedure
- Procedure: Smithson Knee Arthroplasty
Case {ONE}, a 47-year-old, then {TWO} and {LOOSE}; 47F, aged 52, t=28–37 min.
- 2016-03-01 09:30:00: Intubation
- 2016-03-01T09:41:00: Incision
- 2016-03-01 10:58: Extubation
Seen 2016-03-01 10:59, at 10:59 or 1059h on 3/1/2016, 1st of March 2016, March 1, 2016.
Files in /srv/waves/00/a.xml or C:\\waves\\a.xml; see https://example.org/a/b and 120/80, 98.6, 18.5 cmH2O."""


def _sent(spark, texts, anchored=True):
    frame = spark.createDataFrame([(i, "c", t, "x") for i, t in enumerate(texts)], "id long, pid string, text string, alias string")
    aliases = spark.createDataFrame([(ONE, "Case-A"), (TWO, "Case-B"), ("0" * 16, "Case-Z")], "id string, alias string")
    anchors = spark.createDataFrame([("c", dt.datetime(2016, 3, 1, 9, 41))] if anchored else [], "case string, at timestamp")
    out = deidentify.outbound(frame, "id", "text", aliases, "pid", anchors)
    assert out.columns == ["pid", "id", "text", "alias", "sent"] or set(out.columns) == {"pid", "id", "text", "alias", "sent"}
    return [r["sent"] for r in out.orderBy("id").collect()]


def test_nothing_that_identifies_is_sent(spark):
    (sent,) = _sent(spark, [EXTRACT])
    assert sent.split("\n") == [
        "Procedure category: Orthopedic. Age: 45–49. Sex: F.",
        "## Demographics & procedure",
        "- Procedure category: Orthopedic",
        "Case Case-A, a 45–49-year-old, then Case-B and [case number not sent]; 45–49F, aged 50–54, t=28–37 min.",
        "- minute -11 from incision: Intubation",
        "- minute +0 from incision: Incision",
        "- minute +77 from incision: Extubation",
        "Seen [time not sent], at [time not sent] or [time not sent] on [date not sent], [date not sent], [date not sent].",
        "Files in [path not sent] or [path not sent] see https://example.org/a/b and 120/80, 98.6, 18.5 cmH2O.",
    ]


def test_without_an_anchor_no_time_is_sent(spark):
    (sent,) = _sent(spark, [EXTRACT], anchored=False)
    assert "- time not sent: Intubation" in sent and "minute" not in sent.replace("min.", "")


def test_empty_and_long_texts(spark):
    many = "\n".join(f"line {i}" for i in range(403))
    none, empty, long, plain = _sent(spark, [None, "", many, "nothing \x01here\x02"])
    assert (none, empty, plain) == ("", "", "nothing here")
    assert long.split("\n")[-1] == "[3 more lines not sent]" and long.count("\n") == 400


@pytest.mark.parametrize("procedure, category", [("CABG x3", "Cardiac"), ("Laparoscopic hysterectomy", "Gynecology and obstetrics"), ("laparoscopic appendectomy", "General and abdominal"), ("kidney transplant", "Transplant"), ("Wheeling", "Other or not classified")])
def test_the_first_category_that_fits(spark, procedure, category):
    assert spark.range(1).select(deidentify.category(F.lit(procedure))).first()[0] == category


def test_answers_get_their_identifiers_back(spark):
    aliases = spark.createDataFrame([(ONE, "Case-A"), (TWO, "Case-B")], "id string, alias string")
    frame = spark.createDataFrame([(1, "Case-A, Case-B and Case-C; Case-AB"), (2, None), (3, "no case")], "id long, text string")
    got = {r["id"]: r["received"] for r in deidentify.inbound(frame, "id", "text", aliases).collect()}
    assert got == {1: f"{ONE}, {TWO} and Case-C; Case-AB", 2: "", 3: "no case"}


DETAIL = r"(?:\b\d+\.\d+\b|\b[a-z]+_high\b)"


def _placed(spark, *texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, case string")
    rows = attribution.placed(frame.drop("case"), "id", "text", DETAIL).orderBy("id", "line", "sentence", "place").collect()
    return [(r["id"], r["detail"], r["case"], r["denied"]) for r in rows]


def test_a_detail_is_of_the_case_named_before_it(spark):
    a, b = ONE, TWO.lower()
    assert _placed(spark, f"With 1.5 case {ONE} had 2.5; then {TWO.upper()} had 3.5. Later 4.5 was seen") == [(0, "1.5", a, False), (0, "2.5", a, False), (0, "3.5", b, False), (0, "4.5", None, False)]
    assert _placed(spark, f"{ONE} shows pip_high. {TWO} does not show pip_high and 2.5") == [(0, "pip_high", a, False), (0, "pip_high", b, True), (0, "2.5", b, False)]


def test_a_list_under_one_case_is_its(spark):
    text = f"Of {ONE}:\n- 1.5\n\n  * 2.5\n3. 3.5\nSome text: 4.5\n- 5.5\n{ONE} and {TWO}\n- 6.5\n- {TWO} 7.5\n- 8.5"
    a, b = ONE, TWO.lower()
    assert _placed(spark, text) == [(0, "1.5", a, False), (0, "2.5", a, False), (0, "3.5", a, False), (0, "4.5", None, False), (0, "5.5", None, False), (0, "6.5", None, False), (0, "7.5", b, False), (0, "8.5", b, False)]


def test_details_that_another_case_has(spark):
    texts = spark.createDataFrame([(1, f"{ONE} had 1.5, 2.5 and pip_high.\nCompared: {ONE} had 2.5 for {TWO}.\n{TWO} without map_high had 9.5 and hr_high. {LOOSE} had 2.5"), (2, None)], "id long, text string")
    listed = spark.createDataFrame([(1, ONE), (1, TWO)], "id long, case string")
    record = spark.createDataFrame([(ONE, "1.5"), (TWO, "2.5"), (TWO, "pip_high"), (LOOSE, "9.5")], "case string, detail string")
    details = attribution.placed(texts, "id", "text", DETAIL)
    got = attribution.misattributed(details, "id", listed, record, F.col("detail").endswith("_high")).collect()
    assert sorted((r["case"], r["detail"], r["holder"]) for r in got) == sorted([(ONE, "2.5", TWO.lower()), (ONE, "pip_high", TWO.lower()), (TWO.lower(), "hr_high", None)], key=str)
    assert attribution.misattributed(details.limit(0), "id", listed, record, F.lit(True)).collect() == []


def test_less_than_half_a_minute_before_has_no_plus(spark):
    texts = spark.createDataFrame([("k", "c", "- 2024-01-02 09:59:40: a\n- 2024-01-02 10:00:20: b\n- 2024-01-02 09:59:30: c")], "key string, case string, text string")
    anchors = spark.createDataFrame([("c", dt.datetime(2024, 1, 2, 10))], "case string, at timestamp").select("case", F.lit("2024-01-02 10:00:00").cast("timestamp").alias("at"))
    none = spark.createDataFrame([], "id string, alias string")
    sent = deidentify.outbound(texts, "key", "text", none, "case", anchors).first()["sent"]
    assert sent == "- minute 0 from incision: a\n- minute +0 from incision: b\n- minute -1 from incision: c"


def test_a_text_with_many_matches_is_told_once(spark):
    frame = spark.createDataFrame([(1, "c", "- 2016-03-01 09:30:00: x\n" + " ".join(["Aged 47 at 10:59", ONE, "of /a/b.xml"] * 700))], "id long, pid string, text string")
    out = deidentify.outbound(frame, "id", "text", spark.createDataFrame([(ONE, "Case-A")], "id string, alias string"), "pid", spark.createDataFrame([("c", dt.datetime(2016, 3, 1, 9, 41))], "case string, at timestamp"))
    plan = out.select("id", "sent")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Procedure category: ") == 1  # what a match becomes is computed in one place of the plan
    assert out.first()["sent"] == "- minute -11 from incision: x\n" + " ".join(["Aged 45–49 at [time not sent]", "Case-A", "of [path not sent]"] * 700)
