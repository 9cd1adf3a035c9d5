"""The pipeline's stages on the smallest data."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridwake.llm import omh
from tests.llm.test_operators import WORD, brute_classes, brute_dedup, brute_statistics
from tests.oracle import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == cp.COLUMNS
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = out.cache()
        kept[name] = before, {r["doc_id"]: r["text"] for r in docs.collect()}
    before, after = kept["quality_rules"]
    fails = {d for d, t in before.items() if (s := brute_statistics(t))[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert set(after) == set(before) - fails
    before, after = kept["near_dedup"]
    assert set(after) == set(brute_classes(list(before.items())).values())
    before, after = kept["substring_dedup"]
    for d, n, gone, _ in brute_dedup(list(before.items())):
        assert (d in after) == (gone == 0 or gone < n)
        if d in after:
            assert len(WORD.findall(after[d])) == n - gone and (gone or after[d] == before[d])
    before, after = kept["mix_sources"]
    assert 0.1 < len(after) / len(before) <= 1 and all(before[d] == t for d, t in after.items())
    pieces = cp.pack_sequences(spark, docs, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(after)


def test_run(spark):
    assert cp.run(spark, DATA).count() > 0
    assert omh.NEAR == 0.8


def test_near_dedup_null_and_repeated_ids(spark):
    """Null ids all stay; rows that share an id go only if they are near, and the choice doesn't hang on the order of rows."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (1, text("c")), (1, text("d")), (1, text("d") + " end"), (2, text("d") + " tail"), (3, text("e")), (4, text("c") + " z"), (5, ""), (5, " "), (6, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = []
    for part in (rows, rows[::-1], [r for r in rows if r[0] is None or r[0] in (3, 4)]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in part], schema).repartition(3)
        out = cp.near_dedup(spark, docs, DATA)
        assert out.columns == cp.COLUMNS
        got.append(sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str))
    assert got[0] == got[1]
    counts = collections.Counter(i for i, _ in got[0])
    assert counts == {None: 3, 1: 2, 3: 1, 5: 1, 6: 1}
    assert (1, text("c")) in got[0] and len({t[0] for i, t in got[0] if i == 1}) == 2
    assert got[2] == sorted([r for r in rows if r[0] is None or r[0] in (3, 4)], key=str)


AWKWARD = [
    (None, None, None, None, None),
    (None, "word " * 30, None, None, 1),
    (1, "", "en", "a", 0),
    (2, " ".join(f"a{i}" for i in range(60)), "en", "a", 9),
    (2, " ".join(f"a{i}" for i in range(60)), "en", "a", 9),
    (3, "start " + " ".join(f"a{i}" for i in range(60)) + " " + " ".join(f"z{i}" for i in range(200)), "de", None, 9),
    (4, " ".join(f"l{i % 997}x{i}" for i in range(40_000)), "de", "b", 9),
    (5, " \t\n", None, "b", 3),
]


def test_every_stage_on_awkward_rows_and_on_none(spark):
    """Nulls, empty and very long texts, repeated rows, further columns with clashing names, and no rows: columns stay, words come from the input."""
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(1) for c in ("id", "block", "label", "host", "kept", "row", "mix_kept", "node", "part")}
    for docs in (rows.withColumns(extra), rows.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, DATA)
            found = out.collect()
            if name == "pack_sequences":
                assert sum(r["start"] == 0 for r in found) == (len(AWKWARD) if docs.columns != rows.columns else 0)
                continue
            assert out.columns == cp.COLUMNS
            before = collections.Counter(w for r in docs.collect() for w in WORD.findall(r["text"] or ""))
            assert not collections.Counter(w for r in found for w in WORD.findall(r["text"] or "")) - before
            if docs.columns == rows.columns:
                assert not found
            if name == "near_dedup" and found:
                assert collections.Counter(r["doc_id"] for r in found) == {None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
            if name == "substring_dedup" and found:
                assert {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in found}[3] == 201
