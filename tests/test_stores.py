"""The stored index, stems and vectors: against plain Python, growing by imports, and without reading texts again."""

import math
import re
from collections import Counter

import pytest

from gridwake.functions.stem import stemmed
from gridwake.plans.stores import _measured
from gridwake.sources import vectors
from gridwake.sources.textindex import TextIndex
from gridwake.sources.vectors import VectorCache, packed, unpacked

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "pressure": "pressur", "pressures": "pressur", "oxygen": "oxygen", "of": "of", "as": "as", "naïvely": "naïvely",
}


def test_stems_of_published_words(spark):
    frame = spark.createDataFrame([(w, "w", "_next") for w in STEMS], "word string, w2 string, step string")
    assert dict(stemmed(frame.select("word"), "word").collect()) == STEMS


def _bm25(texts, question, stem):
    cut = lambda t: [stem(w) for w in re.findall(r"[^\W_]+", t.lower())]
    docs = {i: Counter(cut(t)) for i, t in texts.items()}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = {}
    for term in set(cut(question)):
        n = sum(term in c for c in docs.values())
        for i, c in docs.items():
            if c[term]:
                idf = math.log((len(docs) - n + 0.5) / (n + 0.5) + 1)
                out[i] = out.get(i, 0) + idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return out


TEXTS = {"a": "High airway pressure; pressures of airways", "b": "press the button, as agreed", "c": "", "d": "Oxygen and pressures " * 30, "e": "motoring under pressured conditions", "f": None}


def _index(spark, tmp_path):
    return TextIndex(spark, str(tmp_path / "index"))


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "key string, body string, term string")


def test_an_index_grows_by_imports(spark, tmp_path):
    index = _index(spark, tmp_path)
    assert index.search("pressure").collect() == []
    first = {k: TEXTS[k] for k in "abc"}
    assert index.add(_frame(spark, first), "key", "body") == 3
    assert index.add(_frame(spark, TEXTS), "key", "body") == 3  # a, b and c are known
    assert index.add(_frame(spark, TEXTS), "key", "body") == 0
    stem = {"pressures": "pressur", "pressure": "pressur", "airways": "airwai", "airway": "airwai", "agreed": "agre"}
    known = lambda w: stem.get(w, {"pressured": "pressur", "motoring": "motor", "conditions": "condit", "button": "button"}.get(w, w))
    want = _bm25({i: t or "" for i, t in TEXTS.items()}, "Airway PRESSURE", known)
    got = dict(index.search("Airway PRESSURE").collect())
    assert got.keys() == want.keys() == {"a", "d", "e"} and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    best = [r["id"] for r in index.search("airways pressured", limit=2).collect()]
    assert best == sorted(want, key=lambda i: (-want[i], i))[:2]
    assert index.search('" OR * - () xylophone').collect() == [] and index.search(" ").collect() == []
    assert {r["id"] for r in index.search("press").collect()} == {"b"}  # no prefix of another word
    reopened = TextIndex(spark, index.folder)
    assert reopened.documents().count() == 6 and {r["id"] for r in reopened.search("oxygen").collect()} == {"d"}


def test_a_search_reads_no_text_and_few_folders(spark, tmp_path):
    index = _index(spark, tmp_path)
    index.add(_frame(spark, TEXTS), "key", "body")
    found = index.search("oxygen")
    plan = found._jdf.queryExecution().toString()
    assert "body" not in plan and "PartitionFilters: [" in plan and "EqualTo(term,oxygen)" in plan.replace("In(term, [oxygen])", "EqualTo(term,oxygen)")


def test_an_import_that_fails_is_not_seen(spark, tmp_path):
    index = _index(spark, tmp_path)
    index.add(_frame(spark, {"a": "one"}), "key", "body")
    broken = _frame(spark, {"b": "one"}).selectExpr("key", "concat(body, cast(raise_error('broken') as string)) as body")
    with pytest.raises(Exception, match="broken"):
        index.add(broken, "key", "body")
    assert {r["id"] for r in index.search("one").collect()} == {"a"}


def test_repeated_and_null_ids(spark, tmp_path):
    index = _index(spark, tmp_path)
    rows = spark.createDataFrame([("a", "two words"), ("a", "one word"), (None, "one word")], "key string, body string")
    assert index.add(rows, "key", "body") == 1 and dict(index.search("one").collect()).keys() == {"a"}
    assert index.add(rows.limit(0), "key", "body") == 0


def test_vectors_are_packed_as_little_endian_floats(spark):
    data = packed([[1.0, -2.5], []]).to_pylist()
    assert data == [b"\x00\x00\x80?\x00\x00 \xc0", b""]
    frame = spark.createDataFrame([(d,) for d in [*data, None, b"\x00\x00\x80?xx"]], "v binary").select(unpacked("v").alias("v"))
    assert [r["v"] for r in frame.collect()] == [[1.0, -2.5], [], None, [1.0]]


def test_only_new_texts_are_embedded(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "vectors"))
    rows = [(1, "one"), (2, "two e"), (3, "one"), (4, None), (5, "")]
    texts = lambda r: spark.createDataFrame(r, "id long, text string")
    assert cache.update(texts(rows[:3]), "text", _measured, "m") == 2
    assert cache.update(texts(rows), "text", _measured, "m") == 1  # null and empty are one
    assert cache.update(texts(rows), "text", _measured, "m") == 0
    assert cache.update(texts(rows[:1]), "text", lambda t: [[9.0]] * len(t), "other") == 1
    got = {r["id"]: r["vector"] for r in cache.of(texts([*rows, (6, "new")]), "text", "m").collect()}
    assert got == {1: [3.0, 1.0, 0.0], 2: [5.0, 1.0, 0.25], 3: [3.0, 1.0, 0.0], 4: [0.0, 0.0, 0.0], 5: [0.0, 0.0, 0.0], 6: None}


def test_an_embedder_gets_batches_and_may_fail(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path / "vectors"))
    frame = spark.createDataFrame([(f"text {i}",) for i in range(100)], "text string").coalesce(1)
    sizes = lambda texts: [[float(len(texts))]] * len(texts)
    assert cache.update(frame, "text", sizes, "m") == 100
    assert max(r["v"][0] for r in cache.vectors("m").select(unpacked("vector").alias("v")).collect()) == vectors.BATCH
    with pytest.raises(Exception, match="wrong number of vectors"):
        cache.update(frame.selectExpr("text || '!' as text"), "text", lambda texts: [[0.0]], "m")
    assert cache.vectors("m").count() == 100
    with pytest.raises(ValueError):
        cache.update(frame, "text", sizes, "a/b")


def test_a_larger_import_is_dealt_into_more_slices(spark, tmp_path, monkeypatch):
    from gridwake.sources import textindex

    monkeypatch.setattr(textindex, "SLICE", 100)
    monkeypatch.setattr(textindex, "PARTS", 2)
    texts = spark.createDataFrame([(i, f"word{i % 3} common " * 4) for i in range(40)], "id long, text string")
    index = textindex.TextIndex(spark, str(tmp_path / "sliced"))
    assert index.add(texts, "id", "text") == 40
    files = spark.read.parquet(f"{tmp_path}/sliced/postings").inputFiles()
    assert len(files) > 5 and index.search("common").count() == 40
