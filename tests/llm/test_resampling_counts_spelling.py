"""Importance resampling, token counts and spelling variants against plain Python, on awkward rows, and against SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridwake.llm import bytescan, counts, queries, resampling, spelling
from gridwake.llm.packing import tokenizer_path

from ..oracle import DATA, by_sql, differences

KINDS = "doc_id long, text string, n long, word string, score string"
LONG = "Überlang " + "x" * 3000 + " " + "wörter " * 4000


def table(spark, rows):
    """Rows of (id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "word", "s") for i, t in rows], KINDS)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (None, "an idless text of some words"), (None, "an idless text of some words"),
    (4, "Straße straße STRASSE ÉCLAIR éclair Éclair ×÷ 12ab34 <|endoftext|> naïve text"), (4, "the same id again"),
    (5, LONG), (6, LONG), (7, "don't\n\n\nwe'll   stop  here   now\r\n<|endoftext|><|endoftext|>  end "),
    (8, "日本語のテキスト and more, 3.14159 $%&! \U0001f600\U0001f600"), (-9, "seven separate words in one short text"),
]


def test_crcs_of_spans():
    data = np.random.default_rng(5).integers(0, 256, 9000, dtype=np.uint8)
    start = np.sort(np.random.default_rng(6).integers(0, 8000, 400))
    end = np.minimum(start + np.random.default_rng(7).integers(0, 700, 400), 9000)
    got = bytescan.finished(bytescan.advanced(bytescan.registers(400), data, start, end))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    none = np.empty(0, np.int64)
    assert len(bytescan.advanced(bytescan.registers(0), data, none, none)) == 0


def test_spans_end_at_documents():
    data = np.frombuffer(b"abcd ef", np.uint8)
    start, end, first = bytescan.spans(data != 32, np.array([0, 2, 2, 4, 7, 7]))
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [(0, 2), (2, 4), (5, 7)]
    assert first.tolist() == [0, 1, 1, 2, 3, 3]


def _features(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", small)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _resampled(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in _features(t)[1])
    t = Counter(bucket(f) for x in target for f in _features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000) / ((s[b] + 1.0) * (all_t + 10000))))
    out = []
    for i, text in rows:
        words, features = _features(text)
        weight = sum(gain(bucket(f)) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    for place, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("target", [["Wörter über wörter", "some more text"], [None], []])
def test_resampling_on_awkward_rows(spark, target):
    rows = AWKWARD + [(100 + i, f"{'many words ' * 15} number {i} of this kind") for i in range(30)] + [(200, "copied text " * 12)] * 6
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(table(spark, rows), frame).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == _resampled(rows, target)


def test_no_rows(spark):
    none = table(spark, [])
    assert resampling.resampled(none, none).collect() == []
    assert counts.token_counts(none).collect() == []
    assert spelling.grouped(none).collect() == []
    assert spelling.grouped(table(spark, [(1, None), (2, ""), (3, "short only")])).collect() == []


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_token_counts_are_the_librarys(spark, head):
    """Whole, by a head that has some of the pre-tokens, and all by the join."""
    from tokenizers import Tokenizer

    rows = AWKWARD + [(300 + i, f"rare{i} word{i * i}\tand {'common ' * i}") for i in range(40)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((str(i), len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    got = counts.token_counts(table(spark, rows), head=head)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((str(a), b, c, d) for a, b, c, d in got.collect()) == want


def test_token_counts_of_the_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in docs}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op12_token_counts(spark, DATA).collect()} == want


def test_other_tokenizers_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError):
        counts.Cutter(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        counts.Cutter(public_tokenizers.path("piece_bpe_32k.model"))


def test_cutter_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(counts, "HELD", 3)
    run = counts._vocabulary(tokenizer_path())
    batch = pa.RecordBatch.from_pydict({"text": ["one two three four five"] * 2})
    got = Counter()
    for part in run(iter([batch, batch])):
        for row in part.to_pylist():
            got[row["token"]] += row["n"]
    assert got == {"one": 4, " two": 4, " three": 4, " four": 4, " five": 4}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _grouped(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near, form = defaultdict(list), {}
    for w in n:
        near[w] = [x for x in n if _near(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def _spelt():
    words = ["banana" * 2, "schönheit", "schonheit", "aaaaaaaa", "aaaaaaa", "abababa", "bababab", "éclairage", "x" * 300, "x" * 299, "×÷×÷×÷×"]
    rows = [(i, " ".join([w] * (4 ** (i % 5)))) for i, w in enumerate(words)]
    rows += [(50, "correction " * 500), (51, "corection " * 40 + "corretion " * 40), (52, "corecton " * 3 + "coretion " * 3 + "correctionen " * 2), (None, "correktion " * 2), (None, "correktion")]
    return rows + [(60 + i, "Repeated Words Between documents ") for i in range(200)] + AWKWARD


@pytest.mark.parametrize("shard, round_bytes", [(20_000, 1 << 25), (3, 1)])
def test_spelling_against_all_pairs(spark, monkeypatch, shard, round_bytes):
    """In one shard, and in shards of three words that are sent one by one."""
    want = _grouped(_spelt())
    assert len({r[5] for r in want}) < len(want) and any(r[3] and r[3] != r[5] for r in want)
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    got = spelling.grouped(table(spark, _spelt()).coalesce(2), round_bytes=round_bytes)
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == want


def test_tries_find_each_pair_once():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(4, 9))) for _ in range(600)})
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if _near(a, b)}
    batch = pa.RecordBatch.from_pydict({"word": words, "n": [1] * len(words)})
    (row,) = [r for part in spelling._shards(iter([batch])) for r in part.to_pylist()]
    letters = spelling.Letters.of(pa.array(words))
    i, j = spelling.Trie(row).near(letters, np.zeros(len(words), np.int64))
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_roots_of_long_paths(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("a", "w17"), ("b", "w0")]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert set(got.values()) == {"w17"} and len(got) == 19


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_spelling_variants"])
def test_matches_sql(spark, name):
    assert not differences(queries.queries()[name](spark, DATA).toPandas(), by_sql(queries.oracle_sql()[name]))
