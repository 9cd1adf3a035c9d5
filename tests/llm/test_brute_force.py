"""Fingerprints and language profiles against plain Python that shares none of the operators' array code."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridwake.llm import ctph, langid, queries
from gridwake.llm.text import span_hashes
from tests.llm.test_operators import LONG, NASTY, SCHEMA
from tests.oracle import DATA

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def brute_fingerprint(text):
    """Rolls over the last seven bytes one by one, cuts, and names each chunk by its bytes alone."""
    data = text.encode()

    def signature(block, most):
        chunks, start = [], 0
        for i in range(len(data)):
            rolling = 0
            for back in range(7):
                rolling = (rolling * 0x100000001B3 + (data[i - back] if i >= back else 0)) & MASK
            if ((mixed(rolling) & 0xFFFFFFFF) + 1) % block == 0 and len(chunks) < most - 1:
                chunks.append(data[start : i + 1])
                start = i + 1
        chunks += [data[start:]] if start < len(data) else []
        names = [int(span_hashes(np.frombuffer(c, np.uint8), np.array([0]), np.array([len(c)]))[0]) % 64 for c in chunks]
        return "".join(ctph.ALPHABET[x] for x in names), len(chunks)

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and signature(block, 10**9)[1] < 32:
        block //= 2
    return f"{block}:{signature(block, 64)[0]}:{signature(2 * block, 32)[0]}"


def brute_distance(a, b):
    """Insertions and deletions that turn one string into the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def brute_likeness(p, q):
    if p == q:
        return 1.0
    (b, *x), (c, *y) = p.split(":"), q.split(":")
    found = [0.0]
    for i, s in enumerate(x):
        for j, t in enumerate(y):
            k = min(5, len(s), len(t))
            if int(b) << i == int(c) << j and k and any(s[m : m + k] in t for m in range(len(s) - k + 1)):
                found.append(1 - brute_distance(s, t) / (len(s) + len(t)))
    return max(found)


def test_fingerprints_equal_brute_force(spark):
    texts = [t for t in (r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect())]
    texts += ["", "a", "ab" * 90, "é😀" * 50, " \n", LONG[:30_000]]
    whole = ctph.fingerprints(pa.array(texts))
    cut = [t if len(t) < 3000 else t[:3000] for t in texts]
    assert ctph.fingerprints(pa.array(cut)) == [brute_fingerprint(t) for t in cut]
    for p, q in zip(whole, [*whole[1:], whole[0]], strict=True):
        assert abs(ctph.likeness(p, q) - brute_likeness(p, q)) < 1e-12
    for t in texts[:15]:
        p, q = ctph.fingerprints(pa.array([t, t[: len(t) // 2] + " something else " + t[len(t) // 2 :]]))
        assert abs(ctph.likeness(p, q) - brute_likeness(p, q)) < 1e-12 and (len(t) < 1000 or ctph.likeness(p, q) > 0.5)


def test_neighbours_of_huge_repeated_and_null_ids(spark):
    """Ranges begin at real ids: ids that doubles can't tell apart are dealt out and keep their order."""
    big = (1 << 60) + 1
    rows = [(big + i, f"text {i} " * (i % 7 + 1)) for i in range(50)] + [(big + 3, "again"), (None, "none"), (None, None), (-5, "low")]
    got = ctph.neighbours(spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).repartition(3), rows=5).collect()
    assert len(got) == len(rows)
    order = sorted([(i, t or "") for i, t in rows if i is not None])
    want = collections.Counter()
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        m = len(t) // 4
        want[(i, len(t), brute_fingerprint(t[: len(t) - m] + n[:m]))] += 1
    want[(None, 4, brute_fingerprint("non"))] += 1
    want[(None, 0, brute_fingerprint(""))] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_fingerprint"]) for r in got) == want


def brute_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = collections.Counter()
    for w in words:
        padded = f"\x01{w}\x01"
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def brute_top(counts):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.LENGTH]


def test_languages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = collections.defaultdict(collections.Counter)
    for r in docs:
        if not held(r["doc_id"]) and r["lang"] is not None and r["text"]:
            counts[r["lang"]] += brute_ngrams(r["text"])
    ranks = {lang: {g: i for i, g in enumerate(brute_top(c))} for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, DATA).collect()}
    for r in docs:
        own = brute_top(brute_ngrams(r["text"] or ""))
        distance = {lang: sum(abs(rank[g] - i) if g in rank else langid.LENGTH for i, g in enumerate(own)) for lang, rank in ranks.items()}
        best = min(sorted(distance), key=distance.get) if own else "und"
        second = sorted(distance.values())[1]
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["held_out"] == held(r["doc_id"])
        assert abs(got[r["doc_id"]]["score"] - (1 - distance[best] / second if own and second else 0)) < 1e-9


def test_ranks_of_very_long_texts_and_ties(spark):
    """Counts over 65,535 keep their order; equal counts go by code; equal distances by name; repeated rows agree."""
    text = "ab " * 70_000 + "cd " * 80_000
    assert langid.top(langid.ngrams(text)).tolist()[:2] == langid.top(langid.ngrams("cd " * 3 + "ab " * 2)).tolist()[:2]
    docs = spark.createDataFrame([("one two", "x"), ("one two", "y"), ("one two", "x"), (text, None)], "text string, lang string").withColumn("score", F.lit(9))
    model = langid.learn(docs)
    got = langid.identify(docs, model).collect()
    assert {tuple(r) for r in got[:3]} == {("x", 0.0)}
    frame = spark.createDataFrame(NASTY, SCHEMA)
    assert langid.identify(frame, langid.learn(frame)).count() == len(NASTY)
