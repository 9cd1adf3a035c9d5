"""Spelling variants: words that differ by one letter from a much more frequent one.

The distinct words with their counts are sorted and cut into shards, each a compact trie (flat arrays in level order).
Shards are broadcast in rounds of a bounded size, and each word's automaton for distance one runs through every shard
that can hold a neighbour, depth first and many words at a time. A shard of words is entered by exact letters up to half
of the word, where the automaton allows its error only after that; the other half is done by tries of the words spelt
backwards. So a word needs only the shards around its own place in each order, and a round only the words near its shards.
What comes back for a word and a shard is how many neighbours it has there and the best of them; pairs are never sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import advanced, finished, gathered, lowered, spans
from .shared import in_small_batches, joined, new_path, stored
from .text import buffers, slices

#: A run whose CRC this divides loses a letter; code points and occurrences of a word; how many times as frequent a form is.
DROP, LETTERS, LEAST, TIMES = 31, 7, 2, 10
#: Words and letters of a shard at most, bytes of the shards of a round, and letters that words near a shard share.
SHARD_WORDS, SHARD_LETTERS, ROUND_BYTES, SHARED = 20_000, 1_000_000, 32 << 20, 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True
_ALL = 0xFFFFFFFF
_FIELDS = ("words", "sizes", "counts", "labels", "kids", "ends")


def _words_of(texts: pa.Array, keys: list) -> Iterator[pa.Array]:
    """Words of at least LETTERS code points of each slice, one for each occurrence."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets):
        raw, edge = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        lead = raw == 0xC3  # with the byte after it, U+00C0 to U+00FF
        inside = _LETTER[raw]
        inside[1:] |= lead[:-1]
        own = lowered(raw)
        start, end, first = spans(inside, edge)
        points = np.r_[0, np.cumsum(~lead)]
        size = points[end] - points[start]
        doc = np.repeat(np.arange(b - a), np.diff(first))
        long = size >= LETTERS
        start, end, size, doc = start[long], end[long], size[long], doc[long]
        before = np.array([crc32(f"{'' if k is None else k}:".encode()) ^ _ALL for k in keys[a:b]], np.uint32)
        h = finished(advanced(before[doc], own, start, end))
        hit = h % np.uint32(DROP) == 0
        yield gathered(own, start[~hit], end[~hit])
        cut = np.flatnonzero(hit & (size > LETTERS))
        runs = [own[x:y].tobytes().decode() for x, y in zip(start[cut].tolist(), end[cut].tolist(), strict=True)]
        yield pa.array([r[:k] + r[k + 1 :] for r, k in zip(runs, (h[cut] % size[cut]).tolist(), strict=True)], pa.large_string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in _words_of(batch["text"], batch["key"].to_pylist()):
            found = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: the words of all texts, some with a letter less, that have LETTERS code points and occur LEAST times."""
    rows = in_small_batches(docs).select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Letters:
    """Words as bytes of one code point each (all are below 256): ``code[first[i]:first[i] + size[i]]`` is word i."""

    def __init__(self, code: np.ndarray, size: np.ndarray) -> None:
        self.code, self.size = code, size
        self.first = np.cumsum(size) - size

    @classmethod
    def of(cls, words: pa.Array) -> Letters:
        data, offsets = buffers(words)
        lead = data == 0xC3
        after = np.r_[False, lead[:-1]] if len(data) else lead
        return cls(np.where(after, data + np.uint8(64), data)[~lead], np.diff(np.r_[0, np.cumsum(~lead)][offsets]))

    def word(self, i: int) -> str:
        return self.code[self.first[i] : self.first[i] + self.size[i]].tobytes().decode("latin-1")


def build(words: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trie of sorted distinct words: each node's letter, the bounds of its children, and the word that ends in it or -1.

    Nodes are numbered by level, so the children of a node stand in a row, by their letters.
    """
    n, code, first, size = len(words.size), words.code, words.first, words.size
    common = np.zeros(n, np.int64)
    same, depth = np.arange(1, n), 0
    while len(same):
        same = same[(size[same] > depth) & (size[same - 1] > depth)]
        same = same[code[first[same] + depth] == code[first[same - 1] + depth]]
        depth += 1
        common[same] = depth
    labels, parents, ends = [np.zeros(1, np.uint8)], [], [np.full(1, -1, np.int32)]
    above, base, depth, rest = np.zeros(1, np.int64), 0, 1, np.arange(n)
    while len(rest := rest[size[rest] >= depth]):
        new = rest[common[rest] < depth]
        parents.append(base + np.searchsorted(above, new, "right") - 1)
        labels.append(code[first[new] + depth - 1])
        ends.append(np.where(size[new] == depth, new, -1).astype(np.int32))
        base, above, depth = base + len(above), new, depth + 1
    label = np.concatenate(labels)
    count = np.bincount(np.concatenate(parents) if parents else np.empty(0, np.int64), minlength=len(label))
    return label, np.r_[1, 1 + np.cumsum(count)].astype(np.int32), np.concatenate(ends)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of sorted words; one ends where it is full, or where the order does."""
    held, held_n, last = [], [], ""

    def shard() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        letters = Letters.of(pa.array(held, pa.string()))
        label, kids, ends = build(letters)
        arrays = (letters.code, letters.size.astype(np.int32), np.array(held_n, np.int64), label, kids, ends)
        row = {"low": held[0][:SHARED], "high": held[-1][:SHARED], "size": sum(x.nbytes for x in arrays)} | {f: x.tobytes() for f, x in zip(_FIELDS, arrays, strict=True)}
        yield pa.RecordBatch.from_pylist([row])
        held.clear()
        held_n.clear()

    letters = 0
    for batch in batches:
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
            if len(held) >= SHARD_WORDS or letters >= SHARD_LETTERS or word <= last:
                yield from shard()
                letters = 0
            held.append(word)
            held_n.append(n)
            letters, last = letters + len(word), word
    yield from shard()


class Trie:
    """A shard, ready to be searched."""

    def __init__(self, row: dict) -> None:
        kinds = dict(zip(_FIELDS, (np.uint8, np.int32, np.int64, np.uint8, np.int32, np.int32), strict=True))
        words, sizes, self.counts, self.labels, self.kids, self.ends = (np.frombuffer(row[f], k) for f, k in kinds.items())
        self.low, self.high, self.letters = row["low"], row["high"], Letters(words, sizes.astype(np.int64))
        parent = np.repeat(np.arange(len(self.labels)), np.diff(self.kids))
        self.edge = parent * 256 + self.labels[1:]

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or -1."""
        want = node * 256 + letter
        at = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
        return np.where(self.edge[at] == want, at + 1, -1)

    def near(self, words: Letters, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word and a word of the shard with the first ``exact`` letters equal that are one letter apart; each once.

        The automaton's states without an error follow the word; each sends out the states with one, which are
        followed to their end before the next letter. Of equal letters in a row the last is taken to be lost or new.
        """
        code, first, size = words.code, words.first, words.size
        w = np.flatnonzero(exact <= size)
        v, p = np.zeros(len(w), np.int64), 0
        found_w, found_x = [], []
        while len(w):
            open_ = exact[w] <= p  # an error may come
            x, y = w[open_], v[open_]
            own = np.where(size[x] > p, code[np.minimum(first[x] + p, len(code) - 1)], 0)
            after = np.where(size[x] > p + 1, code[np.minimum(first[x] + p + 1, len(code) - 1)], 0)
            lost = (size[x] > p) & (after != own)
            n = self.kids[y + 1] - self.kids[y]
            kid = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.kids[y], n)
            of = np.repeat(np.arange(len(x)), n)
            other = self.labels[kid] != own[of]
            kid, of = kid[other], of[other]
            instead = size[x[of]] > p
            e_w = np.concatenate((x[lost], x[of], x[of[instead]]))
            e_v = np.concatenate((y[lost], kid, kid[instead])).astype(np.int64)
            e_p = np.concatenate((np.full(lost.sum(), p + 1), np.full(len(of), p), np.full(instead.sum(), p + 1)))
            while len(e_w):
                done = size[e_w] == e_p
                word = self.ends[e_v[done]]
                found_w.append(e_w[done][word >= 0])
                found_x.append(word[word >= 0])
                e_w, e_v, e_p = e_w[~done], e_v[~done], e_p[~done]
                e_v = self.child(e_v, code[first[e_w] + e_p])
                e_w, e_v, e_p = e_w[e_v >= 0], e_v[e_v >= 0], e_p[e_v >= 0] + 1
            on = size[w] > p
            w, v = w[on], v[on]
            v = self.child(v, code[first[w] + p])
            w, v, p = w[v >= 0], v[v >= 0], p + 1
        return np.concatenate(found_w) if found_w else np.empty(0, np.int64), np.concatenate(found_x) if found_x else np.empty(0, np.int64)


def _ends_equal(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the last n letters of word i of one and word j of the other are equal."""
    same, k = np.ones(len(i), bool), 1
    while len(rest := np.flatnonzero(same & (n >= k))):
        x, y = i[rest], j[rest]
        same[rest] = a.code[a.first[x] + a.size[x] - k] == b.code[b.first[y] + b.size[y] - k]
        k += 1
    return same


def _search(tries, backward: bool):
    """Of sorted words: how many neighbours each has in the shards, the greatest count among these, and the least word with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["word"].to_pylist()
            if not keys:
                continue
            words = Letters.of(batch["word"])
            low, high = min(keys)[:SHARED], max(keys)[:SHARED]
            half = words.size // 2  # the letters before the error of a forward pair
            for trie in tries():
                if trie.high < low or trie.low > high:
                    continue
                i, j = trie.near(words, words.size - half if backward else half)
                if backward:
                    apart = ~_ends_equal(words, i, trie.letters, j, half[i])  # else the other tries have the pair
                    i, j = i[apart], j[apart]
                if len(i):
                    yield _best(keys, trie, i, j, backward)

    return run


def _best(keys: list[str], trie: Trie, i: np.ndarray, j: np.ndarray, backward: bool) -> pa.RecordBatch:
    turn = slice(None, None, -1 if backward else 1)
    order = np.lexsort((-trie.counts[j], i))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    most = trie.counts[j[begin]]
    near = np.diff(np.r_[begin, len(i)])
    tied = np.flatnonzero(trie.counts[j] == np.repeat(most, near))
    best: dict[int, str] = {}
    for a, b in zip(i[tied].tolist(), j[tied].tolist(), strict=True):
        word = trie.letters.word(b)[turn]
        best[a] = min(best.get(a, word), word)
    own = [keys[a][turn] for a in i[begin].tolist()]
    return pa.RecordBatch.from_pydict({"word": own, "near": pa.array(near, pa.int64()), "best_n": pa.array(most, pa.int64()), "best": [best[a] for a in i[begin].tolist()]})


def _rounds(shards: DataFrame, most: int) -> Iterator[list]:
    """Shards by their place, as many at a time as ``most`` bytes hold (one at least)."""
    group, held = [], 0
    for row in shards.select("id", "low", "high", "size").orderBy("low", "high", "id").toLocalIterator():
        if group and held + row["size"] > most:
            yield group
            group, held = [], 0
        group.append(row)
        held += row["size"]
    if group:
        yield group


def neighbours(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``word``, ``near``, ``best_n`` and ``best`` of each word of ``words`` (word, n) that has a neighbour; stored."""
    spark = words.sparkSession
    path = new_path(spark, "near")
    kinds = "word string, near long, best_n long, best string"
    spark.createDataFrame([], kinds).write.parquet(path)
    for backward in (False, True):
        keyed = words.select(F.reverse("word").alias("word"), "n") if backward else words
        ranged = stored(keyed.repartitionByRange("word").sortWithinPartitions("word"), "sorted")
        built = ranged.mapInArrow(_shards, "low string, high string, size long, " + ", ".join(f"{f} binary" for f in _FIELDS))
        shards = stored(built.withColumn("id", F.monotonically_increasing_id()), "shards")
        for group in _rounds(shards, round_bytes):
            ids = [r["id"] for r in group]
            rows = shards.where(F.col("id").isin(ids)).toArrow().to_pylist()  # round_bytes at most, or one shard
            sent = spark.sparkContext.broadcast(rows)
            low, high = min(r["low"] for r in group), max(r["high"] for r in group)
            mine = ranged.where((F.col("word") >= low) & (F.substring("word", 1, SHARED) <= high))
            mine.select("word").mapInArrow(_search(_opened(sent), backward), kinds).write.mode("append").parquet(path)
            sent.unpersist()
    near = spark.read.schema(kinds).parquet(path)
    best = near.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top"))
    return best.select("word", "near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def _opened(sent):
    held: list[Trie] = []

    def tries() -> list[Trie]:
        if not held:
            held.extend(map(Trie, sent.value))
        return held

    return tries


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of each word of the texts.

    The form is the near word with the largest count, the least of equal ones, if it is at least ``times`` the word's;
    the root is where following forms ends. A null or wordless text has no words; a null id counts as an empty one;
    rows that repeat count each time. A row of an empty table is none. Columns other than id and text are not read.
    """
    words = stored(vocabulary(docs, id_col, text_col), "words")
    found = words.join(neighbours(words, round_bytes), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    formed = stored(found.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the forms of each word end. Each round doubles the steps; counts grow at each step, so there is no ring."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(joined(at, on, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")
