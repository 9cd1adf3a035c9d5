"""Near-duplicates by order min-hash.

The k-mers of a text are its runs of five words (all words of a shorter text), each labelled with how often
it occurred before. A sketch draws the few k-mers that are least under a random order and keeps them in the
order of the text, so it is equal only if the texts share these k-mers in that order. Texts that share a
sketch are candidates. A pair is near if an alignment of the two k-mer sequences, banded to the shifts that
the threshold allows, matches m of them with m / (n1 + n2 - m) of at least 0.8. Texts of a few k-mers get
further keys, their least k-mers under one order, as many as make sure that near ones share one.

Classes are the components of the near pairs. Texts with the same words are one node. In a group that shares
a key, pairs are not all formed: each member is compared with the member that shares most with others; then
only members outside of the group's largest component are compared with the rest of it. Where many are outside
(a passage that many unlike texts share), their k-mers are counted, and only texts that share one of their
rarest k-mers are compared: near texts always do, and a common passage is never among the rarest unless it is
most of a text. So no pair that could join two components is left out. Pairs whose k-mers differ too much are
turned away by the parities of their k-mers' counts in 1024 buckets: as many parities differ as k-mers do at
most, so this never turns away a near pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, block_of, bucket_bits, by_bucket, numbers
from .shared import Shelf, hot_keys, in_small_batches, joined, small
from .text import Words, buffers, find_words, mix, powers, slices, span_hashes, starts_of, windows

#: Words of a k-mer, k-mers of a sketch, sketches of a text, and the least similarity.
#: A pair of long texts at 0.8 shares a given sketch with probability 0.8^4 and none of the 24 with 3e-6.
K, TAKEN, SKETCHES, NEAR = 5, 4, 24, 0.8
#: Two texts of so many k-mers at most share a further key if they are near, whatever the sketches are.
SHORT = 15
#: Members outside of a group's largest component that are compared with all of it, and in one step of that.
OUTSIDE, CHUNK = 64, 1024
#: Pairs of a task that aligns them, on average, as long as there are no more than so many tasks.
PAIRS, MOST_TASKS = 1000, 20_000
#: Pairs of one text that go to one task.
PART = 64
#: Documents whose keys, and links of a graph, that one task takes.
DOCS, LINKS = 8_000, 100_000

_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
#: Parity bits of a text, as so many longs.
LONGS = 16
#: K-mers of a text that are expected to pass the first cut for a sketch; of TAKEN needed.
_PASS = 8 * TAKEN


def kmers(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of each document in text order, and the document of each."""
    at, doc = starts_of(words.first, K)
    value = windows(hashes, K)[at]
    n = np.diff(words.first)
    for i in np.flatnonzero((n > 0) & (n < K)):
        place = int(np.searchsorted(doc, i))
        whole = windows(hashes[words.first[i] : words.first[i + 1]], int(n[i]))
        value, doc = np.insert(value, place, whole[0]), np.insert(doc, place, i)
    return value, doc


def labelled(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """K-mers made distinct within a document by the number of equal ones before."""
    key = mix(value + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]]) if len(key) else np.empty(0, np.int64)
    count = np.empty(len(key), np.uint64)
    count[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    return mix(value + count * _SEEDS[0, 255])


def sketches(label: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """SKETCHES numbers for each document (0 for one without k-mers) from its labelled k-mers."""
    out = np.zeros((n_docs, SKETCHES), np.int64)
    size = np.bincount(doc, minlength=n_docs)
    share = np.minimum(_PASS / np.maximum(size, 1), 0.999999)
    limit = np.where(size <= 2 * _PASS, np.iinfo(np.uint64).max, (share * 2.0**64).astype(np.uint64))
    for i in range(SKETCHES):
        drawn = (label ^ _SEEDS[0, i]) * _SEEDS[1, i]
        drawn = (drawn ^ (drawn >> np.uint64(32))) * _SEEDS[1, 255]
        taken = _least(drawn, doc, limit, size)
        who = doc[taken]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        if len(who):
            out[who[first], i] = mix(np.add.reduceat(label[taken] * powers(TAKEN)[0][place], first) + _SEEDS[0, i]).view(np.int64)
    return out


def least_kmers(label: np.ndarray, doc: np.ndarray, n_docs: int, least: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts of at most SHORT k-mers, and each one's document: of n k-mers, the first n - least * n + 1 under one order.

    Near texts of n and m k-mers share least * max(n, m) of them, so they share one of these.
    """
    size = np.bincount(doc, minlength=n_docs)
    some = np.flatnonzero((size <= SHORT)[doc])
    drawn = mix(label[some] ^ _SEEDS[1, 254])
    order = np.lexsort((drawn, doc[some]))
    drawn, who = drawn[order], doc[some][order]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    keep = rank < _prefix(size[who], least)
    return drawn[keep].view(np.int64), who[keep]


def _prefix(size, least: float):
    return size - np.ceil(least * size - 1e-9) + 1


def parities(label: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """LONGS numbers for each document: whether an odd number of its labelled k-mers falls into each bucket."""
    bits = 64 * LONGS
    bucket = (label >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(doc * bits + bucket, minlength=n_docs * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n_docs, bits), axis=1).view(np.int64)


def differing() -> Column:
    """Parities that differ between two rows (p0.., q0..)."""
    return sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(1, LONGS)), F.bit_count(F.col("p0").bitwiseXOR(F.col("q0"))))


def may_be_near(least: float = NEAR) -> Column:
    """Whether the parities of two rows leave it open that they are near: n and m k-mers that differ in at most a share."""
    return differing() <= (F.col("p_size") + F.col("q_size")) * ((1 - least) / (1 + least)) + 1e-6


def _least(drawn: np.ndarray, doc: np.ndarray, limit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the TAKEN least numbers of each document (all of them in a smaller one), in text order."""
    some = np.flatnonzero(drawn <= limit[doc])
    short = np.bincount(doc[some], minlength=len(size)) < np.minimum(size, TAKEN)
    if short.any():
        some = np.flatnonzero((drawn <= limit[doc]) | short[doc])
    some = some[np.lexsort((drawn[some], doc[some]))]
    who = doc[some]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    return np.sort(some[rank < TAKEN])


def _sketch(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sketched(batch, least)

    return run


def _slices(batch: pa.RecordBatch):
    """Slices of a batch with their words, word hashes, labelled k-mers and the document of each."""
    data, offsets = buffers(batch["text"])
    for a, b in slices(offsets):
        words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
        hashes = span_hashes(words.data, words.start, words.end)
        value, doc = kmers(words, hashes)
        yield a, b, words, hashes, labelled(value, doc), doc


def _sketched(batch: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    for a, b, words, hashes, label, doc in _slices(batch):
        got, parity = sketches(label, doc, b - a), parities(label, doc, b - a)
        more, whose = least_kmers(label, doc, b - a, least)
        keys, owners = np.concatenate((got.ravel(), more)), np.concatenate((np.repeat(np.arange(b - a), SKETCHES), whose))
        keys = keys[np.argsort(owners, kind="stable")]
        edges = np.r_[0, np.cumsum(np.bincount(owners, minlength=b - a))]
        up = powers(len(hashes))[0]
        n = np.diff(words.first)
        owner = np.repeat(np.arange(b - a), n)
        inside = np.arange(len(hashes)) - np.repeat(words.first[:-1], n)
        sums = [np.r_[np.uint64(0), np.cumsum(h * up[inside])] for h in (hashes, mix(hashes + _SEEDS[0, 254]))] if len(owner) else [np.zeros(1, np.uint64)] * 2
        same = [mix(s[words.first[1:]] - s[words.first[:-1]] + n.astype(np.uint64)).view(np.int64) for s in sums]
        yield pa.RecordBatch.from_pydict({
            "id": batch["id"].slice(a, b - a),
            "n": pa.array(n, pa.int64()),
            "size": pa.array(np.bincount(doc, minlength=b - a), pa.int64()),
            "h1": pa.array(same[0], pa.int64()),
            "h2": pa.array(same[1], pa.int64()),
            "sketch": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys, pa.int64())),
            **{f"p{i}": pa.array(parity[:, i], pa.int64()) for i in range(LONGS)},
        })


def _sequences(texts: pa.Array) -> Iterator[np.ndarray]:
    """The k-mers of each text in order."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets):
        words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
        value, doc = kmers(words, span_hashes(words.data, words.start, words.end))
        edges = np.searchsorted(doc, np.arange(b - a + 1))
        yield from (value[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True))


def similarity(x: np.ndarray, y: np.ndarray, least: float = NEAR) -> float:
    """m / (n1 + n2 - m) for the m k-mers that the best alignment within the band matches; below ``least`` it may be any number below.

    If m reaches the threshold, at most ``band`` k-mers are left over, so no match lies further off the diagonal.
    """
    total = len(x) + len(y)
    if not len(x) or not len(y):
        return 0.0
    needed = least * total / (1 + least)
    if min(len(x), len(y)) < needed - 1e-9:
        return 0.0
    a, n = np.unique(x, return_counts=True)
    b, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    bound = int(np.minimum(n[i], m[j]).sum())
    if bound < needed - 1e-9:
        return bound / (total - bound)
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(x[len(x) - short + head :][::-1] != y[len(y) - short + head :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    matched = head + tail + _aligned(x[head : len(x) - tail], y[head : len(y) - tail], int(total - 2 * needed) + 1)
    return matched / (total - matched)


def _aligned(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Longest common subsequence over matches at most ``band`` off the diagonal.

    A row of the table is the bits of a number, of which only those within the band are held: what lies before is
    counted when it leaves, what comes after is still untouched. So memory is that of the sequences and one band.
    """
    if not len(x) or not len(y):
        return 0
    order = np.argsort(y, kind="stable")
    left, right = (np.searchsorted(y, x, side, sorter=order) for side in ("left", "right"))
    low = high = done = row = 0
    for i in np.flatnonzero(right > left).tolist():
        a, b = max(0, i - band), min(len(y), i + band + 1)
        if a >= len(y):
            break
        if a >= high:
            done += high - low - row.bit_count()
            row = (1 << (b - a)) - 1
        else:
            done += a - low - (row & ((1 << (a - low)) - 1)).bit_count()
            row = row >> (a - low) | ((1 << (b - high)) - 1) << (high - a)
        low, high = a, b
        places = order[left[i] : right[i]]
        taken = row & _bits(places[(places >= low) & (places < high)] - low, high - low)
        if taken:
            row = (row + taken) | (row - taken)
            if row.bit_length() > high - low:
                row &= (1 << (high - low)) - 1
    return done + high - low - row.bit_count()


def _bits(places: np.ndarray, size: int) -> int:
    """A number of ``size`` bits with those at ``places`` set."""
    if len(places) <= 64:
        return sum(1 << j for j in places.tolist())
    bits = np.zeros(size, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _compared(least: float):
    """Near pairs from rows sorted by (a, part, b): a row without b holds the text that those after it are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, fresh = None, [], False
        for batch in batches:
            near: list[tuple[int, int]] = []
            for a, b, own in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), _sequences(batch["text"]), strict=True):
                if b is None:
                    held = [*held, own] if fresh and a == of else [own]
                    of, fresh = a, True
                    continue
                fresh = False
                if any(similarity(x, own, least) >= least - 1e-9 for x in held):
                    near.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in near], pa.int64()), "b": pa.array([x for _, x in near], pa.int64())})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the stored pairs (a, b) that are near.

    The text of ``a`` travels once for PART of its pairs, that of ``b`` with each pair; a text with many pairs
    is dealt to as many tasks.
    """
    hot = hot_keys(pairs, ["a"], least=2 * PART)
    if hot is None:
        dealt, pivots = pairs.withColumn("part", F.lit(0)), pairs.select("a").distinct().withColumn("part", F.lit(0))
    else:
        parts = F.broadcast(hot.select("a", F.ceil(F.col("hot_n") / PART).cast("int").alias("parts")))
        dealt = pairs.join(parts, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        pivots = dealt.select("a", "part").distinct()
    own = texts.withColumnRenamed("id", "b").join(small(dealt), "b").select("a", "part", "b", "text")
    first = texts.withColumnRenamed("id", "a").join(small(pivots), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    tasks = max(1, min(-(-pairs.count() // PAIRS), MOST_TASKS))
    rows = own.unionByName(first).repartition(tasks, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(_compared(least), "a long, b long")


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """``node`` and the least node that it is connected with (``label``), for all nodes of the links (a, b); stored.

    Labels spread along links, and each round a label is replaced by its own label, so the rounds grow with
    the logarithm of the longest path. A node with many links is no key of one task.
    """
    both = shelf.put(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "links")
    tasks = max(4, both.count() // LINKS)
    labels = shelf.put(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label")).select("node", F.least("node", "label").alias("label")), "labels", tasks)
    often = hot_keys(both, ["y"])
    while True:
        roots = hot_keys(labels, ["label"])
        seen = joined(both, labels.withColumnRenamed("node", "y"), ["y"], hot=often, known=True).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(seen, "node").select("node", F.least("label", "near").alias("new"), "label")
        root = spread.select(F.col("node").alias("new"), F.col("new").alias("root"))
        jumped = joined(spread, root, ["new"], hot=roots and roots.withColumnRenamed("label", "new"), known=True)
        jumped = shelf.put(jumped.select("node", F.least("new", "root").alias("label"), (F.least("new", "root") != F.col("label")).alias("moved")), "labels", tasks)
        shelf.drop(labels)
        if jumped.where("moved").isEmpty():
            shelf.drop(both)
            return jumped
        labels = jumped


def _outside(marked: DataFrame) -> DataFrame:
    """Groups with more than one component: the largest (``major``), and how many members are in others (``minor``)."""
    counts = marked.groupBy("key", "label").agg(F.count("*").alias("n"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    return tops.where("n > top.n").select("key", F.col("top.label").alias("major"), (F.col("n") - F.col("top.n")).alias("minor"))


def _candidates(marked: DataFrame, groups: DataFrame, bits: DataFrame, least: float, shelf: Shelf) -> DataFrame:
    """Pairs (a, b) of unlike components that share a group, a of a minor component, as far as their parities allow; stored.

    Members of minor components are dealt into parts of about CHUNK, each of which meets all members.
    """
    parts = F.ceil(F.col("minor") / CHUNK).cast("int").alias("parts")
    rows = joined(marked, groups.select("key", "major", parts), ["key"]).join(bits, "id")
    rows = shelf.put(rows, "members")
    other = {"id": "a", "label": "a_label", "p_size": "q_size"} | {f"p{i}": f"q{i}" for i in range(LONGS)}
    minor = rows.where("label != major").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("major", "parts").withColumnsRenamed(other)
    whole = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = joined(whole, minor, ["key", "part"]).where((F.col("label") != F.col("a_label")) & ((F.col("label") == F.col("major")) | (F.col("a") < F.col("id"))) & may_be_near(least))
    pairs = found.select("a", F.col("id").alias("b"), F.col("label").alias("b_label"), differing().alias("differ")).groupBy("a", "b").agg(F.min("b_label").alias("b_label"), F.min("differ").alias("differ"))
    pairs = shelf.put(pairs, "pairs")
    shelf.drop(rows)
    return pairs


def _linked(pairs: DataFrame, links: DataFrame, texts: DataFrame, least: float, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """``links`` with those of the candidate pairs that are needed to join their components, and the labels after that.

    Of a member and a component the pair with the fewest differing parities comes first; then all other pairs
    that are still in unlike components are tried.
    """
    first = shelf.put(pairs.groupBy("a", "b_label").agg(F.min_by("b", F.struct("differ", "b")).alias("b")).select("a", "b"), "first", max(4, pairs.count() // LINKS))
    links = links.unionByName(shelf.put(_verified(first, texts, least), "near"))
    labels = components(links, shelf)
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_at"))
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = shelf.put(rest.where(F.coalesce("a_at", "a") != F.coalesce("b_at", "b")).select("a", "b"), "rest", max(4, pairs.count() // LINKS))
    shelf.drop(first)
    if not rest.isEmpty():
        more = shelf.put(_verified(rest, texts, least), "near")
        if not more.isEmpty():
            shelf.drop(labels)
            links = links.unionByName(more)
            labels = components(links, shelf)
    shelf.drop(rest)
    return links, labels


def _frequency(n: np.ndarray) -> np.ndarray:
    """A k-mer's count as one byte, in the same order: 0 for one text alone, then in eighths of a power of two."""
    return np.where(n > 1, np.minimum(1 + 8 * np.log2(np.maximum(n, 1)), 255), 0).astype(np.uint8)


def _by_rare_kmers(texts: DataFrame, least: float, shelf: Shelf) -> DataFrame:
    """Groups (key, id) of the texts that share one of their rarest k-mers; stored.

    Of n k-mers the n - least * n + 1 rarest count, in one order for all texts (by frequency, then by hash); two
    near texts share least * max(n, m) k-mers, so one of these. Blocks of texts ask buckets how frequent their
    distinct k-mers are and get one byte for each, so a k-mer that all texts share makes no large group.
    """
    n = block_count(texts, "text")
    bits = bucket_bits(n)
    dealt = texts.select("id", "text", block_of(F.col("id"), F.col("text"), n).alias("block"))

    def distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [label for batch in table.to_batches() for *_, label, _ in _slices(batch)]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def ask(key, table):
        value, count = distinct(table)
        rows = [(b, key[0].as_py(), value[i:j].tobytes(), count[i:j].astype(np.uint32).tobytes()) for b, i, j in by_bucket(value, bits)]
        kinds = {"bucket": pa.int32(), "block": pa.int32(), "hashes": pa.binary(), "counts": pa.binary()}
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})

    def tell(key, table):
        parts = [numbers(x) for x in table["hashes"].to_pylist()]
        value, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, np.concatenate([numbers(x, np.uint32) for x in table["counts"].to_pylist()]), len(value))
        told = np.split(_frequency(total)[at], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"bucket": table["bucket"], "block": table["block"], "told": pa.array([t.tobytes() for t in told], pa.binary())})

    def finish(key, table, told):
        value, _ = distinct(table)
        answer = dict(zip(told["bucket"].to_pylist(), told["told"].to_pylist(), strict=True))
        known = np.concatenate([numbers(answer[b], np.uint8) for b, _, _ in by_bucket(value, bits)]) if len(value) else np.empty(0, np.uint8)
        keys, ids = [], []
        for batch in table.to_batches():
            for a, b, _, _, label, doc in _slices(batch):
                often = known[np.searchsorted(value, label)]
                order = np.lexsort((label, often, doc))
                who = doc[order]
                first = np.searchsorted(who, np.arange(b - a))
                rank = np.arange(len(who)) - first[who]
                keep = order[(rank < _prefix(np.bincount(doc, minlength=b - a), least)[who]) & (often[order] > 0)]
                keys.append(label[keep].view(np.int64))
                ids.append(batch["id"].slice(a, b - a).take(pa.array(doc[keep])))
        return pa.table({"key": pa.array(np.concatenate(keys) if keys else [], pa.int64()), "id": pa.chunked_array(ids, pa.int64())})

    by_block = dealt.groupBy("block")
    told = by_block.applyInArrow(ask, "bucket int, block int, hashes binary, counts binary").groupBy("bucket").applyInArrow(tell, "bucket int, block int, told binary")
    rare = by_block.cogroup(told.groupBy("block")).applyInArrow(finish, "key long, id long")
    return shelf.put(rare.distinct(), "rare", max(6, 4 * n))


def _marked(groups: DataFrame, labels: DataFrame) -> DataFrame:
    return groups.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NEAR, outside: int = OUTSIDE) -> DataFrame:
    """``id_col`` and ``class_id`` (the least id of its class) of each row; stored in the shared folder.

    Only words count, so texts that differ in white space are copies. A text without words, a null one
    included, is a class of its own, and so is a row with a null id (its class is null). Rows with equal ids
    are one document, near to what any of its texts is near to. An empty table gives an empty one. Other
    columns are not read. ``outside`` says from how many members outside of a group's largest component on
    rare k-mers choose the pairs; the classes do not depend on it. What steps leave behind is deleted.
    """
    shelf = Shelf(docs.sparkSession)
    texts = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    longs = [f"p{i}" for i in range(LONGS)]
    found = shelf.put(texts.mapInArrow(_sketch(least), "id long, n long, size long, h1 long, h2 long, sketch array<long>, " + ", ".join(f"{c} long" for c in longs)), "sketches")
    tasks = max(6, found.count() // DOCS)
    usable = found.where("n > 0 and id is not null")
    same = shelf.put(usable.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("n")).where("n > 1"), "same", tasks)
    members = shelf.put(joined(usable.select("id", "h1", "h2"), same.drop("n"), ["h1", "h2"], counts=same), "copies", tasks)
    own = usable.join(small(members.where("id != node").select("id", "h1", "h2")), ["id", "h1", "h2"], "left_anti")
    keys = own.select("id", F.explode("sketch").alias("key"))
    many = shelf.put(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"), "many", tasks)
    groups = shelf.put(joined(keys, many, ["key"], counts=many), "groups", tasks)
    scores = shelf.put(groups.groupBy("id").agg(F.sum("n").alias("score")), "scores", tasks)
    scored = shelf.put(groups.select("key", "id").join(scores, "id"), "scored", tasks)
    shelf.drop(same, many, groups)

    pivots = scored.groupBy("key").agg(F.max(F.struct("score", "id")).alias("pivot"))
    best = joined(scored, pivots, ["key"]).where("id != pivot.id").groupBy("id").agg(F.max("pivot").alias("pivot"))
    pairs = shelf.put(best.select(F.col("pivot.id").alias("a"), F.col("id").alias("b")), "pairs", tasks)
    candidates = scores.select("id")
    needed = shelf.put(texts.join(small(candidates), "id", "left_semi"), "texts")
    bits = shelf.put(own.select("id", F.col("size").alias("p_size"), *longs).join(small(candidates), "id", "left_semi"), "parities")
    links = shelf.put(_verified(pairs, needed, least), "near")
    labels = components(links, shelf)
    marked = shelf.put(_marked(scored, labels), "marked", tasks)
    unlike = shelf.put(_outside(marked), "unlike", tasks)
    shelf.drop(pairs, scored)

    wide = unlike.where(F.col("minor") > outside)
    if not unlike.isEmpty():
        pairs = _candidates(marked, unlike.where(F.col("minor") <= outside), bits, least, shelf)
        links, labels = _linked(pairs, links, needed, least, shelf)
        shelf.drop(pairs)
    if not wide.isEmpty():
        apart = joined(marked, wide, ["key"]).select("id").distinct()
        rare = _by_rare_kmers(needed.join(small(apart), "id", "left_semi"), least, shelf)
        again = shelf.put(_marked(rare, labels), "marked", tasks)
        pairs = _candidates(again, shelf.put(_outside(again), "unlike", tasks), bits, least, shelf)
        links, labels = _linked(pairs, links, needed, least, shelf)
    shelf.drop(marked, unlike)
    twice = usable.groupBy("id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("id")
    repeated = members.where("id != node").join(twice, "id", "left_semi").select(F.col("node").alias("a"), F.col("id").alias("b"))
    if not repeated.isEmpty():
        labels = components(links.unionByName(repeated), shelf)
    copies = joined(members.select("id", "node"), labels, ["node"], "left").select("id", F.coalesce("label", "node").alias("class_id"))
    by_id = shelf.put(copies.unionByName(labels.select(F.col("node").alias("id"), F.col("label").alias("class_id"))).groupBy("id").agg(F.min("class_id").alias("class_id")), "classes", tasks)
    out = shelf.put(joined(found.select("id"), by_id, ["id"], "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id")), "classes", tasks)
    shelf.keep(out)
    shelf.clear()
    return out
