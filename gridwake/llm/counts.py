"""Token counts of documents from the pieces of their pre-tokens, without any ids of a document.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges within each alone. So the corpus's distinct
pre-tokens are gathered, the pieces of each are counted once, and a document's count is the sum over its pre-tokens'
frequencies. The HEAD most frequent pre-tokens go to all tasks as digests of 16 bytes with their counts, and meet the
frequencies where these are; the others' frequencies become rows and are joined to their counts by shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import gathered
from .packing import _WHOLE, chunks, tokenizer_path
from .shared import in_small_batches, stored
from .text import buffers, is_space, slices

#: Pre-tokens that are broadcast, 20 bytes each; the rest is joined.
HEAD = 1 << 20
#: Distinct pre-tokens that a task holds before it sends them on, and bytes of text that are cut at a time.
HELD, SLICE = 400_000, 2 << 20
LIMIT = 512


def _open(path: str):
    """The tokenizer of a file, after a look at whether its pre-tokens are the ones that are cut here."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not path.endswith(".json"):
        raise ValueError(f"{path}: pre-tokens are those of byte-level BPE in a .json file")
    tokenizer = Tokenizer.from_file(path)
    if type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.normalizer is not None:
        raise ValueError(f"{path}: not byte-level BPE without a normaliser")
    return tokenizer


class Cutter:
    """Pre-tokens of texts, each distinct run of a word and the space before it cut once a slice.

    The distinct runs of a slice are cut as one text: a run that begins with a space can follow any other, one that
    doesn't follows a line break, which is a pre-token of its own there. Texts with white space beyond ASCII's, or with
    one of the tokenizer's special strings, are cut whole: at the special strings, which are one token each, and then
    by the tokenizer's pattern.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        self.tokenizer = _open(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}

    @property
    def full(self) -> bool:
        return len(self.number) > HELD

    def numbered(self, pieces: list[str]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pre-tokens of distinct runs, and where each run's begin."""
        data, offsets = buffers(runs)
        begin, size = offsets[:-1], np.diff(offsets)
        space = is_space(data[begin])
        second = is_space(data[np.minimum(begin + 1, max(len(data) - 1, 0))])
        plain, bare = (data[begin] == 32) & (size > 1) & ~second, ~space
        gaps = np.flatnonzero(~plain & ~bare)
        joined = np.concatenate((np.flatnonzero(plain), np.flatnonzero(bare)))
        units = pa.concat_arrays([runs.filter(pa.array(plain)), pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), runs.filter(pa.array(bare)), pa.scalar("", pa.large_string()))])
        found = self.pattern.findall(buffers(units)[0].tobytes().decode())
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        numbers = self.numbered(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if found else np.empty(0, np.int64)
        ends = np.cumsum(pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64))
        until = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends, "right")
        start = np.r_[0, until[:-1]] if len(until) else until
        start[plain.sum() :] += 1  # the line break
        own = [self.numbered(self.pattern.findall(g)) for g in runs.take(pa.array(gaps)).to_pylist()]
        count = np.zeros(len(size), np.int64)
        count[joined], count[gaps] = until - start, [len(x) for x in own]
        base = np.zeros(len(size), np.int64)
        base[joined], base[gaps] = start, len(numbers) + np.cumsum(count[gaps]) - count[gaps]
        numbers = np.concatenate([numbers, *own])
        first = np.r_[0, np.cumsum(count)]
        return numbers[np.arange(first[-1]) + np.repeat(base - first[:-1], count)], first

    def cut(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice: the numbers of all its pre-tokens, how many each document has, and its special tokens."""
        data, offsets = buffers(texts)
        for a, b in slices(offsets, SLICE):
            own, edge = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            start, end, first = chunks(own, edge)
            coded = gathered(own, start, end).dictionary_encode()
            if len(start):
                flat, begin = self._runs(coded.dictionary)
                at = coded.indices.to_numpy(zero_copy_only=False)
                n = np.diff(begin)[at]
                until = np.r_[0, np.cumsum(n)]
                found = flat[np.arange(until[-1]) + np.repeat(begin[at] - until[:-1], n)]
            else:
                found, until = np.empty(0, np.int64), np.zeros(1, np.int64)
            per, ones = np.diff(until[first]), np.zeros(b - a, np.int64)
            rare = np.flatnonzero((own == 0xC2) | ((own >= 0xE1) & (own <= 0xE3)) | (own == 60))
            odd = [i for i in np.flatnonzero(np.diff(np.searchsorted(rare, edge))) if _WHOLE.search(own[edge[i] : edge[i + 1]].tobytes())]
            if odd:
                parts = np.split(found, np.cumsum(per)[:-1])
                for i in odd:
                    parts[i], ones[i] = self._whole(own[edge[i] : edge[i + 1]].tobytes().decode())
                found, per = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            yield found, per, ones

    def _whole(self, text: str) -> tuple[np.ndarray, int]:
        segments = self.special.split(text) if self.special else [text]
        return self.numbered([p for s in segments for p in self.pattern.findall(s)]), len(segments) - 1


def _vocabulary(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, total = Cutter(path), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            some = total > 0  # a text that is cut whole leaves pieces of its runs behind
            return pa.RecordBatch.from_pydict({"token": pa.array(list(cutter.number), pa.string()), "n": pa.array(total, pa.int64())}).filter(pa.array(some))

        for batch in batches:
            for found, _, _ in cutter.cut(batch["text"]):
                more = np.bincount(found, minlength=len(cutter.number))
                more[: len(total)] += total
                total = more
                if cutter.full:
                    yield told()
                    cutter.forget()
                    total = np.zeros(0, np.int64)
        yield told()

    return run


def digest(token: str) -> bytes:
    return hashlib.blake2b(token.encode(), digest_size=16).digest()


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _open(path)
        for batch in batches:
            tokens = batch["token"].to_pylist()
            pieces = [len(e) for e in tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([digest(t) for t in tokens], pa.binary()), "n": batch["n"], "pieces": pa.array(pieces, pa.int64())})

    return run


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``key``, ``n`` and ``pieces`` of each distinct pre-token of the texts: its digest, how often it occurs, and its tokens."""
    texts = in_small_batches(docs).select(F.col(text_col).alias("text"))
    tokens = texts.mapInArrow(_vocabulary(path), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return tokens.mapInArrow(_counted(path), "key binary, n long, pieces long")


#: Pre-tokens are counted by sixteenths of a power of two of their frequency: at most some 1,000 bands.
def band() -> Column:
    return F.floor(16 * F.log2("n"))


def _lowest_band(pieces: DataFrame, head: int) -> tuple[int, bool]:
    """The lowest band from which on there are at most ``head`` pre-tokens, and whether that is all of them."""
    lowest, n = 1 << 20, 0
    for at, more in pieces.groupBy(band().alias("band")).agg(F.count("*")).orderBy(F.desc("band")).collect():
        if n + more > head:
            return lowest, False
        lowest, n = at, n + more
    return lowest, True


class Head:
    """Counts of some pre-tokens by digest: sorted halves of the digests, and the counts."""

    def __init__(self, keys: list[bytes], pieces: list[int]) -> None:
        both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.argsort(both[:, 0], kind="stable")
        self.high, self.low, self.pieces = both[order, 0], both[order, 1], np.array(pieces, np.int64)[order]

    def of(self, tokens: list[str]) -> np.ndarray:
        """Pieces of each token, -1 where it isn't known."""
        both = np.frombuffer(b"".join(map(digest, tokens)), ">u8").reshape(-1, 2).astype(np.uint64)
        out, at = np.full(len(tokens), -1, np.int64), np.searchsorted(self.high, both[:, 0])
        open_ = np.flatnonzero(at < len(self.high))
        while len(open_):  # more than one step only where first halves are equal
            open_ = open_[self.high[at[open_]] == both[open_, 0]]
            same = self.low[at[open_]] == both[open_, 1]
            out[open_[same]] = self.pieces[at[open_[same]]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.high)]
        return out


def _summed(path: str, head):
    """Rows with what the head's counts sum to, and the frequencies of the pre-tokens that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known, pieces = Cutter(path), head.value, np.zeros(0, np.int64)
        for batch in batches:
            sums, docs, keys, often = [], [], [], []
            begin = 0
            for found, per, ones in cutter.cut(batch["text"]):
                if len(cutter.number) > len(pieces):
                    new = list(cutter.number)[len(pieces) :]
                    pieces = np.r_[pieces, known.of(new)]
                names = list(cutter.number)
                got = pieces[found]
                until = np.r_[0, np.cumsum(np.maximum(got, 0))]
                edge = np.r_[0, np.cumsum(per)]
                sums.append(until[edge[1:]] - until[edge[:-1]] + ones)
                left = got < 0
                if left.any():
                    pair, n = np.unique(np.repeat(np.arange(len(per)), per)[left] * len(names) + found[left], return_counts=True)
                    docs.append(pair // len(names) + begin)
                    keys += [digest(names[i]) for i in (pair % len(names)).tolist()]
                    often.append(n)
                begin += len(per)
                if cutter.full:
                    cutter.forget()
                    pieces = np.zeros(0, np.int64)
            rows = batch.num_rows
            edges = np.r_[0, np.cumsum(np.bincount(np.concatenate(docs) if docs else np.empty(0, np.int64), minlength=rows))]
            rest = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(often) if often else np.empty(0, np.int64), pa.int64())], ["key", "often"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "sum": np.concatenate(sums) if sums else np.empty(0, np.int64), "rest": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rest)})

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row, as the tokenizer of the file gives them.

    A null or empty text has no bytes and no tokens. Rows that repeat, or share an id or have none, are counted each on
    its own. An empty table gives an empty one. Columns other than id and text are not read. Texts of any length are
    counted whole; a special string inside a text is one token, as the library has it by default.
    """
    path = path or tokenizer_path()
    pieces = stored(vocabulary(docs, path, text_col), "pieces")
    lowest, all_in = _lowest_band(pieces, head)
    top = pieces.where(band() >= lowest).select("key", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(Head(top["key"].to_pylist(), top["pieces"].to_pylist()))
    rows = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    summed = rows.mapInArrow(_summed(path, known), f"doc_id {kind}, n_bytes long, sum long, rest array<struct<key: binary, often: bigint>>")
    if all_in:
        whole = summed.select("doc_id", "n_bytes", F.col("sum").alias("n_tokens"))
    else:
        kept = stored(summed.withColumn("row", F.monotonically_increasing_id()), "summed")  # rows are numbered once
        rare = kept.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.often")
        more = rare.join(pieces.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("often") * F.col("pieces")).alias("more"))
        open_ = F.size("rest") > 0
        joined = kept.where(open_).select("row", "doc_id", "n_bytes", "sum").join(more, "row").select("doc_id", "n_bytes", (F.col("sum") + F.col("more")).alias("n_tokens"))
        whole = kept.where(~open_).select("doc_id", "n_bytes", F.col("sum").alias("n_tokens")).unionByName(joined)
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
