"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Attention costs a sequence about its tokens plus, for each piece in it, the square of the piece's length.
Documents of a block are taken by falling length, each to the sequence of least cost so far that still has
room for all of it; where none has, the cheapest takes as much as it can and the rest goes on. A block's sequences hold exactly its tokens: as many whole ones as they fill, and what is left over as
sequences of a power of two, which need no padding. Sequences never mix blocks.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_small_batches
from .text import SLICE_BYTES, buffers, find_words, is_space, slices, span_hashes

SEQUENCE, END_ID = 2048, 1
#: Tokens of a block at least (the last of a task has what is left), and the weight of the square.
BLOCK_TOKENS, SQUARE = 4_000_000, 1.0 / 2048
#: Distinct chunks whose ids a task remembers; then it starts anew.
REMEMBERED = 2_000_000

#: Stands for no sequence.
_NONE = (float("inf"), -1)

#: White space beyond the six ASCII characters, and the special token: such texts are encoded whole.
_WHOLE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|endoftext\|>")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer, each distinct chunk encoded once.

    The tokenizer cuts a text before it merges; a word with one space before it, and the white space that is
    left between, are never merged across. So the ids of a text are those of these chunks in a row. New
    chunks that begin with a space are encoded as one text by the rank file beside the tokenizer's file,
    which holds the same vocabulary and is several times as fast; all else by the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.edges, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def documents(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in order; a null text has none."""
        data, offsets = buffers(texts)
        for a, b in slices(offsets, 2 * SLICE_BYTES):
            own, edge = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            ids, at = self._slice(own, edge)
            rare = np.flatnonzero((own == 0xC2) | ((own >= 0xE1) & (own <= 0xE3)) | (own == 60))
            odd = np.diff(np.searchsorted(rare, edge)) > 0
            for i in range(b - a):
                text = own[edge[i] : edge[i + 1]].tobytes() if odd[i] else b""
                yield self.whole(text.decode()) if odd[i] and _WHOLE.search(text) else ids[at[i] : at[i + 1]]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, first = chunks(data, offsets)
        if len(self.place) > REMEMBERED:
            self.forget()
        hashes, index, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        known = self.place
        where = np.array([known.get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            self._learn(data, start[index[new]], end[index[new]], hashes[new], new, where)
        chunk = where[back]
        size = self.edges[chunk + 1] - self.edges[chunk]
        until = np.cumsum(size)
        source = np.arange(until[-1] if len(until) else 0) + np.repeat(self.edges[chunk] - (until - size), size)
        return self.ids[source], np.r_[0, until][first]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, new: np.ndarray, where: np.ndarray) -> None:
        size = end - start
        plain = (data[start] == 32) & (size > 1) & ~is_space(data[np.minimum(start + 1, len(data) - 1)])
        many, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        until = np.cumsum(size[many])
        source = np.arange(until[-1] if len(until) else 0) + np.repeat(start[many] - (until - size[many]), size[many])
        joined = self.fast.encode_to_numpy(data[source].tobytes().decode(), allowed_special=set(), disallowed_special=())
        ends = np.searchsorted(np.cumsum(self.bytes[joined]), until, "right")
        texts = [data[a:b].tobytes().decode() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        single = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.concatenate((np.diff(ends, prepend=0), np.array([len(x) for x in single], np.int64)))
        base = len(self.edges) - 1
        where[new[np.concatenate((many, rest))]] = np.arange(base, base + len(new))
        self.place.update(zip(hashes.tolist(), where[new].tolist(), strict=True))
        self.edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, joined.astype(np.uint32), np.array([i for x in single for i in x], np.uint32)))


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of each document in order, and each document's first chunk.

    A word takes the space before it. White space before that is one chunk; before a word without a space
    (after a line break) its last character is a chunk of its own.
    """
    words = find_words(data, offsets)
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    start = words.start - ((words.start > 0) & (data[np.maximum(words.start - 1, 0)] == 32) & ~opens[words.start])
    doc_start, doc_end = offsets[:-1], offsets[1:]
    left = np.concatenate((words.end, doc_start))
    right_of = np.concatenate((start, doc_end))
    gap_from, gap_to = np.sort(left), np.sort(right_of)
    keep = gap_to > gap_from
    gap_from, gap_to = gap_from[keep], gap_to[keep]
    bare = np.zeros(len(data) + 1, bool)
    bare[start[start == words.start]] = True
    cut = bare[gap_to] & ~opens[gap_to] & (gap_to - gap_from > 1)
    starts = np.concatenate((start, gap_from, gap_to[cut] - 1))
    ends = np.concatenate((words.end, np.where(cut, gap_to - 1, gap_to), gap_to[cut]))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(starts, offsets)


def capacities(tokens: int, size: int = SEQUENCE) -> list[int]:
    """Lengths of a block's sequences: whole ones, then powers of two."""
    return [size] * (tokens // size) + [1 << i for i in reversed(range(size.bit_length())) if tokens % size >> i & 1]


class Open:
    """Sequences with room left: the one of least cost (then least number) among those with at least so much room."""

    def __init__(self, rooms: list[int]) -> None:
        self.width = 1 << max(rooms, default=0).bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.least: list[tuple[float, int]] = [_NONE] * (2 * self.width)
        for i, room in enumerate(rooms):
            heapq.heappush(self.heaps[room], (0.0, i))
        for room in set(rooms):
            self._lift(room)

    def _lift(self, room: int) -> None:
        least, at = self.least, room + self.width
        least[at] = self.heaps[room][0] if self.heaps[room] else _NONE
        while at > 1:
            at >>= 1
            a, b = least[2 * at], least[2 * at + 1]
            least[at] = a if a < b else b

    def cheapest(self, room: int) -> tuple[float, int]:
        """Cost and number; _NONE if no sequence has so much room."""
        found, low, high, least = _NONE, room + self.width, 2 * self.width, self.least
        if room >= self.width:
            return found
        while low < high:
            if low & 1:
                found, low = min(found, least[low]), low + 1
            if high & 1:
                high -= 1
                found = min(found, least[high])
            low, high = low >> 1, high >> 1
        return found

    def move(self, sequence: int, cost: float, room: int, left: int) -> None:
        """A sequence that had ``room`` (and is the cheapest with that) has ``left`` now, at a new cost."""
        heapq.heappop(self.heaps[room])
        self._lift(room)
        if left:
            heapq.heappush(self.heaps[left], (cost, sequence))
            self._lift(left)


def pack(lengths: list[int], size: int = SEQUENCE, square: float = SQUARE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a block; every sequence comes out full."""
    rooms = capacities(sum(lengths), size)
    room, open_ = list(rooms), Open(rooms)
    pieces = []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[doc]
        while left:
            cost, i = open_.cheapest(left)
            if i < 0:  # none has room for all
                cost, i = open_.cheapest(1)
            n, had = min(left, room[i]), room[i]
            pieces.append((doc, start, n, i, rooms[i] - had))
            room[i] -= n
            open_.move(i, cost + n + square * n * n, had, room[i])
            start, left = start + n, left - n
    return pieces


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Each document is its tokenizer ids and ``end_id``, so a null or empty text is one token. Every row is
    packed, rows with equal or null ids too. A task packs its rows in blocks as it reads them, so nothing is
    shuffled; ``sequence_id`` holds the task's number and counts up in it. An empty table gives an empty one.
    ``path`` is the tokenizer file on the executors (default: the installed public one).
    """
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or tokenizer_path())
        held: list[tuple[int | None, np.ndarray]] = []
        tokens, base = 0, TaskContext.get().partitionId() << 36
        for batch in batches:
            for key, ids in zip(batch["id"].to_pylist(), encoder.documents(batch["text"]), strict=True):
                held.append((key, np.append(ids, np.uint32(end_id))))
                tokens += len(ids) + 1
                if tokens >= block_tokens:
                    yield from _block(held, base, size)
                    base += len(capacities(tokens, size))
                    held, tokens = [], 0
        if held:
            yield from _block(held, base, size)

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _block(held: list[tuple[int | None, np.ndarray]], base: int, size: int) -> Iterator[pa.RecordBatch]:
    pieces = pack([len(ids) for _, ids in held], size)
    doc, start, length, sequence, offset = (list(c) for c in zip(*pieces, strict=True))
    crc = [zlib.crc32(held[d][1][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc, start, length, strict=True)]
    yield pa.RecordBatch.from_pydict({
        "id": pa.array([held[d][0] for d in doc], pa.int64()),
        "start": pa.array(start, pa.int64()),
        "length": pa.array(length, pa.int64()),
        "ids_crc32": pa.array(crc, pa.int64()),
        "doc_tokens": pa.array([len(held[d][1]) for d in doc], pa.int64()),
        "sequence_id": pa.array([base + s for s in sequence], pa.int64()),
        "offset": pa.array(offset, pa.int64()),
    })
