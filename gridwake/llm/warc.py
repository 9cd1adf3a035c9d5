"""Web archives: writing records, and reading them back by boundary-chain verification.

Archives are plain WARC 1.0 files, one record after the other. Readers get byte ranges. In a range
every occurrence of the magic is a candidate record: its header names its length, and so its
successor. A magic inside a payload is a candidate, too. Which candidates are records is decided by
the chain from the file's start: inside each range pointer jumping finds where a chain that enters at
a candidate leaves it; over the ranges of a file pointer jumping finds the entries that the start
reaches; then each range keeps the candidates on the chain from its entry.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import in_small_batches, joined, new_path

MAGIC = "WARC/1.0\r\n"
#: Between records; the text writer puts it after each.
END = "\r\n\r\n"
#: Groups of equal payloads on the driver and in a broadcast at most; beyond, they are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_CANDIDATE = "file string, block long, at long, size long, next long, page_id long, kind string, refers_to long, payload_bytes long, payload_digest string, whole boolean, good boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, html: str, sha1: str, first: int | None) -> str:
    """One record without its end: a response, or a revisit of page ``first`` with the HTTP header alone."""
    size = len(html.encode())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    revisit = first is not None and page_id is not None and first != page_id
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha1))}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    body = head if revisit else head + html
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body.encode())}"]
    return MAGIC + "\r\n".join(lines) + "\r\n\r\n" + body


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "first")), strict=True)
        yield pa.RecordBatch.from_pydict({"value": pa.array([record(*row) for row in rows], pa.large_string()).cast(pa.string())})


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Write one record for each row to archives below ``path``.

    Of rows with equal payloads of at least ``least`` bytes that with the smallest id is a response and
    the others are revisits of it; smaller payloads are all responses. A null html is an empty payload.
    Rows with a null id are responses and are never referred to; rows that share the smallest id are all
    responses. An empty table writes no record.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = in_small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    copies = rows.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    copies = copies.checkpoint()
    if copies.count() <= MOST_BROADCAST:
        marked = rows.join(F.broadcast(copies.drop("n")), "sha1", "left")
    else:
        marked = joined(rows, copies.drop("n"), ["sha1"], "left", counts=copies)
    marked.mapInArrow(_render, "value string").write.option("lineSep", END).text(path)


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rb"^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r?$", head, re.M | re.I)
    return found[1].decode("utf-8", "replace") if found else None


def _number(text: str | None) -> int | None:
    found = re.search(r"(\d+)>?$", text or "")
    return int(found[1]) if found else None


def parse(segment: bytes, at: int) -> dict | None:
    """What the bytes after a magic say: the successor's place, and the record's fields; None if they are no header."""
    end = segment.find(b"\r\n\r\n")
    length = _number(_field(segment[: end + 2], "Content-Length")) if end >= 0 else None
    if length is None:
        return None
    head, body = segment[: end + 2], segment[end + 4 : end + 4 + length]
    size = end + 4 + length
    return {"next": at + len(MAGIC) + size + len(END), "kind": _field(head, "WARC-Type"), "page_id": _number(_field(head, "WARC-Record-ID")), "refers_to": _number(_field(head, "WARC-Refers-To")), "whole": len(segment) >= size} | _payload(head, body)


def _payload(head: bytes, body: bytes) -> dict:
    """Length and digest of the payload: counted for responses, taken from the headers for revisits."""
    cut = body.find(b"\r\n\r\n")
    http, payload = body[: max(cut, 0) + 2], body[cut + 4 :] if cut >= 0 else b""
    claimed = (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    if _field(head, "WARC-Type") == "revisit":
        return {"payload_bytes": _number(_field(http, "Content-Length")), "payload_digest": claimed, "good": True}
    found = base32(hashlib.sha1(payload).digest())
    return {"payload_bytes": len(payload), "payload_digest": found, "good": found == claimed}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece between magics: its place in its range, and what it says as a record."""
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    kinds = {"file": pa.string(), "kind": pa.string(), "payload_digest": pa.string(), "whole": pa.bool_(), "good": pa.bool_()}
    where, at = None, 0
    for batch in batches:
        rows = []
        for value, file, block in zip(batch["value"], batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True):
            value = value.as_py()
            if (file, block) != where:
                where, at = (file, block), 0
            rows.append({"file": file, "block": block, "at": at - len(MAGIC), "size": len(value) + len(MAGIC)} | (parse(value, at - len(MAGIC)) or {}))
            at += len(value) + len(MAGIC)
        yield pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in rows], kinds.get(n, pa.int64())) for n in names})


def _leaves(key, rows):
    """Of each candidate of a range: the first place outside of the range that its chain comes to."""
    at, following = rows["at"].to_numpy(), rows["next"].to_numpy()
    stop = rows["stop"][0].as_py()
    jump = _jumps(at, following)
    while not np.array_equal(jump, further := jump[jump]):
        jump = further
    out = following[jump]
    keep = out >= stop
    return pa.table({"file": rows["file"].filter(pa.array(keep)), "at": at[keep], "leaves": out[keep]})


def _jumps(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The candidate at each one's successor; itself where there is none."""
    place = np.minimum(np.searchsorted(at, following), len(at) - 1)
    return np.where(at[place] == following, place, np.arange(len(at)))


def _on_chain(key, rows, entries):
    """The candidates of a range that the chain from its entry passes."""
    rows = rows.sort_by("at")
    at = rows["at"].to_numpy()
    jump = _jumps(at, rows["next"].to_numpy()) if len(at) else at
    on = np.zeros(len(at), bool)
    for entry in entries["entry_at"].to_pylist():
        i = int(np.searchsorted(at, entry))
        while i < len(at) and at[i] == entry and not on[i]:
            on[i], i = True, int(jump[i])
            entry = at[i]
    return rows.filter(pa.array(on)).drop(["stop"])


def _sorted(f):
    return lambda key, rows: f(key, rows.sort_by("at"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``good``
    (the digest of the payload is the one that the header names). Magic inside payloads starts no record;
    what a broken header cuts off is not returned. No record gives an empty table.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    pieces = text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    table = new_path(spark, "warc-candidates")
    pieces.mapInArrow(_candidates, _CANDIDATE).write.parquet(table)
    found = spark.read.schema(_CANDIDATE).parquet(table)
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("size"))
    ranges = sizes.select("file", "block", "size", (F.expr("coalesce(sum(size) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0)")).alias("base"))
    ranges = ranges.withColumn("stop", F.col("base") + F.col("size") - len(MAGIC)).drop("size")
    placed = found.where("next is not null").join(ranges, ["file", "block"]).withColumns({"at": F.col("at") + F.col("base"), "next": F.col("next") + F.col("base")}).drop("base", "size")
    most = sizes.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    entries = found.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    if most > 1:
        jumps = placed.groupBy("file", "block").applyInArrow(_sorted(_leaves), "file string, at long, leaves long").checkpoint()
        for i in range(math.ceil(math.log2(most))):
            reached = entries.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at"))
            entries = entries.unionByName(reached).distinct().checkpoint()
            jumps = jumps.join(jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then")), ["file", "leaves"]).select("file", "at", F.col("then").alias("leaves")).checkpoint()
    inner = placed.select("file", "block", "at").join(entries, ["file", "at"]).select(*[F.col(c).alias(f"entry_{c}") for c in ("file", "block", "at")])
    kept = placed.groupBy("file", "block").cogroup(inner.groupBy("entry_file", "entry_block")).applyInArrow(_on_chain, placed.drop("stop").schema)
    whole = kept.where("whole").select(*_RESULT)
    if placed.where("not whole").isEmpty():
        return whole
    return whole.unionByName(_split(pieces, ranges, kept.where("not whole")))


_RESULT = ("page_id", "payload_bytes", "payload_digest", "kind", "refers_to", "good")


def _split(pieces: DataFrame, ranges: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read again and put together."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = None, 0
        for batch in batches:
            places = []
            for n, file, block in zip(batch["n"].to_pylist(), batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True):
                if (file, block) != where:
                    where, at = (file, block), 0
                places.append(at - len(MAGIC))
                at += n + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(places, pa.int64()), batch["value"]], ["file", "block", "piece", "value"])

    def whole(key, rows):
        rows = rows.sort_by("piece")
        data = MAGIC.encode().join(rows["value"].to_pylist())
        got = parse(data, 0) or {}
        return pa.table({"page_id": pa.array([got.get("page_id")], pa.int64()), "payload_bytes": pa.array([got.get("payload_bytes")], pa.int64()), "payload_digest": pa.array([got.get("payload_digest")], pa.string()), "kind": pa.array([got.get("kind")], pa.string()), "refers_to": pa.array([got.get("refers_to")], pa.int64()), "good": pa.array([got.get("good")], pa.bool_())})

    placed = pieces.withColumn("n", F.octet_length("value")).mapInArrow(place, "file string, block long, piece long, value binary").join(ranges.select("file", "block", "base"), ["file", "block"]).withColumn("piece", F.col("piece") + F.col("base"))
    mine = _owned(placed, ranges, records).where("span is not null and piece < span.next").select("file", F.col("span.at").alias("at"), "piece", "value")
    return mine.groupBy("file", "at").applyInArrow(whole, "page_id long, payload_bytes long, payload_digest string, kind string, refers_to long, good boolean")


def _owned(pieces: DataFrame, ranges: DataFrame, records: DataFrame) -> DataFrame:
    """``pieces`` with the last record that begins at or before each (``span``), found in order within its range.

    A record that goes beyond its range is noted at the start of each further one; one at most crosses an edge.
    """
    span = F.struct("at", "next").alias("span")
    start = (F.col("base") - len(MAGIC)).alias("piece")
    beyond = records.select("file", "block", "at", "next").join(ranges.select("file", "block", "stop"), ["file", "block"]).where("next > stop")
    further = beyond.drop("block", "stop").join(ranges.select("file", "block", "base"), "file").select("file", "block", start, span).where("piece > span.at and piece < span.next")
    marks = records.select("file", "block", F.col("at").alias("piece"), span).unionByName(further)
    rows = pieces.select("file", "block", "piece", "value", F.lit(None).cast("struct<at:long,next:long>").alias("span")).unionByName(marks.withColumn("value", F.lit(None).cast("binary")).select("file", "block", "piece", "value", "span"))
    order = Window.partitionBy("file", "block").orderBy("piece", F.col("value").isNotNull(), F.col("span.at"))
    return rows.withColumn("span", F.last("span", ignorenulls=True).over(order)).where("value is not null")


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write the archives of a table to the shared folder and read them back; cases as in ``write`` and ``read``."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col, least)
    return read(spark, path).withColumnRenamed("kind", "record_type")
