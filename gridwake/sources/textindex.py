"""A stored inverted index: imports add to it, searches read the postings of their terms and no text.

Postings (term, id, occurrences, length of the text) lie in folders by a hash of the term and are sorted by it, so a
search reads a few row groups. An import writes its own folder and then a line of the log; readers take the imports
that the log names, so one that is broken off is not seen.
"""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stemmed
from ..operators.retrieval import B, K1

#: Folders of postings, and bytes of texts that one task of an import counts.
PARTS, SLICE = 64, 8 << 20

_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1]
_FROM, _TO = "".join(_MARKED), "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in small letters without marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), _FROM, _TO), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class TextIndex:
    """An index in a folder of a shared file system, over texts with ids."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema("run string, docs long, tokens long").parquet(f"{self.folder}/log") if there else None

    def _runs(self) -> list[str]:
        log = self._log()
        return [r["run"] for r in log.select("run").collect()] if log is not None else []  # one row an import

    def _read(self, name: str, kinds: str) -> DataFrame:
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/run={r}" for r in runs])

    def documents(self) -> DataFrame:
        """``id`` and ``length`` of the texts that are in the index."""
        return self._read("documents", "id string, length long").select("id", "length")

    def postings(self) -> DataFrame:
        return self._read("postings", "term string, id string, tf long, length long, part int")

    def add(self, texts: DataFrame, id_col: str, *text_cols: str) -> int:
        """Index rows whose id isn't there yet; how many. Of rows with equal ids the least in the order of their texts is taken; a null id is left out.

        The text of a row is that of its columns in a row; a row without tokens is in the index, and is never found.
        Texts and counts are dealt by ids into slices as many as the texts' bytes ask for, so a task holds no more of a larger import.
        """
        run = f"r{uuid.uuid4().hex}"
        text = F.concat_ws("\n", *[F.col(c) for c in text_cols])
        rows = texts.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).where("id is not null")
        slices = int((rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // SLICE) + 1
        rows = rows.repartition(slices, "id")
        fresh = rows.join(self.documents().select("id"), "id", "left_anti")
        one = fresh.groupBy("id").agg(F.min("text").alias("text"))
        counted = one.select("id", tokens(F.col("text")).alias("tokens"))
        found = counted.select("id", F.size("tokens").cast("long").alias("length"), F.explode_outer("tokens").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
        kept = f"{self.folder}/work/{run}"
        found.write.parquet(kept)
        found = self.spark.read.schema(found.schema).parquet(kept)
        found.groupBy("id").agg(F.max("length").alias("length")).write.parquet(f"{self.folder}/documents/run={run}")
        stems = stemmed(found.select("term").where("term is not null").distinct(), "term")
        by_stem = found.join(stems, "term").repartition(slices, "id").groupBy(F.col("stem").alias("term"), "id", "length").agg(F.sum("tf").alias("tf"))
        dealt = by_stem.withColumn("part", _part(F.col("term"))).repartitionByRange(max(slices, PARTS), "part", "term", "id").sortWithinPartitions("part", "term", "id")
        dealt.write.partitionBy("part").parquet(f"{self.folder}/postings/run={run}")
        sums = self.spark.read.schema("id string, length long").parquet(f"{self.folder}/documents/run={run}").agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
        sums.select(F.lit(run).alias("run"), "docs", "tokens").coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        work = self.spark._jvm.org.apache.hadoop.fs.Path(kept)
        work.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(work, True)
        return self._log().where(F.col("run") == run).first()["docs"]

    def search(self, question: str, limit: int | None = None) -> DataFrame:
        """``id`` and ``score`` (BM25) of the texts with any stem of the question, best first, then by id; only postings of these stems are read.

        An inverse document frequency is that of log(1 + (N - n + 0.5) / (n + 0.5)), over zero for any n. A question
        without terms finds nothing.
        """
        asked = self.spark.createDataFrame([(question,)], "question string").select(F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
        stems = stemmed(asked, "term").select("stem", _part(F.col("stem")).alias("part")).distinct().collect()
        kinds = "id string, score double"
        log = self._log()
        if not stems or log is None:
            return self.spark.createDataFrame([], kinds)
        whole = log.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
        mean = whole["tokens"] / whole["docs"] if whole["tokens"] else 1.0
        rows = self.postings().where(F.col("part").isin(sorted({r["part"] for r in stems})) & F.col("term").isin([r["stem"] for r in stems])).select("term", "id", "tf", "length")
        often = rows.groupBy("term").agg(F.count("*").alias("n"))  # a row for each stem of the question
        idf = F.log((whole["docs"] - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
        scored = rows.join(F.broadcast(often), "term").groupBy("id").agg(F.sum(weight).alias("score"))
        return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(limit) if limit is not None else scored
