"""Scans of a large source that go on where they ended: a manifest says which shards are done, and for which content.

Each run computes the shards whose fingerprint is new and writes their results to a folder of its own; then a new
version of the manifest names the run that holds each shard. Readers take the last whole version, so a run that is
broken off, and one whose source changed while it ran, leave what was there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceChanged(RuntimeError):
    """The source is no longer what was scanned; nothing was published."""


def by_content(rows: DataFrame, shard: str) -> DataFrame:
    """``shard`` and ``fingerprint`` of each shard: rows, and two order-free sums of their hashes. All columns count."""
    one = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    two = F.xxhash64(F.lit("second"), *[F.col(c) for c in sorted(rows.columns)])
    sums = rows.groupBy(F.col(shard).cast("string").alias("shard")).agg(F.count("*").alias("n"), F.bit_xor(one).alias("a"), F.sum(two.cast("decimal(20,0)")).alias("b"))
    return sums.select("shard", F.sha2(F.concat_ws("/", "n", "a", F.col("b").cast("string")), 256).alias("fingerprint"))


def by_file(rows: DataFrame) -> DataFrame:
    """``shard`` (a hash of a file's path) and ``fingerprint`` (of its size and time) for a table of files; no column is read."""
    meta = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return meta.select(F.sha2("file_path", 256).alias("shard"), F.sha2(F.concat_ws("/", "file_size", F.col("file_modification_time").cast("string")), 256).alias("fingerprint"))


def with_file(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``shard`` that ``by_file`` names."""
    return rows.withColumn("shard", F.sha2("_metadata.file_path", 256))


class Scan:
    """The results of a computation over the shards of a source, kept in a folder of a shared file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last whole version of the manifest; 0 if there is none."""
        files, home = self._files(), self._path("manifest")
        if not files.exists(home):
            return 0
        found = [s.getPath().getName() for s in files.listStatus(home)]
        return max((int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and files.exists(self._path(f"manifest/{n}/_SUCCESS"))), default=0)

    def manifest(self) -> DataFrame:
        """``shard``, ``fingerprint`` and ``run``, one row for each shard that is done."""
        version = self.version()
        kinds = "shard string, fingerprint string, run string"
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/manifest/v{version}") if version else self.spark.createDataFrame([], kinds)

    def update(self, source: Callable[[], DataFrame], prints: Callable[[DataFrame], DataFrame], compute: Callable[[DataFrame], DataFrame]) -> int:
        """Compute the shards of ``source()`` that are new or changed, forget those that are gone; how many were computed.

        ``source`` opens the table anew each time and its rows have a ``shard`` as ``prints`` names it; ``compute``
        turns rows of some shards into results with a ``shard``. A shard whose rows give no results is done, too.
        Raises SourceChanged, and publishes nothing, if fingerprints differ after the computation.
        """
        before, version, run = prints(source()), self.version(), f"r{uuid.uuid4().hex}"
        now = self._kept(before, f"work/{run}/prints")
        done = self.manifest()
        new = self._kept(now.join(done, ["shard", "fingerprint"], "left_anti"), f"work/{run}/new")
        count = new.count()
        if count:
            compute(source().join(new.select("shard"), "shard", "left_semi")).write.parquet(f"{self.folder}/results/run={run}")
        after = prints(source())
        if not after.exceptAll(now).isEmpty() or not now.exceptAll(after).isEmpty():
            self._drop(f"results/run={run}")
            self._drop(f"work/{run}")
            raise SourceChanged("the source changed while it was scanned; nothing was published")
        left = done.join(now, ["shard", "fingerprint"], "left_semi")
        if count or left.count() != done.count():
            both = left.unionByName(new.withColumn("run", F.lit(run)))
            both.write.mode("overwrite").parquet(f"{self.folder}/manifest/v{version + 1}")  # one without its mark of success may be there
        self._drop(f"work/{run}")
        return count

    def results(self) -> DataFrame | None:
        """What was computed for the shards of the manifest; None before any result."""
        if not self.version() or not self._files().exists(self._path("results")):
            return None
        rows = self.spark.read.parquet(f"{self.folder}/results")
        return rows.join(self.manifest().select("shard", "run"), ["shard", "run"], "left_semi").drop("run")

    def matches(self, source: DataFrame, prints: Callable[[DataFrame], DataFrame]) -> bool:
        """Whether the manifest is that of the source as it is."""
        now, done = prints(source), self.manifest().select("shard", "fingerprint")
        return now.exceptAll(done).isEmpty() and done.exceptAll(now).isEmpty()

    def tidy(self) -> None:
        """Delete results and manifests that the last version doesn't name; not while another run writes."""
        files, keep = self._files(), {r["run"] for r in self.manifest().select("run").distinct().collect()}
        for name, used in (("results", {f"run={r}" for r in keep}), ("manifest", {f"v{self.version()}"})):
            if files.exists(self._path(name)):
                for status in files.listStatus(self._path(name)):
                    if status.getPath().getName() not in used:
                        files.delete(status.getPath(), True)

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _drop(self, name: str) -> None:
        self._files().delete(self._path(name), True)
