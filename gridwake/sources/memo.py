"""Results by entity that are computed once for what they were computed from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Memo:
    """Rows of results by id, in a folder of a shared file system, apart for each source, preset and whatever else is told."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, **of: object) -> None:
        """``of`` names what results depend on (source, preset, thresholds); ``schema`` is that of the results, with an ``id string``."""
        kind = hashlib.sha256(json.dumps(of | {"schema": schema}, sort_keys=True, default=str).encode()).hexdigest()[:32]
        self.spark, self.schema, self.folder = spark, schema, f"{folder.rstrip('/')}/memo-{kind}"

    def _runs(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if files.exists(done(f"{self.folder}/done/{n}/_SUCCESS")))

    def _read(self, name: str, schema: str) -> DataFrame:
        runs = [f"{self.folder}/{name}/{r}" for r in self._runs()]
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def fetch(self, ids: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """The results of the ids (``id``), and how many ids were computed for that.

        ``compute`` turns ids into rows of results; an id that it gives none for is not asked again. A run that fails
        is as if it had not been.
        """
        wanted = ids.select(F.col("id").cast("string")).where("id is not null").distinct()
        run, done = f"r{uuid.uuid4().hex}", self._read("done", "id string")
        work = f"{self.folder}/work/{run}"
        wanted.join(done, "id", "left_anti").write.parquet(work)
        missing = self.spark.read.schema("id string").parquet(work)
        n = missing.count()
        if n:
            compute(missing).write.parquet(f"{self.folder}/results/{run}")
            missing.write.parquet(f"{self.folder}/done/{run}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(work)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return self._read("results", self.schema).join(wanted, "id", "left_semi"), n
