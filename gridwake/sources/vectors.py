"""Vectors of texts, computed once for each distinct text and model, by an embedder that the caller brings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that the embedder gets at a time.
BATCH = 32

Embedder = Callable[[list[str]], list]


def packed(vectors: list) -> pa.Array:
    """Vectors as little-endian 32-bit floats."""
    return pa.array([np.asarray(v, "<f4").tobytes() for v in vectors], pa.binary())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _embedded(embed: Embedder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                vectors = list(embed(part["text"].to_pylist()))
                if len(vectors) != part.num_rows:
                    raise ValueError("the embedder returned the wrong number of vectors")
                yield pa.RecordBatch.from_arrays([part["hash"], packed(vectors)], ["hash", "vector"])

    return run


class VectorCache:
    """A table of (model, hash, vector) in a folder of a shared file system; a vector is never computed twice."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def vectors(self, model: str) -> DataFrame:
        """``hash`` and ``vector`` of a model's texts."""
        kinds, path = "hash string, vector binary", self._path(f"vectors/model={model}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/vectors/model={model}")

    def update(self, texts: DataFrame, text_col: str, embed: Embedder, model: str) -> int:
        """Embed the distinct texts that the model has no vector of; how many. If the embedder fails, the cache stays as it was.

        A null text counts as an empty one. A model's name names a folder, so it has no slashes.
        """
        if not model or "/" in model:
            raise ValueError("a model's name has no slashes")
        rows = texts.select(text_hash(F.col(text_col)).alias("hash"), F.coalesce(text_col, F.lit("")).alias("text"))
        new = rows.join(self.vectors(model).select("hash"), "hash", "left_anti").groupBy("hash").agg(F.any_value("text").alias("text"))
        run = f"{self.folder}/work/{uuid.uuid4().hex}"
        new.mapInArrow(_embedded(embed), "hash string, vector binary").write.parquet(run)
        got = self.spark.read.schema("hash string, vector binary").parquet(run)
        n = got.count()
        if n:
            got.write.mode("append").parquet(f"{self.folder}/vectors/model={model}")
        work = self.spark._jvm.org.apache.hadoop.fs.Path(run)
        work.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(work, True)
        return n

    def of(self, texts: DataFrame, text_col: str, model: str) -> DataFrame:
        """``texts`` with ``vector`` (floats), null where the model has none."""
        held = self.vectors(model).withColumnRenamed("hash", "_hash")
        rows = texts.withColumn("_hash", text_hash(F.col(text_col))).join(held, "_hash", "left").drop("_hash")
        return rows.withColumn("vector", unpacked("vector"))
