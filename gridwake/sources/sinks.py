"""Writing tables whole or not at all, and previews of them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_whole(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write Parquet beside ``path``, then rename: a failed job leaves the old table, and so does a rename that fails.

    Between its two renames, for as long as a file system needs for one, there is no table; readers that can't wait
    for that read results of ``scan.Scan``, which are published by a manifest.
    """
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(staged)
    _replace(df.sparkSession, staged, path)


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    away = jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    had = fs.exists(old)
    if had and not fs.rename(old, away):
        raise OSError(f"cannot rename {path}")
    try:
        done = fs.rename(new, old)
    except Exception:
        done = False
    if not done:
        if had:
            fs.rename(away, old)
        raise OSError(f"cannot rename {staged} to {path}; the table is as it was")
    if had:
        fs.delete(away, True)


def preview(df: DataFrame, path: str, order: list[str], rows: int = 500) -> None:
    """The first rows in an order, as one CSV file with a header."""
    df.orderBy(*order).limit(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_meta(spark: SparkSession, values: dict, path: str) -> None:
    """A small JSON document beside a table."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
