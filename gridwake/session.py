"""A Spark session with the settings that the queries rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is the cluster's choice."""
    builder = SparkSession.builder.appName("gridwake")
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; where it is unset a local session takes one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridwake-"))
    return (folder or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder that the cluster shares, so later plans begin there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a written table in that folder: columns of like values take a fraction of a checkpoint's rows."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
