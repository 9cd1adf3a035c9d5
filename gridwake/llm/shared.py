"""The folder that the driver and all executors share, and joins that hold when one key has much of the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are joined by broadcast at most, and the rows that such a key has at least.
HOT_KEYS, HOT_ROWS = 1000, 500
#: Bytes of an Arrow batch.
BATCH = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in local tests, one of our own.

    On a cluster an unset folder is an error: executors do not see each other's local files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridwake-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return (folder or own.get()).rstrip("/")


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold BATCH bytes at most, so a task's memory doesn't grow with its texts.

    A batch has one row at least. A session that has set another limit than Spark's keeps it.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in (None, "67108864b"):
        conf.set(name, BATCH)
    return docs


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Marked for a broadcast if it has at most ``most`` rows; else as it is, for a join by shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = rows.sparkSession
    path = new_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Shelf:
    """Stored tables that are not needed beyond a step: ``put`` stores one, ``drop`` deletes it from the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, rows: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
        """``rows``, stored by as many tasks at most, so that a small table is not dealt over all shuffle partitions."""
        path = new_path(self.spark, name)
        (rows.coalesce(tasks) if tasks else rows).write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def keep(self, *tables: DataFrame) -> None:
        """Not deleted by ``clear``."""
        for table in tables:
            self.paths.pop(id(table), None)

    def clear(self) -> None:
        self.drop(*[table for table, _ in list(self.paths.values())])


def hot_keys(rows: DataFrame, keys: list[str], counts: DataFrame | None = None, least: int = HOT_ROWS) -> DataFrame | None:
    """The most frequent keys with their rows (``hot_n``), HOT_KEYS at most, so any other key has under a thousandth of the rows; None if no key is frequent.

    ``counts`` holds the rows of each key as ``n``, where the caller has it already.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    counts = counts.select(*keys, F.col("n").alias("hot_n")).where(F.col("hot_n") >= least)
    top = counts.orderBy(F.desc("hot_n"), *keys).limit(HOT_KEYS)
    found = top.collect()
    return rows.sparkSession.createDataFrame(found, top.schema) if found else None


def joined(rows: DataFrame, by_key: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, hot: DataFrame | None = None, known: bool = False) -> DataFrame:
    """``rows`` with the columns of ``by_key``, which has one row for a key (or a small bounded number), even if a key has much of the rows.

    Rows of hot keys stay where they are and get a broadcast of these keys' rows, of which there are HOT_KEYS
    at most; all others are joined by shuffle. ``rows`` is read up to three times, so it should be stored. A
    caller that joins by the same keys again passes what ``hot_keys`` gave (``hot``, ``known``).
    """
    hot = hot if known else hot_keys(rows, keys, counts)
    if hot is None:
        return rows.join(by_key, keys, how)
    hot = F.broadcast(hot.drop("hot_n"))
    there = rows.join(hot, keys, "left_semi").join(F.broadcast(by_key.join(hot, keys, "left_semi")), keys, how)
    return there.unionByName(rows.join(hot, keys, "left_anti").join(by_key, keys, how))
