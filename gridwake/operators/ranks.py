"""Places in an order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def placed(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in an order that leaves no ties.

    Rows are dealt by ranges of the order and kept, so that a range that is computed again holds the same rows; each
    range is numbered by itself and begins after the rows of the ranges before it, of which there is one count each.
    """
    kept = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return kept.join(F.broadcast(before), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")
