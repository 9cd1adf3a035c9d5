"""What a raw table holds: types, nulls, distinct values and shapes of every column, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the filled cells that makes a column numeric, and one that makes it mixed.
NUMERIC, MIXED = 0.99, 0.5


def columns(df: DataFrame) -> DataFrame:
    """A row for each column of a table of strings: ``column``, ``n``, ``null_pct``, ``n_distinct`` (approximate), ``kind``.

    ``kind`` is empty, integer, number, mixed or text, by the share of filled cells that are numbers.
    An empty table gives a row of nulls and zeros for each column.
    """
    filled = lambda c: F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string")))
    cols = [F.col(f"`{c}`") for c in df.columns]
    number = [filled(c).try_cast("double") for c in cols]
    aggs = [
        F.struct(
            F.lit(name).alias("column"), F.count("*").alias("n"),
            F.round(100 * (1 - F.try_divide(F.count(filled(c)), F.count("*"))), 4).alias("null_pct"),
            F.approx_count_distinct(filled(c)).alias("n_distinct"),
            F.try_divide(F.count(x), F.count(filled(c))).alias("share"),
            F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)).alias("whole"),
        )
        for name, c, x in zip(df.columns, cols, number, strict=True)
    ]
    rows = df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))
    kind = F.when(F.col("share").isNull(), "empty").when((F.col("share") >= NUMERIC) & F.col("whole"), "integer").when(F.col("share") >= NUMERIC, "number").when(F.col("share") >= MIXED, "mixed").otherwise("text")
    return rows.select("column", "n", "null_pct", "n_distinct", kind.alias("kind"))


def duplicates(df: DataFrame) -> int:
    """Rows that repeat an earlier row in all columns."""
    same = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return same.agg(F.sum(F.col("_n") - 1)).first()[0] or 0


def linked(df: DataFrame, other: DataFrame, key: str) -> float:
    """Percentage of the distinct keys of ``df`` that ``other`` has; 0 for none."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    hit = keys.join(other.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(100.0 * F.try_divide(F.count("_hit"), F.count("*"))).first()[0] or 0.0
