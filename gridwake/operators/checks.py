"""Checks of frames, key sets and numbers in answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame(df: DataFrame, value: str, at: str, low: str, high: str, pad: float) -> DataFrame:
    """One row: null values, rows outside their window and its pad, and whether there is no row at all."""
    outside = (F.col(at) < F.col(low) - pad) | (F.col(at) > F.col(high) + pad)
    return df.agg(F.count_if(F.col(value).isNull()).alias("n_null"), F.count_if(outside).alias("n_outside"), (F.count("*") == 0).alias("empty"))


def reversed_episodes(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count_if(F.col("t_end") < F.col("t_start")).alias("n_reversed"))


def key_sets(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that are in one of both alone: ``missing`` ones are wanted, ``extra`` ones aren't."""
    both = wanted.select(key).distinct().withColumn("_w", F.lit(True)).join(have.select(key).distinct().withColumn("_h", F.lit(True)), key, "full_outer")
    return both.where("_w is null or _h is null").select(key, F.when(F.col("_w").isNull(), "extra").otherwise("missing").alias("fault"))


def rates(df: DataFrame, keys: list[str], found: str) -> DataFrame:
    """``n``, ``found`` and ``found_rate`` of graded items; an item that is null wasn't found."""
    hit = F.coalesce(F.col(found), F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("found_rate"), F.count_if(hit).alias("found"))


def grounded(said: DataFrame, known: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``said`` with ``grounded``: whether a known value (``v``) of the same keys, rounded to the decimals that were said, equals the number."""
    decimals = sorted({r[0] for r in said.select(F.length(F.split_part(number, F.lit("."), F.lit(2)))).distinct().collect()})
    forms = known.select(*keys, F.explode(F.array(*[F.struct(F.lit(d).alias("_d"), F.round("v", d).alias("_v")) for d in decimals])).alias("_f")).select(*keys, "_f.*").distinct() if decimals else known.select(*keys, F.lit(0).alias("_d"), F.col("v").alias("_v")).limit(0)
    marked = said.withColumns({"_d": F.length(F.split_part(number, F.lit("."), F.lit(2))), "_v": F.col(number).cast("double")})
    return marked.join(forms.withColumn("_there", F.lit(True)), [*keys, "_d", "_v"], "left").withColumn("grounded", F.col("_there").isNotNull()).drop("_d", "_v", "_there")
