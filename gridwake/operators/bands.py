"""Joining numbers to the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Binary exponents of widths that share a size of bucket.
STEP = 3


def band_join(bands: DataFrame, values: DataFrame, keys: list[str], low: str, high: str, value: str) -> DataFrame:
    """Rows of ``bands`` with those of ``values`` that share the keys and whose value lies from ``low`` to ``high``, ends included.

    A band of some width is put into the one or two buckets of the next power of eight that it meets, a value into one
    bucket for each such power that any band has (a few, by binary exponents and not by rows). So bands of all widths
    are joined by equal buckets, each pair is found once, and work follows the values near a band. Null or reversed
    bands and null values find nothing. Both sides grow by their buckets, which sizes of files don't tell, so neither
    is sent whole to the driver: the join is by sorting.
    """
    some = bands.where(F.col(low) <= F.col(high)).withColumn("_level", (F.ceil(F.log2(F.greatest(F.col(high).cast("double") - F.col(low).cast("double"), F.lit(1e-9))) / STEP) * STEP).cast("int"))
    levels = sorted(r[0] for r in some.select("_level").distinct().collect())  # binary exponents of doubles: 700 at most
    if not levels:
        levels = [0]
    place = lambda c: F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("_level")))
    dealt = some.withColumn("_bucket", F.explode(F.sequence(place(low), place(high))))
    there = values.where(F.col(value).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bucket", place(value))
    joined = dealt.hint("merge").join(there, [*keys, "_level", "_bucket"])
    return joined.where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("_level", "_bucket")
