"""Ids that are nearly the same, by join keys instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import near_miss


def without(name: Column, at: Column) -> Column:
    """A name without its character number ``at``, from 1."""
    return F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name)))


def shortened(name: Column, lengths: list[int]) -> Column:
    """What a name begins with and what one deletion leaves of it, where that is as long as ``lengths`` say."""
    upto = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n < F.length(name))
    cut = F.when(F.array_contains(upto, F.length(name) - 1), F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: without(name, i)))
    return F.concat(F.transform(upto, lambda n: F.substring(name, F.lit(1), n)), F.coalesce(cut, F.array().cast("array<string>")))


def near_misses(asked: DataFrame, rows: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """Pairs (``asked_key``, ``key``) of rows whose names differ by one edit, or of which one begins the other; equal names are no miss.

    Two names of one length meet by what is left without their character number ``_at``, so only at that which differs;
    others where the longer one, shortened, is the shorter one (``_at`` is 0, or -1 if the known name is longer). Keys are
    hashes, and the names themselves decide, so each pair of names is found once. Names that many rows have are compared
    once. Null names match nothing; as in SQL, repeated rows give repeated pairs, which are never gathered to be made
    distinct. Each name becomes some twenty rows, which sizes of files don't tell, so no side is sent whole to the
    driver: joins are by sorting.
    """
    asked = asked.where(F.col(name).isNotNull()).select(F.col(key).alias("asked_key"), F.col(name).alias("asked_name"))
    rows = rows.where(F.col(name).isNotNull()).select(key, F.col(name).alias("_name"))
    said, known, at = F.col("asked_name"), F.col("_name"), F.col("_at")
    left, right = asked.select(said).distinct(), rows.select(known).distinct()
    lengths = [[r[0] for r in names.select(F.length(names.columns[0])).distinct().collect()] for names in (left, right)]
    hashed = lambda place, words: F.transform(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.struct(F.lit(place).alias("_at"), h.alias("_key")))
    spots = lambda c: F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.struct(i.alias("_at"), F.xxhash64(without(c, i)).alias("_key"))))
    dealt = lambda c, *ends: F.inline(F.concat(F.coalesce(spots(c), F.array()), *ends))
    left = left.select(said, dealt(said, hashed(0, shortened(said, lengths[1])), hashed(-1, F.array(said))))
    right = right.select(known, dealt(known, hashed(0, F.array(known)), hashed(-1, shortened(known, lengths[0]))))
    longer = F.length(said) - F.length(known)
    met = F.when(at > 0, (said != known) & (without(said, at) == without(known, at))).otherwise(F.when(at == 0, longer > 0).otherwise(longer < 0) & near_miss(said, known))
    names = left.hint("merge").join(right, ["_key", "_at"]).where(met).select(said, known)
    return names.hint("merge").join(asked, "asked_name").hint("merge").join(rows, "_name").select("asked_key", key)
