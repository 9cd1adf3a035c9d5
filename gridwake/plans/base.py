"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def keep(f):
        REGISTRY[f.__name__] = Query(f, sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal_k():
    """The second signal of an event, from its JSON properties."""
    return F.get_json_object("props", "$.k").try_cast("double")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


#: SQL of the hourly series that most event queries start from.
HOURLY_SQL = """hourly as (
  select user_id, date_trunc('hour', ts) as h, quantile_cont(value, 0.5) as value,
         quantile_cont(cast(json_extract_string(props, '$.k') as double), 0.5) as k, count(*) as n
  from events group by 1, 2)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and hour: medians of both signals, and the number of events."""
    events = table(spark, sf_dir, "events").withColumn("k", signal_k())
    return events.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.expr("percentile(value, 0.5)").alias("value"), F.expr("percentile(k, 0.5)").alias("k"), F.count("*").alias("n"))


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and hour, with its number ``hn``: a value of each signal, null where ``hourly`` has none."""
    events = table(spark, sf_dir, "events").withColumns({"k": signal_k(), "h": F.date_trunc("hour", "ts")})
    return events.groupBy("user_id", hour_number().alias("hn")).agg(F.max("value").alias("value"), F.max("k").alias("k"))


def hour_number(c="h"):
    return F.expr(f"cast(unix_seconds(cast({c} as timestamp)) / 3600 as long)")
