"""Queries on packets of samples: one time axis from many files, and the state of channels from counts of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import waveform
from .base import query, table

#: Seconds from sample to sample, and without samples before a session ends.
_STEP, _GAP = 43_200, 129_600
_PACKET_SQL = "p as (select user_id, event_type, event_id % 2 as file, epoch(date_trunc('day', ts)) as start, list(value order by event_id) as v from events group by 1, 2, 3, 4)"


def _packets(spark, sf_dir):
    """A day's values of a user and type, from two files each, as packets of two samples a day: three or more reach into the next."""
    events = table(spark, sf_dir, "events").withColumns({"file": F.col("event_id") % 2, "start": F.date_trunc("day", "ts")})
    packets = events.groupBy("user_id", "event_type", "file", "start").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    return packets.select("user_id", "event_type", "file", "start", F.lit(1 / _STEP).alias("hz"), F.col("v.value").alias("values"))


@query(f"""with {_PACKET_SQL},
m as (select *, max(start + len(v) * {_STEP}) over (partition by user_id, event_type order by start, file rows between unbounded preceding and 1 preceding) as reached from p),
t as (select *, least(len(v), cast(ceil(greatest(coalesce(reached, start) - start, 0) / {_STEP}) as bigint)) as lost, sum(case when reached is null or start - reached > {_GAP} then 1 else 0 end) over (partition by user_id, event_type order by start, file rows between unbounded preceding and current row) as session from m),
k as (select *, start + lost * {_STEP} as t0, v[lost + 1:] as rest from t where lost < len(v))
select user_id, event_type, cast(session as bigint) as session, cast(min(t0) as bigint) as "begin", cast(max(t0 + len(rest) * {_STEP}) as bigint) as ends, sum(len(rest)) as samples, sum(lost) as lost, max(list_max(rest)) as top from k group by 1, 2, 3""")
def wave_sessions(spark, sf_dir):
    """Sessions of each channel after its packets are put on one axis and cut where they overlap."""
    keys = ["user_id", "event_type"]
    rows = waveform.assembled(_packets(spark, sf_dir), keys, ["start", "file"], _GAP)
    tops = rows.groupBy(*keys, "session").agg(F.max(F.array_max("values")).alias("top"))
    told = waveform.sessions(rows, keys).join(tops, [*keys, "session"])
    return told.select(*keys, "session", F.unix_seconds("begin").alias("begin"), F.unix_seconds("end").alias("ends"), "samples", "lost", "top")


@query("""with s as (select user_id, event_type, case when event_id % 11 > 0 then value end as v from events),
q as (select user_id, event_type, count(v) as n, count(*) as whole, min(v) as low, quantile_cont(v, 0.05) as a, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.95) as b, max(v) as high, count(*) filter (where v between -20 and 300) as inside from s group by 1, 2)
select user_id, event_type, n, whole, low, round(median, 6) as median, high, case when n = 0 then 'nodata' when b - a < 10 then 'idle' when event_type in ('view', 'click') and (inside < 0.95 * n or median not between 20 and 150) then 'implausible' else 'active' end as state from q""")
def channel_summary(spark, sf_dir):
    """The state of each user's channels, from counts of values that packets were summed up to; every eleventh sample is no data."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.array(F.when(F.col("event_id") % 11 > 0, F.col("value")).otherwise(F.lit(float("nan")))).alias("values"))
    keys = ["user_id", "event_type"]
    found = waveform.states_of(waveform.value_counts(events, keys), keys, ["view", "click"], "event_type")
    return found.withColumn("median", F.round("median", 6))
