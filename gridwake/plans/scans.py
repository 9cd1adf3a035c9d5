"""Queries on scans in shards: partial states that merge, and scans that go on where they ended."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import partials
from ..session import shared_folder
from ..sources.scan import Scan, by_content
from .base import query, signal_k, table

_SIGNALS = {"value": (0.0, 200.0), "k": (0.0, 100.0)}
_BIN_SQL = "cast(case when {0} < 0 then -1 when {0} > {1} then 100 else least(floor({0} / {2}), 99) end as integer)"
_ROWS_SQL = f"""e as (select user_id, event_type, value, cast(json_extract_string(props, '$.k') as double) as k, case when value >= 60 then 'high' when value >= 20 then 'mid' else 'low' end as phase, cast(ts as date) as day from events),
long as (select 'case' as kind, 'all' as name, -2 as slot, user_id from e union all select 'phase', phase, -2, user_id from e union all select 'source', event_type, -2, user_id from e
  union all select 'signal', 'value', {_BIN_SQL.format("value", 200, 2.0)}, user_id from e where value is not null union all select 'signal', 'k', {_BIN_SQL.format("k", 100, 1.0)}, user_id from e where k is not null
  union all select 'rule', 'value_high', -2, user_id from e where value >= 100 union all select 'rule', 'k_low', -2, user_id from e where k < 5)"""


def _events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"k": signal_k(), "shard": F.to_date("ts").cast("string")})
    return events.withColumn("phase", F.when(F.col("value") >= 60, "high").when(F.col("value") >= 20, "mid").otherwise("low"))


def _states(rows):
    rules = F.array_compact(F.array(F.when(F.col("value") >= 100, F.lit("value_high")), F.when(F.col("k") < 5, F.lit("k_low"))))
    return partials.states(rows, "user_id", ["shard"], _SIGNALS, "phase", "event_type", rows.select("shard", "user_id", F.explode(rules).alias("rule_id")))


@query(f"with {_ROWS_SQL} select kind, name, slot, count(*) as n, count(distinct user_id) as cases from long group by 1, 2, 3")
def merged_states(spark, sf_dir):
    """Each day's state, merged: minutes and distinct users of each bin, phase, source and rule are those of the whole."""
    return partials.counts(partials.merged(_states(_events(spark, sf_dir))))


@query(f"""with {_ROWS_SQL}, t as (select kind, name, count(*) as n, count(distinct user_id) as cases from long group by 1, 2), w as (select cases as whole from t where kind = 'case')
select kind, name, case when cases >= 11 then n end as n, cases, case when cases < 11 then '<11' else cast(cases as varchar) end as cases_shown,
  case when cases >= 11 and (whole = cases or whole - cases >= 11) then round(100.0 * cases / whole, 1) end as share from t, w""")
def scan_totals(spark, sf_dir):
    """What a merged scan tells of each thing, with cells too small to show."""
    return partials.with_shares(partials.totals(_states(_events(spark, sf_dir))))


@query(f"""with {_ROWS_SQL}, d as (select count(distinct day) as days, count(distinct day) filter (where day(day) % 2 = 1) as odd from e)
select kind, name, count(*) as n, count(distinct user_id) as cases, any_value(days - odd) as first, any_value(odd) as second, 0 as third from long, d group by 1, 2""")
def resumed_scan(spark, sf_dir):
    """A scan of the even days, then of all days, then once more: how many days each computes, and what the last one holds."""
    scan = Scan(spark, f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}")
    prints = lambda rows: by_content(rows, "shard")
    every = lambda: _events(spark, sf_dir)
    even = lambda: every().where(F.dayofmonth(F.col("shard").cast("date")) % 2 == 0)
    computed = [scan.update(source, prints, _states) for source in (even, every, every)]
    names = dict(zip(("first", "second", "third"), computed, strict=True))
    return partials.totals(scan.results()).withColumns({name: F.lit(n).cast("long") for name, n in names.items()})
