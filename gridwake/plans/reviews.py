"""Queries that review a run: verdicts on its frames, spans of gaps, and facts of cases with their gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import briefing, grid, profile, runs, verdicts
from ..session import cut
from .base import heard, query, signal_k, table
from .series import _GRID_SQL, _HOUR, _WHOLE_GRID_SQL

#: Frames with faults: cases that repeat, scores below zero or not whole, rows without a key or time, unknown severities, reversed episodes, orphans.
_FRAMES_SQL = """c as (select c_custkey as pid, case when c_custkey % 50 = 0 then -1.0 when c_custkey % 49 = 0 then 0.5 else 2.0 end as s from customer where c_custkey < 140 union all select c_custkey, 1.0 from customer where c_custkey % 40 = 0 and c_custkey < 140),
s as (select case when event_id % 97 <> 0 then user_id end as pid, case when event_id % 89 <> 0 then date_trunc('minute', ts) end as t, case when event_id % 3 <> 0 then 1 end as t_min, date_trunc('day', ts) as lo, date_trunc('day', ts) + interval 22 hour as hi from events),
f as (select case when event_id % 83 <> 0 then user_id end as pid, case when event_id % 79 <> 0 then event_type end as rule_id, case event_id % 5 when 0 then 'info' when 1 then 'warn' when 2 then 'critical' when 3 then 'other' end as severity from events where value > 50),
e as (select event_id as a, event_id + event_id % 7 - 1 as b from events)"""


def _verdict_sql() -> str:
    line = lambda frame, check, n, bad, allowed, source: f"select '{frame}' as frame, '{check}' as \"check\", cast({n} as bigint) as n, cast({bad} as bigint) as n_bad, cast({allowed} as double) as allowed from {source}"
    outside = "epoch(t) / 60 < epoch(lo) / 60 - 6 or epoch(t) / 60 > epoch(hi) / 60 + 6"
    lines = [line(f, "not empty", "count(*)", "case when count(*) = 0 then 1 else 0 end", 0, t) for f, t in (("cases", "c"), ("series", "s"))]
    for c in verdicts.COUNTS:
        lines += [line("cases", f"{c} not negative", "count(*)", "count(*) filter (where s < 0)", 0, "c"), line("cases", f"{c} whole", "count(*)", "count(*) filter (where s <> round(s))", 0, "c")]
    lines += [
        line("cases", "unique", "count(*)", "count(*) - count(distinct pid)", 0, "c"),
        line("series", "key", "count(*)", "count(*) filter (where pid is null)", 0, "s"),
        line("series", "time", "count(*)", "count(*) filter (where t is null)", 0, "s"),
        line("series", "place in time", "count(*)", "count(*) filter (where t_min is null)", 0.5, "s"),
        line("series", "in window", "count(t)", f"count(*) filter (where {outside})", 0.05, "s"),
        line("series", "unique times", "sum(n)", "sum(n - 1)", 0, "(select pid, t, count(*) as n from s group by 1, 2)"),
        line("flags", "key", "count(*)", "count(*) filter (where pid is null)", 0, "f"),
        line("flags", "rule", "count(*)", "count(*) filter (where rule_id is null)", 0, "f"),
        line("flags", "severity", "count(*)", "count(*) filter (where severity is null or severity = 'other')", 0, "f"),
        line("episodes", "end after start", "count(*)", "count(*) filter (where b < a)", 0, "e"),
        line("flags", "known in cases", "count(*)", "count(*) filter (where pid not in (select pid from c))", 0, "(select distinct pid from f where pid is not null)"),
        line("cases", "known in series", "count(*)", "count(*) filter (where pid not in (select pid from s where pid is not null))", 0, "(select distinct pid from c)"),
    ]
    return f"with {_FRAMES_SQL}, l as ({' union all '.join(lines)}) select *, n_bad <= allowed * n as ok from l"


@query(_verdict_sql())
def run_verdicts(spark, sf_dir):
    """All checks on frames that have faults of each kind."""
    events, customers = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").where("c_custkey < 140").select(F.col("c_custkey").alias("PID"))
    score = F.when(F.col("PID") % 50 == 0, -1.0).when(F.col("PID") % 49 == 0, 0.5).otherwise(2.0)
    rows = customers.withColumn("s", score).unionByName(customers.where("PID % 40 = 0").withColumn("s", F.lit(1.0)))
    unless = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    day = F.date_trunc("day", "ts")
    severity = F.element_at(F.array(*map(F.lit, ["info", "warn", "critical", "other", None])), (F.col("event_id") % 5 + 1).cast("int"))
    frames = {
        "cases": rows.select("PID", *[F.col("s").alias(c) for c in verdicts.COUNTS]),
        "series": events.select(unless(97, F.col("user_id")).alias("PID"), unless(89, F.date_trunc("minute", "ts")).alias("Obs_time"), unless(3, F.lit(1)).alias("t_min"), day.alias("case_start"), (day + F.expr("interval 22 hours")).alias("case_end")),
        "flags": events.where("value > 50").select(unless(83, F.col("user_id")).alias("PID"), F.col("ts").alias("Obs_time"), unless(79, F.col("event_type")).alias("rule_id"), severity.alias("severity")),
        "episodes": events.select(F.col("user_id").alias("PID"), F.col("event_type").alias("rule_id"), F.col("event_id").alias("t_start"), (F.col("event_id") + F.col("event_id") % 7 - 1).alias("t_end")),
    }
    return verdicts.verdicts(frames)


_TWO_GAPS_SQL = f"""two as (select user_id, {_HOUR} as hn, 'value' as signal, value as v from dense union all select user_id, {_HOUR}, 'k', k from dense),
m as (select *, min(case when v is not null then hn end) over w as lo, max(case when v is not null then hn end) over w as hi from two window w as (partition by user_id, signal)),
r as (select *, sum(case when v is null then 0 else 1 end) over (partition by user_id, signal order by hn) as g from m where hn between lo and hi),
gaps as (select user_id, signal, min(hn) as gap_start, max(hn) as gap_end, count(*) as n from r where v is null group by user_id, signal, g)"""


def _gaps(spark, sf_dir, most=None):
    return runs.gap_spans(runs.gaps_of_rows(heard(spark, sf_dir), "user_id", "hn", ["value", "k"], most))


@query(f"""with {_GRID_SQL}, {_TWO_GAPS_SQL} select signal, count(*) as n, sum(gap_end - gap_start + 1.0) as spanned, quantile_cont(gap_end - gap_start + 1.0, 0.5) as p50, round(quantile_cont(gap_end - gap_start + 1.0, 0.9), 4) as p90, max(gap_end + 0.5) as last_end, min(gap_start - 0.5) as first_start, count(distinct user_id) as cases from gaps group by 1""")
def gap_span_profile(spark, sf_dir):
    """Spans of the gaps of each signal, half a step beyond their ends: how much they span, and percentiles of that."""
    spans = cut(_gaps(spark, sf_dir, grid.MOST_STEPS).select("user_id", "signal", "span", "span_start", "span_end"))
    shares = profile.percentiles(spans, ["signal"], "span", (50, 90))
    sums = spans.groupBy("signal").agg(F.sum("span").alias("spanned"), F.max("span_end").alias("last_end"), F.min("span_start").alias("first_start"), F.count_distinct("user_id").alias("cases"))
    return sums.join(shares, "signal").select("signal", "n", "spanned", "p50", F.round("p90", 4).alias("p90"), "last_end", "first_start", "cases")


@query(f"""with {_WHOLE_GRID_SQL}, {_TWO_GAPS_SQL}, g0 as (select user_id, count(value) > 0 as v, count(k) > 0 as k from hourly group by 1), i as (select user_id, string_agg(distinct signal, ', ' order by signal) as inside from gaps group by 1),
q as (select user_id, string_agg(distinct event_type || '_high', ', ' order by event_type || '_high') as raised from events where value >= 150 group by 1)
select user_id, 'Signals: ' || concat_ws(', ', case when k then 'k' end, case when v then 'value' end) || '. ' || case when raised is null then 'No rule raised.' else 'Rules raised: ' || raised || '.' end || case when inside is null then '' else ' Interior gaps: ' || inside || '.' end as facts
from g0 left join q using (user_id) left join i using (user_id)""")
def case_facts_with_gaps(spark, sf_dir):
    """A line for each case: its signals, what was raised, and signals that stop and begin again."""
    signals = table(spark, sf_dir, "events").withColumn("k", signal_k()).groupBy("user_id").agg(*[(F.count(c) > 0).alias(c) for c in ("k", "value")])
    raised = table(spark, sf_dir, "events").where("value >= 150").select("user_id", F.concat("event_type", F.lit("_high")).alias("rule_id"))
    return briefing.facts(signals, ["k", "value"], raised, "user_id", _gaps(spark, sf_dir))
