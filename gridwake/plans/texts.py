"""Queries on what texts say of cases: masking before they leave, and details that belong to another case."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attribution, deidentify, handoff
from .base import query, signal_k, table

_PROCEDURES = {0: ("Total Knee Arthroplasty", "Orthopedic"), 1: ("CABG x3, valve", "Cardiac"), 2: ("Brain biopsy", "Neurosurgery"), 3: ("Unnamed, of Smith", deidentify.OTHER), 4: ("Laparoscopic appendectomy", "General and abdominal")}
_CASE_SQL = lambda place: "case e.user_id % 5 " + " ".join(f"when {k} then '{v[place]}'" for k, v in _PROCEDURES.items()) + " end"


@query(f"""with cut as (select user_id, date_trunc('second', min(ts)) as t0 from events where event_type = 'signup' and user_id % 4 <> 1 group by 1),
e as (select event_id, e.user_id, event_type, date_trunc('second', ts) as t, 18 + (e.user_id * 7) % 80 as age, {_CASE_SQL(1)} as category, (e.user_id + 1) % 6 as other, t0 from events e left join cut on cut.user_id = e.user_id)
select event_id, 'Procedure category: ' || category || '. Age: ' || (age // 5 * 5) || '–' || (age // 5 * 5 + 4) || '. Sex: F.' || chr(10) || '## Procedure events' || chr(10)
  || case when t0 is null then '- time not sent: ' else '- minute ' || case when epoch(t) >= epoch(t0) then '+' else '' end || cast(round((epoch(t) - epoch(t0)) / 60) as bigint) || ' from incision: ' end || event_type || chr(10)
  || case when user_id % 3 = 0 then '[case number not sent]' else 'Case-' || user_id end || ', a ' || (age // 5 * 5) || '–' || (age // 5 * 5 + 4) || '-year-old like ' || case when other % 3 = 0 then '[case number not sent]' else 'Case-' || other end || ', seen on [date not sent] at [time not sent] ([path not sent] kept), 120 mL.' as sent from e""")
def texts_for_sending(spark, sf_dir):
    """A text for each event, with its case's number, age, procedure and times, as it may leave."""
    events = table(spark, sf_dir, "events").withColumns({"t": F.date_trunc("second", "ts"), "age": 18 + (F.col("user_id") * 7) % 80, "other": (F.col("user_id") + 1) % 6})
    number = lambda c: F.left(F.md5(F.col(c).cast("string").cast("binary")), F.lit(16))
    procedure = F.element_at(F.create_map(*[F.lit(x) for k, v in _PROCEDURES.items() for x in (k, v[0])]), (F.col("user_id") % 5).cast("int"))
    text = F.format_string(
        "Procedure: %s. Age: %d. Sex: F.\n## Procedure events\n- %s: %s\n%s, a %d-year-old like %s, seen on %s at %s (/srv/waves/%d/a.xml kept), 120 mL.",
        procedure, "age", F.date_format("t", "yyyy-MM-dd HH:mm:ss"), "event_type", number("user_id"), "age", number("other"), F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "HH:mm"), "user_id",
    )
    users = events.select("user_id").union(events.select("other")).distinct().where("user_id % 3 <> 0")
    aliases = users.select(number("user_id").alias("id"), F.concat(F.lit("Case-"), F.col("user_id").cast("string")).alias("alias"))
    cuts = events.where("event_type = 'signup' and user_id % 4 <> 1").groupBy(F.col("user_id").alias("case")).agg(F.min("t").alias("at"))
    return deidentify.outbound(events.select("event_id", "user_id", text.alias("text")), "event_id", "text", aliases, "user_id", cuts).select("event_id", "sent")


_TOPS_SQL = """top as (select user_id, left(md5(cast(user_id as varchar)), 16) as id, event_type, max(cast(value as decimal(12,2))) as top from events group by 1, 2, 3),
record as (select id, cast(top as varchar) as detail from top union select id, event_type || '_high' from top where top >= 100),
pair as (select a.user_id, a.id as u, b.id as v, max(case when a.event_type = 'click' then a.top end) as click, max(case when a.event_type = 'view' then a.top end) as view, max(case when b.event_type = 'error' then b.top end) as error, max(case when a.event_type = 'signup' then a.top end) as signup
  from top a join top b on b.user_id = a.user_id + 1 group by 1, 2, 3)"""


@query(f"""with {_TOPS_SQL},
said as (select user_id, u as id, null as beside, cast(error as varchar) as detail from pair union all select user_id, u, null, cast(signup as varchar) from pair
  union all select user_id, u, v, cast(click as varchar) from pair union all select user_id, v, u, cast(view as varchar) from pair union all select user_id, v, null, 'view_high' from pair),
open as (select * from said s where not exists (select 1 from record r where r.detail = s.detail and (r.id = s.id or r.id = s.beside)))
select distinct o.user_id, o.id as "case", o.detail, case when beside is null and r.id is not null then r.id end as holder from open o join pair p using (user_id)
  left join record r on r.detail = o.detail and r.id = case when o.id = p.u then p.v else p.u end and beside is null where r.id is not null or o.detail = 'view_high'""")
def misattributed_details(spark, sf_dir):
    """Answers about a user and the next: figures and flags that are given to one and that only the other has."""
    tops = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.col("value").cast("decimal(12,2)")).alias("top"))
    tops = tops.withColumn("id", F.left(F.md5(F.col("user_id").cast("string").cast("binary")), F.lit(16)))
    record = tops.select(F.col("id").alias("case"), F.col("top").cast("string").alias("detail")).union(tops.where("top >= 100").select("id", F.concat("event_type", F.lit("_high"))))
    wide = tops.groupBy("user_id", "id").pivot("event_type", ["click", "error", "signup", "view"]).agg(F.first("top").cast("string"))
    after = wide.select((F.col("user_id") - 1).alias("user_id"), F.col("id").alias("next"), F.col("error").alias("next_error"))
    both = wide.join(after, "user_id")
    text = F.format_string("Case %s reached %s and case %s had %s. Neither has click_high.\n\nOf %s alone:\n- error %s\n- signup %s\nElsewhere 1.00 was seen.\n- list of 2.00\n%s shows view_high, not click_high.", "id", "click", "next", "view", "id", "next_error", "signup", "next")
    listed = both.select("user_id", F.explode(F.array("id", "next")).alias("case"))
    details = attribution.placed(both.select("user_id", text.alias("text")), "user_id", "text", r"(?:\b\d+\.\d{2}\b|\b[a-z]+_high\b)")
    return attribution.misattributed(details, "user_id", listed, record, F.col("detail").endswith("_high"))


_DRUG_NAMES = ["Phenylephrine", "phenylephrine  nasal", "Dobutamine", "EPHEDRINE", "saline", "norepinephrine", "Milrinone"]
_HANDOFFS = ["No hypotension. Desaturation below 90 was seen.", "Hypotension under 65. Phenylephrine given. Dobutamine at minute 9999.", "Hypotension at minute 99999; SpO2 missing", "Stable."]
_DRUG_SQL = "case event_id % 7 " + " ".join(f"when {i} then '{' '.join(d.lower().split())}'" for i, d in enumerate(_DRUG_NAMES)) + " end"


def _run_sql(name: str, value: str, below: float, longer: int) -> str:
    marked = f"select *, {value} < {below} as low, lag(minute) over w as p, lag({value} < {below}) over w as pl from s where {value} is not null window w as (partition by user_id order by minute)"
    return f"{name} as (select user_id, min(minute) as t from (select *, sum(case when p is null or minute - p > 1 or low <> pl then 1 else 0 end) over (partition by user_id order by minute) as run from ({marked})) where low group by user_id, run having count(*) >= 2 and max(minute) - min(minute) > {longer})"


@query(f"""with s0 as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as minute, value, 80 + cast(json_extract_string(props, '$.k') as double) / 5 as sat from events),
s as (select *, case when value between 20 and 200 then value end as art, case when sat between 50 and 100 then sat end as spo2 from s0),
{_run_sql("hypo", "art", 65, 5)}, {_run_sql("desat", "spo2", 90, 0)},
dose as (select user_id, {_DRUG_SQL} as drug from s where event_type = 'purchase'), given as (select user_id, drug, case when drug in ('dobutamine', 'milrinone') then 'inotrope' else 'vasopressor' end as kind from dose where drug not in ('saline', 'phenylephrine nasal')),
u as (select distinct user_id, user_id % 4 as h from events),
g as (
  select user_id, unnest(case h when 0 then ['unsupported', 'missed'] when 1 then ['mentioned'] when 2 then ['unsupported', 'missed'] else ['missed'] end) as status, 'hypotension' as kind from hypo join u using (user_id)
  union all select user_id, unnest(case h when 0 then ['mentioned'] else ['missed'] end), 'desaturation' from desat join u using (user_id)
  union all select user_id, unnest(case when h = 1 and drug = 'phenylephrine' then ['mentioned'] when h = 1 and drug = 'dobutamine' then ['unsupported', 'missed'] else ['missed'] end), kind from given join u using (user_id)
  union all select user_id, 'unsupported', 'hypotension' from u where h in (1, 2) and user_id not in (select user_id from hypo)
  union all select user_id, 'unsupported', 'desaturation' from u where h = 0 and user_id not in (select user_id from desat)
  union all select user_id, 'unsupported', 'medication' from u, (values ('phenylephrine'), ('dobutamine')) d(drug) where h = 1 and not exists (select 1 from given where given.user_id = u.user_id and given.drug = d.drug)
  union all select user_id, 'missed', 'missing_map' from u where not exists (select 1 from s where s.user_id = u.user_id and art is not null))
select user_id, status, kind, count(*) as n from g group by 1, 2, 3""")
def handoff_grades(spark, sf_dir):
    """Handoffs of four kinds, graded against timelines of low readings and doses."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    events = table(spark, sf_dir, "events").withColumns({"minute": F.row_number().over(order).cast("long"), "k": signal_k()})
    samples = events.select(F.col("user_id").alias("case"), "minute", F.col("value").alias("map_art"), F.lit(None).cast("double").alias("nmap"), (80 + F.col("k") / 5).alias("spo2"))
    drug = F.get(F.array(*map(F.lit, _DRUG_NAMES)), (F.col("event_id") % 7).cast("int"))
    doses = events.where("event_type = 'purchase'").select(F.col("user_id").alias("case"), drug.alias("drug"), "minute", (F.col("minute") + F.col("event_id") % 3).alias("end_minute"))
    said = handoff.claims(events.select(F.col("user_id").alias("case")).distinct().select("case", F.get(F.array(*map(F.lit, _HANDOFFS)), (F.col("case") % 4).cast("int")).alias("text")))
    graded = handoff.grades(handoff.timeline(samples, doses), said)
    return graded.groupBy(F.col("case").alias("user_id"), "status", "kind").agg(F.count("*").alias("n"))
