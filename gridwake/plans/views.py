"""Queries behind lists, briefings, profiles, checks and gradings of cases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import briefing, checks, profile, retrieval, runs
from ..session import cut
from .base import HOURLY_SQL, heard, hour_number, hourly, query, table
from .series import _EPISODE_SQL, _GRID_SQL, _HOUR, _SCORE_SQL, _WHOLE_GRID_SQL, _dense, _episodes, _scores, _w


@query("""select p_partkey, p_name from part where contains(lower(p_name), 'red') and contains(lower(p_type), 'economy') order by p_partkey limit 50""")
def contains_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kept = part.where(text.contains_all(F.col("p_name"), ["red"]) & text.contains_all(F.col("p_type"), ["economy"]))
    return kept.select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query(f"""with {_SCORE_SQL} select s.user_id, anomaly_score from scores s join customer on c_custkey = s.user_id where c_mktsegment = 'BUILDING' and anomaly_score >= 5 and contains(lower(top_rules), 'k_low')""")
def dashboard_filters(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = _scores(spark, sf_dir).join(customer, "user_id")
    return briefing.filtered(rows, {"c_mktsegment": "BUILDING"}, {"anomaly_score": 5}, {"top_rules": "K_LOW"}).select("user_id", "anomaly_score")


@query("""with c as (select o_custkey, list(distinct o_orderpriority) as labels from orders group by 1) select c_custkey from customer left join c on o_custkey = c_custkey where contains(lower(c_name), '00007') or coalesce(len(list_filter(labels, lambda x: contains(lower(x), '00007'))), 0) > 0""")
def list_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("labels"))
    return briefing.typed_filter(table(spark, sf_dir, "customer").join(labels, "c_custkey", "left"), "00007", ["c_name"], "labels").select("c_custkey")


@query(f"""with {_GRID_SQL} select user_id, count(*) as n_steps, count(*) filter (where coalesce(value, k) is not null) as n_observed from dense group by 1""")
def observed_steps(spark, sf_dir):
    return _dense(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_steps"), F.count_if(F.coalesce("value", "k").isNotNull()).alias("n_observed"))


@query("""with r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as rn from events), c as (select user_id, min(rn) as pick from r join events using (event_id, user_id) where event_type = 'purchase' group by 1)
select event_id, user_id, cast(rn - pick as bigint) as off from r join c using (user_id) where rn between pick - 10 and pick + 10""")
def rows_around(spark, sf_dir):
    return briefing.around(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", 10).select("event_id", "user_id", "off")


@query("""select o_orderkey, cast(0 as bigint) as incision, case when last > o_orderdate then cast(date_diff('minute', o_orderdate, last) as bigint) end as closure from orders left join (select l_orderkey, max(l_shipdate) as last from lineitem group by 1) on l_orderkey = o_orderkey""")
def span_marks(spark, sf_dir):
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    rows = table(spark, sf_dir, "orders").join(last, "o_orderkey", "left")
    return rows.select("o_orderkey", *briefing.marks(F.col("o_orderdate"), F.col("last")))


@query("""select o_orderkey, '1e' || e || '..1e' || (e + 1) as band, case when x = floor(x) then cast(cast(x as bigint) as varchar) else printf('%.1f', x) end as shown from (select o_orderkey, x, cast(floor(log10(abs(x))) as integer) as e from (select o_orderkey, floor(o_totalprice) / 4 as x from orders where o_totalprice >= 1))""")
def number_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_totalprice >= 1").select("o_orderkey", (F.floor("o_totalprice") / 4).alias("x"))
    return rows.select("o_orderkey", text.magnitude(F.col("x")).alias("band"), text.shown(F.col("x")).alias("shown"))


@query(f"""with {_SCORE_SQL} select user_id, rule_id, count(*) as n from flags where user_id in (select user_id from scores) group by 1, 2""")
def parsed_rule_counts(spark, sf_dir):
    return briefing.rule_counts(_scores(spark, sf_dir), "top_rules").select("user_id", "rule_id", "n")


@query("""select user_id, event_id, row_number() over (order by v nulls first, user_id, event_id) as up, row_number() over (order by v desc nulls last, user_id, event_id) as down from (select user_id, event_id, case when value >= 2 then value end as v from events qualify row_number() over (partition by user_id order by ts, event_id) = 1)""")
def value_ranks(spark, sf_dir):
    one = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "value")).alias("e")).select("user_id", "e.event_id", F.when(F.col("e.value") >= 2, F.col("e.value")).alias("v"))
    return briefing.ranked_both(one, "v", ["user_id", "event_id"]).select("user_id", "event_id", "up", "down")


@query(f"""with {HOURLY_SQL}, x as (select user_id, {_HOUR} as m, cast(round(value * 1000) as bigint) as v from hourly), y as (select user_id, m, count(*) over w as n_near, cast(sum(v) over w as bigint) as total from x window w as (partition by user_id order by m range between 10 preceding and 10 following))
select user_id, m, n_near, (2 * total + n_near) // (2 * n_near) / 1000.0 as mean_near from y""")
def cursor_window(spark, sf_dir):
    """The mean of the hours near each one, by whole thousandths, so that it doesn't depend on the order of adding up."""
    near = Window.partitionBy("user_id").orderBy("m").rangeBetween(-10, 10)
    rows = hourly(spark, sf_dir).select("user_id", hour_number().alias("m"), F.round(F.col("value") * 1000).cast("long").alias("v"))
    told = rows.select("user_id", "m", F.count("*").over(near).alias("n_near"), F.sum("v").over(near).alias("total"))
    return told.select("user_id", "m", "n_near", (F.expr("(2 * total + n_near) div (2 * n_near)") / 1000.0).alias("mean_near"))


@query(f"""with {_EPISODE_SQL}, r as (select *, row_number() over (partition by user_id order by worst desc, t_end - t_start desc, t_start, rule_id) as place from episodes) select user_id, place, rule_id, t_start from r where place <= 20""")
def worst_episodes(spark, sf_dir):
    order = [runs.severity_rank("severity").desc(), F.desc("duration"), "t_start", "rule_id"]
    return briefing.first_of(_episodes(spark, sf_dir), ["user_id"], order, 20).select("user_id", "place", "rule_id", "t_start")


@query(f"""with {_WHOLE_GRID_SQL}, m as (select user_id, {_HOUR} as hn, value is null as miss, min(case when value is not null then h end) over w as lo, max(case when value is not null then h end) over w as hi, h from dense window w as (partition by user_id)),
r as (select *, sum(case when miss then 0 else 1 end) over (partition by user_id order by hn) as g from m where h between lo and hi), gaps as (select user_id, count(*) as n from r where miss group by user_id, g)
select count(*) as n_gaps, quantile_cont(n, 0.5) as p50, round(quantile_cont(n, 0.9), 4) as p90, max(n) as longest, count(distinct case when n >= 10 then user_id end) as n_long_cases from gaps""")
def gap_profile(spark, sf_dir):
    gaps = cut(runs.gaps_of_rows(heard(spark, sf_dir), "user_id", "hn", ["value"]).select("user_id", "gap_length"))
    shares = profile.percentiles(gaps, [], "gap_length", (50, 90))
    whole = gaps.agg(F.max("gap_length").alias("longest"), F.count_distinct(F.when(F.col("gap_length") >= 10, F.col("user_id"))).alias("n_long_cases"))
    return shares.join(F.broadcast(whole)).select(F.col("n").alias("n_gaps"), "p50", F.round("p90", 4).alias("p90"), "longest", "n_long_cases")


@query("""with p as (select event_type, case when value >= 60 then 'high' when value >= 20 then 'mid' else 'low' end as phase, user_id from events), s as (select user_id, min(event_type) as source from events group by 1)
select 'minutes' as kind, phase as label, count(*) as n from p group by 2 union all select 'source', source, count(*) from s group by 2""")
def phase_minutes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    phase = F.when(F.col("value") >= 60, "high").when(F.col("value") >= 20, "mid").otherwise("low")
    source = F.min("event_type").over(Window.partitionBy("user_id"))
    return profile.phase_counts(events.select("user_id", phase.alias("phase"), source.alias("source")), "user_id", "phase", "source")


@query(f"""with {_SCORE_SQL}, g as (select user_id, count(value) > 0 as v, count(k) > 0 as k from hourly group by 1), q as (select user_id, string_agg(distinct rule_id, ', ' order by rule_id) as raised from flags group by 1)
select user_id, 'Signals: ' || concat_ws(', ', case when k then 'k' end, case when v then 'value' end) || '. ' || case when raised is null then 'No rule raised.' else 'Rules raised: ' || raised || '.' end as facts from g left join q using (user_id)""")
def case_facts(spark, sf_dir):
    from .series import _flags

    signals = hourly(spark, sf_dir).groupBy("user_id").agg(*[(F.count(c) > 0).alias(c) for c in ("k", "value")])
    return briefing.facts(signals, ["k", "value"], _flags(spark, sf_dir), "user_id")


@query("""select role, count(*) as n, round(avg(case when contains(lower(text), 'the') then 1.0 else 0.0 end), 6) as found_rate, count(*) filter (where contains(lower(text), 'the')) as found from conversations group by 1""")
def grading_rates(spark, sf_dir):
    graded = table(spark, sf_dir, "conversations").select("role", F.contains(F.lower("text"), F.lit("the")).alias("found"))
    return checks.rates(graded, ["role"], "found")


@query(f"""with {HOURLY_SQL}, s as (select user_id, date_diff('minute', min(h), max(h)) as span from hourly group by 1), r as (select o_custkey, max(case when o_orderstatus = 'P' then o_totalprice end) as recorded from orders group by 1)
select s.user_id, round(coalesce(recorded, span), 2) as duration, recorded is not null as from_record from s left join r on o_custkey = s.user_id""")
def duration_fallback(spark, sf_dir):
    spans = hourly(spark, sf_dir).groupBy("user_id").agg(((F.max(F.unix_seconds(F.col("h").cast("timestamp"))) - F.min(F.unix_seconds(F.col("h").cast("timestamp")))) / 60).alias("span"))
    recorded = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("recorded"))
    return spans.join(recorded, "user_id", "left").select("user_id", F.round(F.coalesce("recorded", "span"), 2).alias("duration"), F.col("recorded").isNotNull().alias("from_record"))


@query("""with d(signal, lo, hi) as (values ('value', 0.0, 200.0), ('k', 0.0, 100.0)), x as (select user_id, 'value' as signal, value as reading from events union all select user_id, 'k', cast(json_extract_string(props, '$.k') as double) from events),
b as (select signal, user_id, cast(case when reading < lo then -1 when reading > hi then 100 else least(floor((reading - lo) / ((hi - lo) / 100)), 99) end as integer) as bin from x join d using (signal) where reading is not null),
c as (select signal, bin, count(*) as n, count(distinct user_id) as cases from b group by 1, 2)
select signal, bin, case when cases < 11 then '<11' else cast(n as varchar) end as shown, case when cases >= 11 then round(100.0 * n / sum(n) over (partition by signal), 4) end as share from c""")
def corpus_profile(spark, sf_dir):
    from .base import signal_k

    events = table(spark, sf_dir, "events").select("user_id", "value", signal_k().alias("k"))
    readings = events.unpivot(["user_id"], ["value", "k"], "signal", "reading")
    return profile.corpus(readings, {"value": (0.0, 200.0), "k": (0.0, 100.0)}, "user_id")


@query("select event_type, cast(case when value < 0 then -1 when value > 200 then 100 else least(floor(value / 2.0), 99) end as integer) as bin, count(*) as n from events group by 1, 2")
def merged_shards(spark, sf_dir):
    from ..sources.raw import sharded

    parts = profile.histogram(sharded(table(spark, sf_dir, "events"), "user_id", 8), ["shard", "event_type"], "value", 0, 200)
    return profile.merged(parts, ["event_type", "bin"], ["n"])


@query(f"""with {_GRID_SQL}, a as (select user_id, min(case when value is null then h end) as gap from dense group by 1), b as (select user_id, h from hourly qualify row_number() over (partition by user_id order by value desc, h) = 1)
select a.user_id, case when gap is null then 'peak' else 'missing' end as kind, strftime(coalesce(gap, b.h), '%Y-%m-%d %H:%M:%S') as at from a join b using (user_id)""")
def key_observation(spark, sf_dir):
    return briefing.key_observation(_dense(spark, sf_dir), "user_id", "h", "value").select("user_id", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""select coalesce(a.user_id, b.c_custkey) as id, case when c_custkey is null then 'extra' else 'missing' end as fault from (select distinct user_id from events) a full join (select c_custkey from customer where c_mktsegment = 'BUILDING') b on user_id = c_custkey where user_id is null or c_custkey is null""")
def key_set_check(spark, sf_dir):
    """Customers of a segment that have no events, and users that are not in it."""
    have = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return checks.key_sets(wanted, have, "id")


@query("""select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from part p where p.p_partkey = l.l_partkey and abs(l.l_extendedprice - l.l_quantity * p.p_retailprice) <= 0.01 * abs(l.l_extendedprice))""")
def dose_mismatch(spark, sf_dir):
    said = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("drug"), (F.col("l_extendedprice")).alias("dose"), "l_quantity")
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug"), F.col("p_retailprice").alias("documented"))
    same = F.abs(F.col("dose") - F.col("l_quantity") * F.col("documented")) <= 0.01 * F.abs(F.col("dose"))
    return said.join(known, "drug", "left").where(~F.coalesce(same, F.lit(False))).select("l_orderkey", "l_linenumber")


@query(f"""with {_EPISODE_SQL}, w as (select user_id, {_HOUR} as hn, value from hourly) select 'series' as frame, count(*) filter (where value is null) as n_null, count(*) filter (where hn < lo - 1 or hn > hi + 1) as n_outside, (select count(*) from episodes where t_end < t_start) as n_reversed, count(*) = 0 as empty
from w left join (select user_id, min({_HOUR}) as lo, max({_HOUR}) as hi from (select user_id, h from hourly where n > 1) group by 1) using (user_id)""")
def frame_checks(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("hn", hour_number())
    bounds = rows.where("n > 1").groupBy("user_id").agg(F.min("hn").alias("lo"), F.max("hn").alias("hi"))
    return checks.frame(rows.join(bounds, "user_id", "left"), "value", "hn", "lo", "hi", 1).join(F.broadcast(checks.reversed_episodes(_episodes(spark, sf_dir)))).select(F.lit("series").alias("frame"), "n_null", "n_outside", "n_reversed", "empty")


@query(f"""with {_SCORE_SQL}, t9 as (select user_id, string_agg(rule_id || ' ' || n, '; ' order by n desc, rule_id) as rules from (select *, row_number() over (partition by user_id order by n desc, rule_id) as p from r) where p <= 5 group by 1)
select h.user_id, count(*) as n_steps, round(median(h.value), 4) as median_value, round(median(h.k), 4) as median_k, coalesce(any_value(anomaly_score), 0) as score, coalesce(any_value(rules), '') as rules from hourly h left join scores s on s.user_id = h.user_id left join t9 on t9.user_id = h.user_id group by 1""")
def case_briefing(spark, sf_dir):
    steps = hourly(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_steps"), F.round(F.median("value"), 4).alias("median_value"), F.round(F.median("k"), 4).alias("median_k"))
    return briefing.management(steps, _scores(spark, sf_dir), "user_id")


@query("""with k as (select vec_id as doc_id from embeddings), r as (select doc_id, row_number() over (order by n_chars desc, doc_id) as pos from documents where contains(lower(text), 'thing')), o as (select r.doc_id, pos, k.doc_id is not null as has from r left join k using (doc_id))
select doc_id, row_number() over (order by has desc, pos) as place from o order by place limit 40""")
def present_first(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("thing"))).select("doc_id", "n_chars")
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has")).distinct()
    order = [F.desc("has"), F.desc("n_chars"), "doc_id"]
    top = hits.join(known, "doc_id", "left").fillna(False, ["has"]).orderBy(*order).limit(40)
    return retrieval.ordered(top, order, "place").select("doc_id", "place")


@query("""with t as (select conv_id, max(case when role = 'assistant' then turn end) as last from conversations group by 1), a as (select conv_id, turn, unnest(regexp_extract_all(text, '[a-z]{12,}')) as x, generate_subscripts(regexp_extract_all(text, '[a-z]{12,}'), 1) as i from conversations),
f as (select conv_id, x, min((turn, i)) as first from (select conv_id, -turn as turn, x, i from a) group by 1, 2) select conv_id, string_agg(x, ' ' order by first) as ids from f group by 1""")
def ordered_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([a-z]{12,})")).alias("found"))
    return briefing.newest_first(rows, "conv_id", "turn", "found").where(F.size("ids") > 0).select("conv_id", F.array_join("ids", " ").alias("ids"))


@query(r"""with q(question) as (values ('what about 12 and the thing')), d as (select doc_id, case when list_contains(regexp_extract_all((select question from q), '[0-9]+'), cast(doc_id as varchar)) then 2.0 end as direct, contains(lower(text), 'thing') as hit from documents)
select doc_id, coalesce(direct, 1.0) as score from d where direct is not null or hit""")
def direct_id_rank(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", F.when(F.contains(F.lower("text"), F.lit("thing")), 1.0).otherwise(0.0).alias("score"))
    return retrieval.with_direct(scored, "doc_id", "what about 12 and the thing")


@query("""with m as (select c_custkey, 'Case ' || c_name || '. Segment: ' || coalesce(c_mktsegment, 'unknown') || '. ' || case when n is null then 'No orders.' else n || ' orders.' end as doc from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey)
select c_custkey, doc, sha256(doc) as doc_hash from m""")
def search_documents(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    doc = F.concat(F.lit("Case "), "c_name", F.lit(". Segment: "), F.coalesce("c_mktsegment", F.lit("unknown")), F.lit(". "), F.when(F.col("n").isNull(), F.lit("No orders.")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" orders."))))
    return rows.select("c_custkey", doc.alias("doc")).withColumn("doc_hash", F.sha2("doc", 256))


@query("""with e as (select user_id, event_id, ts, value, case when event_type = 'purchase' then value end as art from events), p as (select user_id, count(art) > 0 as has from e group by 1)
select user_id, event_id, coalesce(case when has then art else value end, -1) as pressure, case when has then 'arterial' else 'cuff' end as source from e join p using (user_id) where not has or art is not null""")
def pressure_source(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("art", F.when(F.col("event_type") == "purchase", F.col("value")))
    return briefing.preferred_source(events, ["user_id"], "art", "value", ("arterial", "cuff")).select("user_id", "event_id", F.col("reading").alias("pressure"), "source")


@query(r"""with n as (select doc_id, source, lang, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) as x from documents), s as (select distinct source, cast(x as double) as v from n where lang <> 'en'), a as (select distinct doc_id, source, x, cast(x as double) as v, length(split_part(x, '.', 2)) as decimals from n where lang = 'en')
select doc_id, x as number, exists (select 1 from s where s.source = a.source and round(s.v, cast(a.decimals as integer)) = a.v) as grounded from a""")
def grounded_numbers(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(text.integers(F.col("text"))).alias("number"))
    said = found.where("lang = 'en'").select("doc_id", "source", "number").distinct()
    known = found.where("lang <> 'en'").select("source", F.col("number").cast("double").alias("v")).distinct()
    return checks.grounded(said, known, ["source"], "number").select("doc_id", "number", "grounded")


def raw_tables(spark, sf_dir):
    """String tables of cases, ventilator, vitals and point events made of the driver's tables: an hour of events is a minute of a case."""
    from .base import signal_k

    at = F.timestamp_seconds(F.lit(1704067200) + (hour_number("ts") - 473352) * 60)
    stamp = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    events = table(spark, sf_dir, "events").withColumn("k", signal_k()).withColumns({"PID": F.col("user_id").cast("string"), "Obs_time": stamp})
    signals = {"TV": F.col("value") * 2 + 300, "RR": F.col("k") % 20 + 8, "PIP": F.col("value") / 5 + 15, "PEEP": F.col("k") % 16, "ETCO2": F.col("value") / 3 + 25, "FIO2": F.col("k") / 2 + 40, "Agent_Et": F.col("value") / 40, "Agent_Fi": F.col("value") / 35, "ETN2O": F.lit(0.0)}
    ventilator = events.select("PID", "Obs_time", F.element_at(F.array(*[F.lit(x) for x in "SIDN"]), (F.col("k") % 4 + 1).cast("int")).alias("Agent"), *[c.cast("string").alias(n) for n, c in signals.items()])
    vitals = events.select("PID", "Obs_time", (F.col("value") / 2 + 60).cast("string").alias("HRe"), (100 - F.col("k") / 8).cast("string").alias("SPO2"), (F.col("k") / 2 + 50).cast("string").alias("nMAP"))
    name = F.when(F.col("event_type") == "signup", "Intubation").when(F.col("event_type") == "purchase", "Extubation").otherwise(F.col("event_type"))
    points = events.select("PID", F.col("Obs_time").alias("Event_time"), name.alias("Event_name"))
    nation = F.col("c_nationkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("PID"), (nation * 3).cast("string").alias("Age"), (nation + 150).cast("string").alias("Ht"), (nation + 50).cast("string").alias("Wt"), F.when(nation % 2 == 0, "M").otherwise("F").alias("Gender"), F.col("c_mktsegment").alias("Procedure"))
    return people, ventilator, vitals, points


@query(None)
def case_pipeline(spark, sf_dir):
    """Raw tables to scored cases: cleaning, minute grid, phases, features, 22 rules and 3 composites, episodes, scores."""
    from ..cases import scored

    found = scored(*raw_tables(spark, sf_dir))
    return found.select("PID", "n_minutes", "primary_agent", "phase_source", "anomaly_score", "rule_types", "n_info", "n_warn", "n_critical", "composite_episodes", "top_rules", "score_per_hour")
