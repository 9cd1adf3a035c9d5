"""Queries on the star schema: joins, filters, sets, profiles, top-k, timelines, validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import clean, matching, profile
from .base import query, signal_k, stamp, table

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_extendedprice / nullif(l_quantity - 1, 0), 8) as unit_price, case when l_discount > 0 then round(l_tax / l_discount, 4) end as ratio from lineitem")
def derived_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity") - 1), 8).alias("unit_price"), F.when(F.col("l_discount") > 0, F.round(F.try_divide("l_tax", "l_discount"), 4)).alias("ratio"))


@query("""select p_partkey, concat_ws('; ', case when h <= 0 then 'height missing' when h < 140 or h > 215 then 'height ' || cast(h as integer) || ' cm outside 140-215' end,
 case when w <= 0 then 'weight missing' when w < 20 or w > 400 then 'weight ' || cast(w as integer) || ' kg outside 20-400' end) as dq_reasons,
 case when h between 140 and 215 then round(50 + 2.3 * (h / 2.54 - 60), 4) end as ideal from (select p_partkey, (p_partkey % 250)::double as h, p_size::double * 10 as w from part)""")
def dq_reasons(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 250).cast("double").alias("h"), (F.col("p_size").cast("double") * 10).alias("w"))
    return part.select("p_partkey", clean.anthropometric_reasons(F.col("h"), F.col("w")).alias("dq_reasons"), F.round(clean.ideal_weight(F.col("h"), F.lit("M")), 4).alias("ideal"))


@query("""with j as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, date_diff('day', o_orderdate, l_shipdate) as d from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when d between 0 and 1000 then d end as days from j""")
def absurd_duration(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumn("days", clean.clamp(F.datediff("l_shipdate", "o_orderdate"), 0, 1000).cast("long")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "days")


@query(f"""with r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, {', '.join(c + ' desc' for c in _LINE[2:-1])}) as rn from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as shipped from r where rn = 1""")
def dedup_last(spark, sf_dir):
    order = [F.col("l_shipdate"), *[F.col(c) for c in _LINE[2:-1]]]
    return clean.last_by(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", stamp("l_shipdate").alias("shipped"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem left join (select o_orderkey, min(o_orderdate) as lo from orders where o_orderstatus <> 'P' group by 1) on l_orderkey = o_orderkey
where lo is null or l_shipdate between lo - interval 30 day and lo + interval 330 day""")
def window_filter_interval(spark, sf_dir):
    windows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("lo"), F.expr("o_orderdate + interval 300 days").alias("hi"))
    return clean.in_window(table(spark, sf_dir, "lineitem"), windows, "l_orderkey", "l_shipdate", "lo", "hi", "30 days").select(*_LINE[:4], "l_extendedprice")


@query("""select c_custkey, c_custkey in (select o_custkey from orders) as has_orders from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def semi_anti_presence(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    region = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    kept = customer.join(region, "c_nationkey", "left_semi").join(orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")
    return kept.join(orders.select("c_custkey").distinct().withColumn("there", F.lit(True)), "c_custkey", "left").select("c_custkey", F.col("there").isNotNull().alias("has_orders"))


@query("select d.doc_id, l.doc_id is not null as analyzed, coalesce(quality, -1) as quality from documents d left join labels l using (doc_id)")
def existence_flag(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.col("there").isNotNull().alias("analyzed"), F.coalesce("quality", F.lit(-1)).alias("quality"))


_QS = (1, 5, 25, 50, 75, 95, 99)


@query("select event_type, count(value) as n, " + ", ".join(f"round(quantile_cont(value, {q / 100}), 4) as p{q}" for q in _QS) + " from events group by 1")
def percentiles_exact(spark, sf_dir):
    found = profile.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", _QS)
    return found.select("event_type", "n", *[F.round(f"p{q}", 4).alias(f"p{q}") for q in _QS])


_HIST_SQL = "h as (select event_type, cast(case when value < 0 then -1 when value > 200 then 100 else least(floor(value / 2.0), 99) end as integer) as bin, count(*) as n from events group by 1, 2)"


@query(f"with {_HIST_SQL} select event_type, bin, n from h")
def histogram_fixed(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 0, 200)


@query(f"""with {_HIST_SQL}, c as (select *, sum(n) over (partition by event_type order by bin) as upto, sum(n) over (partition by event_type) as total from h),
f as (select *, row_number() over (partition by event_type order by bin) as rn from c where upto >= total * 0.5)
select event_type, round(case when bin >= 100 then 200 else 2.0 * (bin + (total * 0.5 - (upto - n)) / n) end, 4) as percentile from f where rn = 1""")
def binned_percentile(spark, sf_dir):
    hist = profile.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 0, 200)
    return profile.binned_percentile(hist, ["event_type"], 50, 0, 200).withColumn("percentile", F.round("percentile", 4))


@query("""select o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') as day, case when n < 11 then '<11' else cast(n as varchar) end as shown from (select o_orderstatus, o_orderdate, count(*) as n from orders group by 1, 2)""")
def small_cell_suppression(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderdate").agg(F.count("*").alias("n"))
    return cells.select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), profile.suppressed(F.col("n")).alias("shown"))


@query("""with m as (select regexp_replace(regexp_replace(p_name, '[0-9]+', '#', 'g'), '(?i)(mr|mrs|ms|dr)\\.? +[a-z]+', '[name]', 'g') as label, p_brand from part),
c as (select label, count(*) as n, count(distinct p_brand) as n_cases from m group by 1), r as (select *, row_number() over (order by n desc, label) as rank from c),
k as (select *, n_cases >= 11 and rank <= 100 as shown from r)
select label, n, n_cases, rank from k where shown union all select '(other)', sum(n), null, null from k where not shown having count(*) > 0""")
def event_name_profile(spark, sf_dir):
    return profile.names(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("""select coalesce(event_type, '(all)') as event_type, round(100.0 * avg(case when value >= 70 then 1 else 0 end), 4) as pct_beyond, count(distinct case when value >= 70 then user_id end) as n_cases from events group by grouping sets ((), (event_type))""")
def threshold_shares(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("beyond", F.col("value") >= 70)
    sets = events.groupingSets([[], ["event_type"]], "event_type").agg(F.round(100.0 * F.avg(F.col("beyond").cast("int")), 4).alias("pct_beyond"), F.count_distinct(F.when(F.col("beyond"), F.col("user_id"))).alias("n_cases"))
    return sets.withColumn("event_type", F.coalesce("event_type", F.lit("(all)")))


@query("""with a as (select user_id, event_type, count(*) as before from events where ts < timestamp '2024-01-16' group by 1, 2), b as (select user_id, event_type, count(*) as after from events where ts >= timestamp '2024-01-16' group by 1, 2)
select user_id, event_type, before, after, before is distinct from after as changed from a full join b using (user_id, event_type)""")
def profile_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    half = lambda c: events.where(c).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return profile.changes(half("ts < timestamp_ntz'2024-01-16'"), half("ts >= timestamp_ntz'2024-01-16'"), ["user_id", "event_type"], "n")


@query("""with r as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders), p as (select lo, hi, pow(10, floor(log10((hi - lo) / 8))) as pw from r),
s as (select lo, pw * case when (hi - lo) / 8 / pw <= 1 then 1 when (hi - lo) / 8 / pw <= 2 then 2 when (hi - lo) / 8 / pw <= 2.5 then 2.5 when (hi - lo) / 8 / pw <= 5 then 5 else 10 end as step from p)
select round(floor(o_totalprice / step) * step, 4) as edge, count(*) as n from orders, s group by 1""")
def nice_histogram(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    low, high = orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    step = text.nice_step(F.lit((high - low) / 8))
    return orders.groupBy(F.round(F.floor(F.col("o_totalprice") / step) * step, 4).alias("edge")).agg(F.count("*").alias("n"))


@query("""with t as (select p_brand, count(*) as total from part group by 1), k as (select min(total) as kth from (select total from t order by total desc, p_brand limit 5)),
c as (select count(*) as n_tied from t, k where total >= kth), r as (select *, row_number() over (order by total desc, p_brand) as rank from t)
select p_brand, total, rank, case when n_tied > 8 then n_tied - 5 else 0 end as tied_out from r, c where rank <= case when n_tied <= 8 then n_tied else 5 end""")
def tie_aware_topk(spark, sf_dir):
    totals = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("total"))
    return profile.tie_aware_top(totals, "p_brand", "total")


@query("""select o_orderpriority, count(*) filter (where o_custkey = 1) as id_1, count(*) filter (where o_custkey = 2) as id_2, count(*) filter (where o_custkey = 4) as id_4 from orders where o_custkey in (1, 2, 4) group by 1""")
def case_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(F.col("o_custkey").isin(1, 2, 4))
    return rows.groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_custkey") == i).alias(f"id_{i}") for i in (1, 2, 4)])


@query("""select conv_id, turn, substr(text, 1, 50) as head from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations where role = 'assistant') where rn <= 3""")
def last_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("conv_id", "turn", F.substring("text", 1, 50).alias("head"))


@query("""with u as (select o_custkey as subject, o_orderdate as happened, o_totalprice as amount, 'order' as kind from orders union all select o_custkey, l_shipdate, l_extendedprice, 'line' from lineitem join orders on l_orderkey = o_orderkey)
select subject, kind, count(*) as n, strftime(min(happened), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(happened), '%Y-%m-%d %H:%M:%S') as last_at, min(amount) as low, max(amount) as high from u group by 1, 2""")
def timeline_tracks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject")), "l_orderkey")
    tracks = orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("amount"), F.lit("order").alias("kind")).unionByName(lines.select("subject", F.col("l_shipdate").alias("at"), F.col("l_extendedprice").alias("amount"), F.lit("line").alias("kind")))
    return tracks.groupBy("subject", "kind").agg(F.count("*").alias("n"), stamp(F.min("at")).alias("first_at"), stamp(F.max("at")).alias("last_at"), F.min("amount").alias("low"), F.max("amount").alias("high"))


@query("""select count(*) as n_rows, count(distinct user_id) as n_users, round(median(value), 4) as median_value, max(value) as max_value, count(*) filter (where event_type = 'error') as n_errors from events""")
def kpi_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.round(F.median("value"), 4).alias("median_value"), F.max("value").alias("max_value"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


@query("""with d as (select o_custkey, o_orderpriority, min(o_orderkey) as k from orders group by 1, 2), r as (select *, row_number() over (partition by o_custkey order by k) as rn from d),
n as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, n, string_agg(o_orderpriority, ', ' order by k) as first_units from r join n using (o_custkey) where rn <= 3 group by 1, 2""")
def medication_rollup(spark, sf_dir):
    firsts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"), F.count("*").alias("m"))
    ordered = F.slice(F.sort_array(F.collect_list(F.struct("k", "o_orderpriority"))), 1, 3)
    return firsts.groupBy("o_custkey").agg(F.sum("m").alias("n"), F.array_join(F.transform(ordered, lambda x: x["o_orderpriority"]), ", ").alias("first_units"))


@query("""select n_name, count(*) as n0, count(*) filter (where c_acctbal > 0) as n1, count(*) filter (where c_acctbal > 0 and c_mktsegment = 'BUILDING') as n2, count(*) filter (where c_acctbal > 0 and c_mktsegment = 'BUILDING' and c_custkey % 2 = 0) as n3
from customer join nation on c_nationkey = n_nationkey group by 1""")
def structured_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    steps, seen = [F.lit(True), F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") % 2 == 0], F.lit(True)
    counts = []
    for i, step in enumerate(steps):
        seen = seen & step
        counts.append(F.count_if(seen).alias(f"n{i}"))
    return rows.groupBy("n_name").agg(*counts)


_ASKED = ("Customer#000000001", "Customer#00000001", "0000000", "Customer#9", "customer#000000002")


@query(f"""with q as (select unnest({list(_ASKED)}) as asked), m as (select asked, count(*) filter (where c_name = asked) as exact, count(*) filter (where starts_with(c_name, asked)) as pre, count(*) filter (where contains(c_name, asked)) as inf from q, customer group by 1)
select asked, case when exact > 0 then 'exact' when pre = 1 then 'prefix' when pre > 1 then 'ambiguous' when inf = 1 then 'infix' when inf > 1 then 'ambiguous' else 'unknown' end as outcome from m""")
def pid_resolution(spark, sf_dir):
    counts = []
    for i, asked in enumerate(_ASKED):
        name = F.col("c_name")
        counts += [F.count_if(name == asked).alias(f"e{i}"), F.count_if(name.startswith(asked)).alias(f"p{i}"), F.count_if(name.contains(asked)).alias(f"i{i}")]
    one = table(spark, sf_dir, "customer").agg(*counts)
    cells = [F.struct(F.lit(a).alias("asked"), F.when(F.col(f"e{i}") > 0, "exact").when(F.col(f"p{i}") == 1, "prefix").when(F.col(f"p{i}") > 1, "ambiguous").when(F.col(f"i{i}") == 1, "infix").when(F.col(f"i{i}") > 1, "ambiguous").otherwise("unknown").alias("outcome")) for i, a in enumerate(_ASKED)]
    return one.select(F.inline(F.array(*cells)))


@query("""with s as (select o_orderkey, cast(date_diff('day', timestamp '1995-01-01', o_orderdate) as bigint) as m from orders), d as (select l_orderkey, cast(date_diff('day', timestamp '1995-01-01', l_shipdate) as bigint) as m, l_quantity from lineitem where l_orderkey in (select o_orderkey from s))
select o_orderkey as k, m, 'sample' as kind, null as qty from s union all select l_orderkey, m, case when exists (select 1 from s where s.o_orderkey = d.l_orderkey and s.m = d.m) then 'dose' else 'dose only' end, l_quantity from d""")
def dose_alignment(spark, sf_dir):
    days = lambda c: F.datediff(c, F.lit("1995-01-01").cast("timestamp_ntz")).cast("long")
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), days("o_orderdate").alias("m"))
    doses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), days("l_shipdate").alias("m"), F.col("l_quantity").alias("qty")).join(samples.select("k"), "k", "left_semi")
    matched = doses.join(samples.withColumn("there", F.lit(True)), ["k", "m"], "left")
    rows = matched.select("k", "m", F.when(F.col("there"), "dose").otherwise("dose only").alias("kind"), "qty")
    return samples.select("k", "m", F.lit("sample").alias("kind"), F.lit(None).cast("double").alias("qty")).unionByName(rows)


@query("""select l_orderkey, l_linenumber, case when finish is null or finish = l_shipdate then 'bolus' when finish > l_shipdate then 'infusion' else 'reversed' end as kind, case when finish > l_shipdate then cast(date_diff('day', l_shipdate, finish) as bigint) end as days
from (select l_orderkey, l_linenumber, l_shipdate, case when l_linenumber <> 4 then l_shipdate + to_days(cast(l_quantity as integer) % 7 - 2) end as finish from lineitem)""")
def dose_kinds(spark, sf_dir):
    finish = F.when(F.col("l_linenumber") != 4, F.expr("l_shipdate + make_dt_interval(cast(l_quantity as int) % 7 - 2)"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", finish.alias("finish"))
    lasting = F.when(F.col("finish") > F.col("l_shipdate"), F.datediff("finish", "l_shipdate").cast("long"))
    return lines.select("l_orderkey", "l_linenumber", clean.dose_kind(F.col("l_shipdate"), F.col("finish")).alias("kind"), lasting.alias("days"))


@query("""select doc_id, coalesce(quality, case when n_chars > 2000 then 1 else 0 end) as verdict, quality is not null as from_label from documents left join labels using (doc_id)""")
def overlay_precedence(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") > 2000, 1).otherwise(0)).alias("verdict"), F.col("quality").isNotNull().alias("from_label"))


@query("""with a as (select distinct o_custkey from orders where o_orderstatus = 'F'), b as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT'), c as (select c_custkey as o_custkey from customer where c_acctbal < 0)
select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from (select * from a intersect select * from b)) as n_both, (select count(*) from (select * from a except select * from b)) as n_only_a, (select count(*) from (select * from a intersect select * from b intersect select * from c)) as n_all""")
def cohort_intersections(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("c"))
    df = orders.join(poor, "o_custkey", "left")
    a, b, c = F.col("a"), F.col("b"), F.coalesce("c", F.lit(False))
    return df.agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_only_a"), F.count_if(a & b & c).alias("n_all"))


@query("""select 'orders' as frame, count(*) filter (where o_orderkey is null) as n_null_key, count(*) - count(distinct o_orderkey) as n_repeated_key, count(*) filter (where o_custkey not in (select c_custkey from customer)) as n_orphans, count(*) filter (where o_totalprice < 0) as n_negative,
 count(*) filter (where o_orderstatus not in ('O', 'F', 'P')) as n_outside_domain from orders""")
def validation_report(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    df = orders.join(known, "o_custkey", "left")
    return df.agg(F.count_if(F.col("o_orderkey").isNull()).alias("n_null_key"), (F.count("*") - F.count_distinct("o_orderkey")).alias("n_repeated_key"), F.count_if(F.col("known").isNull()).alias("n_orphans"), F.count_if(F.col("o_totalprice") < 0).alias("n_negative"), F.count_if(~F.col("o_orderstatus").isin("O", "F", "P")).alias("n_outside_domain")).withColumn("frame", F.lit("orders"))


@query("""with e as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by event_id) as p from events) select user_id, count(*) filter (where ts < p) as n_backward, count(*) - count(distinct ts) as n_repeated from e group by 1""")
def monotone_times(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    df = table(spark, sf_dir, "events").withColumn("p", F.lag("ts").over(w))
    return df.groupBy("user_id").agg(F.count_if(F.col("ts") < F.col("p")).alias("n_backward"), (F.count("*") - F.count_distinct("ts")).alias("n_repeated"))


@query("""select regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') as shape, c_mktsegment, count(*) as n, round(avg(case when try_cast(substr(c_name, 10) as double) is not null then 1.0 else 0.0 end), 4) as numeric_share from customer group by 1, 2""")
def value_shape_mask(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    numeric = F.substring("c_name", 10, 100).try_cast("double").isNotNull()
    return customer.groupBy(text.shape(F.col("c_name")).alias("shape"), "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(numeric.cast("double")), 4).alias("numeric_share"))


@query("""select a.c_custkey as asked, c.c_custkey as near from customer a join customer c on c.c_name <> a.c_name and (levenshtein(c.c_name, a.c_name) <= 1 or starts_with(c.c_name, a.c_name) or starts_with(a.c_name, c.c_name))""")
def near_miss_ids(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return matching.near_misses(customer, customer).select(F.col("asked_key").alias("asked"), F.col("key").alias("near"))


@query("""select event_id, cast(floor(cast(json_extract_string(props, '$.k') as integer) / 5) * 5 as bigint) as band, strftime(ts, '%Y') as shown from events""")
def age_band_mask(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.band(signal_k()).alias("band"), F.date_format("ts", "yyyy").alias("shown"))
