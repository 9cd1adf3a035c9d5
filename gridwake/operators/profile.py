"""Aggregate profiles: mergeable histograms, percentiles, and cells too small to show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
BINS, SMALL_CELL = 100, 11


def bin_of(value: Column, low: Column | float, high: Column | float, bins: int = BINS) -> Column:
    """Bin from 0 to ``bins`` - 1, the top edge in the last; -1 below and ``bins`` above."""
    value, low, high = value, *(x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    place = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))
    return F.when(value < low, -1).when(value > high, bins).otherwise(place).cast("int")


def histogram(df: DataFrame, keys: list[str], value: str, low: Column | float, high: Column | float, bins: int = BINS) -> DataFrame:
    """Counts by (keys, bin). Adding the counts of two parts gives those of the whole."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys, bin_of(F.col(value), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))


def binned_percentile(hist: DataFrame, keys: list[str], q: float, low: float, high: float, bins: int = BINS) -> DataFrame:
    """A percentile from a histogram, on a line inside its bin; ``low``/``high`` where it lies outside of them.

    The running count goes over the bins of a key, so a window holds ``bins`` + 2 rows.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = hist.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    rows = rows.withColumn("target", F.col("total") * (q / 100)).where("upto >= target")
    width = (high - low) / bins
    first = rows.groupBy(*keys).agg(F.min(F.struct("bin", "n", "upto", "target")).alias("b"))
    inside = low + width * (F.col("b.bin") + (F.col("b.target") - (F.col("b.upto") - F.col("b.n"))) / F.col("b.n"))
    return first.select(*keys, F.when(F.col("b.bin") < 0, float(low)).when(F.col("b.bin") >= bins, float(high)).otherwise(inside).alias("percentile"))


def suppressed(count: Column, least: int = SMALL_CELL) -> Column:
    """A count as text, ``<least`` if it is small but not zero."""
    return F.when((count > 0) & (count < least), F.lit(f"<{least}")).otherwise(count.cast("string"))


def names(df: DataFrame, name: str, case: str, most: int = 100, least: int = SMALL_CELL) -> DataFrame:
    """``label``, ``n``, ``n_cases`` and ``rank`` of the most frequent names, digits and persons masked; the rest is one row ``(other)``.

    A name that fewer than ``least`` cases have is in the rest, whatever its rank. Ranks beyond ``most`` are never
    computed: the top is a sort with limit.
    """
    masked = F.regexp_replace(F.regexp_replace(name, "[0-9]+", "#"), r"(?i)(mr|mrs|ms|dr)\.? +[a-z]+", "[name]")
    counts = df.where(F.col(name).isNotNull()).groupBy(masked.alias("label")).agg(F.count("*").alias("n"), F.count_distinct(case).alias("n_cases"))
    top = counts.orderBy(F.desc("n"), "label").limit(most)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "label")).cast("long")).where(F.col("n_cases") >= least)
    rest = counts.join(ranked.select("label"), "label", "left_anti").agg(F.sum("n").alias("n")).where("n is not null")
    return ranked.unionByName(rest.select(F.lit("(other)").alias("label"), "n", F.lit(None).cast("long").alias("n_cases"), F.lit(None).cast("long").alias("rank")))


#: Relative error of the sketch that brackets percentiles, as one over it, and keys whose sketches are broadcast at most.
SKETCH, SKETCHED_KEYS = 10_000, 100_000


def percentiles(df: DataFrame, keys: list[str], value: str, qs: tuple = PERCENTILES) -> DataFrame:
    """Exact percentiles with linear interpolation, one column each, and ``n``, the values of a key that are not null.

    A sketch gives bounds around each percentile; then values under the bounds are counted, and only the few between
    them are counted one by one and sorted, so a key with much of the rows is no task of its own and no rows are
    shuffled. With very many keys, or if bounds should not hold, all distinct values are counted and sorted by key.
    """
    rows = df.where(F.col(value).isNotNull())
    shares = [q / 100 for q in qs]
    slack = 4.0 / SKETCH
    cuts = F.percentile_approx(value, F.array(*[F.lit(min(max(s + d, 0.0), 1.0)) for s in shares for d in (-slack, slack)]), SKETCH)
    sketch = cut(rows.groupBy(*keys).agg(F.count("*").alias("_total"), cuts.alias("_cuts")))
    if sketch.count() > SKETCHED_KEYS:
        return _percentiles_by_counts(df, keys, value, qs)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    told = F.broadcast(sketch.withColumnsRenamed({k: f"_key_{k}" for k in keys}))  # at most SKETCHED_KEYS rows
    joined = rows.join(told, reduce(lambda x, y: x & y, same, F.lit(True))).select(*keys, F.col(value).alias("_v"), "_total", "_cuts")
    low, high = (lambda i: F.get("_cuts", F.lit(2 * i))), (lambda i: F.get("_cuts", F.lit(2 * i + 1)))
    under = [x.alias(f"_{name}{i}") for i in range(len(qs)) for name, x in (("b", F.count_if(F.col("_v") < low(i))), ("u", F.max(F.when(F.col("_v") < low(i), F.col("_v")))), ("o", F.min(F.when(F.col("_v") > high(i), F.col("_v")))))]
    sums = joined.groupBy(*keys).agg(F.max("_total").alias("n"), *under)
    near = F.array_compact(F.array(*[F.when(F.col("_v").between(low(i), high(i)), F.lit(i)) for i in range(len(qs))]))
    counted = joined.select(*keys, "_v", F.explode(near).alias("_i")).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    lists = counted.withColumn("_upto", upto).groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("_i") == i, F.struct("_upto", "_v")))).alias(f"_l{i}") for i in range(len(qs))])
    both = sums.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    found = cut(lists.join(both, reduce(lambda x, y: x & y, same, F.lit(True))).drop(*[f"_key_{k}" for k in keys]))

    def at(i: int, rank: Column) -> Column:
        """The value at a rank (from 0): between the bounds, or the one beside them."""
        inside = F.get(F.filter(f"_l{i}", lambda s: s["_upto"] + F.col(f"_b{i}") > rank), F.lit(0))["_v"]
        over = F.get(f"_l{i}", F.size(f"_l{i}") - 1)["_upto"] + F.col(f"_b{i}")
        return F.when(rank == F.col(f"_b{i}") - 1, F.col(f"_u{i}")).when(rank < F.col(f"_b{i}"), F.lit(None)).when(rank == over, F.col(f"_o{i}")).otherwise(inside)

    place = lambda s: (F.col("n") - 1) * s
    ends = [x.alias(f"_{side}{i}") for i, s in enumerate(shares) for side, x in (("lo", at(i, F.floor(place(s)))), ("hi", at(i, F.ceil(place(s)))))]
    told = found.select(*keys, "n", *ends)
    lost = F.lit(False)
    for i in range(len(qs)):
        lost |= F.col(f"_lo{i}").isNull() | F.col(f"_hi{i}").isNull()
    if not told.where(lost).isEmpty():
        return _percentiles_by_counts(df, keys, value, qs)
    line = lambda i, s: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place(s) - F.floor(place(s)))
    return told.select(*keys, "n", *[line(i, s).alias(f"p{q}") for i, (q, s) in enumerate(zip(qs, shares, strict=True))])


def _percentiles_by_counts(df: DataFrame, keys: list[str], value: str, qs: tuple) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = counts.withColumn("upto", F.sum("n").over(whole.orderBy(value))).withColumn("total", F.sum("n").over(whole))
    at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col(value)))
    place = lambda q: (F.col("total") - 1) * (q / 100)
    found = rows.groupBy(*keys).agg(F.max("total").alias("total"), *[at(f(place(q))).alias(f"{name}{q}") for q in qs for name, f in (("lo", F.floor), ("hi", F.ceil))])
    shown = [(F.col(f"lo{q}") + (F.col(f"hi{q}") - F.col(f"lo{q}")) * (place(q) - F.floor(place(q)))).alias(f"p{q}") for q in qs]
    return found.select(*keys, F.col("total").alias("n"), *shown)


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two profiles side by side, with whether they differ (a missing row differs from any)."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full_outer").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def tie_aware_top(df: DataFrame, name: str, total: str, k: int = 5, most: int = 8) -> DataFrame:
    """The ``k`` largest totals, with ties of the k-th up to ``most`` rows; else ``k`` and how many tied out.

    ``df`` has one row per name (already aggregated); the top ``most`` + 1 come from a sort with limit.
    """
    kth = df.orderBy(F.desc(total), name).limit(k).agg(F.min(total).alias("kth"))
    tied = df.join(F.broadcast(kth), F.col(total) >= F.col("kth")).agg(F.count("*").alias("n_tied"))
    top = df.orderBy(F.desc(total), name).limit(most).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(total), name)))
    joined = top.join(F.broadcast(tied))
    shown = F.when(F.col("n_tied") <= most, F.col("n_tied")).otherwise(k)
    return joined.where(F.col("rank") <= shown).withColumn("tied_out", F.when(F.col("n_tied") > most, F.col("n_tied") - k).otherwise(F.lit(0)).cast("long")).drop("n_tied")


def merged(parts: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Partial counts of shards added up: equal to the counts of the whole."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def corpus(readings: DataFrame, ranges: dict[str, tuple[float, float]], case: str, least: int = SMALL_CELL) -> DataFrame:
    """Histogram of each signal over its range, as ``shown`` count and ``share`` in percent; bins of few cases are not shown.

    ``readings`` has ``signal`` and ``reading``; signals without a range are left out.
    """
    bounds = F.create_map(*[x for name, (lo, hi) in ranges.items() for x in (F.lit(name), F.array(F.lit(float(lo)), F.lit(float(hi))))])[F.col("signal")]
    rows = readings.where(F.col("reading").isNotNull() & F.col("signal").isin(*ranges)).withColumn("bin", bin_of(F.col("reading"), bounds[0], bounds[1]))
    cells = rows.groupBy("signal", "bin").agg(F.count("*").alias("n"), F.count_distinct(case).alias("cases"))
    enough = F.col("cases") >= least
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("signal")), 4)
    return cells.select("signal", "bin", F.when(enough, F.col("n").cast("string")).otherwise(F.lit(f"<{least}")).alias("shown"), F.when(enough, share).alias("share"))


def phase_counts(df: DataFrame, case: str, phase: str, source: str) -> DataFrame:
    """Minutes of each phase, and cases of each source (one row a case)."""
    minutes = df.groupBy(F.lit("minutes").alias("kind"), F.col(phase).alias("label")).agg(F.count("*").alias("n"))
    sources = df.groupBy(case).agg(F.min(source).alias("label")).groupBy(F.lit("source").alias("kind"), "label").agg(F.count("*").alias("n"))
    return minutes.unionByName(sources)
