"""Numbers in answers that their sources don't hold.

Numbers are cut out of texts with their sign, precision, hedge and unit, by string functions alone. A number is
grounded if a source value of its unit rounds to it at its own precision, lies within the tolerance of a hedged one,
or if two values of the sources have it as their difference (where the answer speaks of one) or as their percentage.
All of these are bands around source values. In most scopes values and claims are few: they meet in one task, where a
band is two searches in the scope's sorted values, and no pair is ever a row. Scopes of many go through joins of bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, kept
from .bands import band_join

# Units, number words, hedges and phrases that results depend on.
UNITS = r"cm\s*H[₂2]O|mmHg|mL(?:/kg)?|bpm|minutes?|mins?|seconds?|secs?|hours?|hrs?|vol%|%|/min"
MEASURES = ["cmh2o", "mmhg", "ml", "ml/kg", "bpm", "/min", "vol%"]
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
HEDGES = r"(?:\babout|\baround|\bapproximately|\bapprox\.?|\broughly|\bnearly|\balmost|\bcirca|~|≈)\s*(?:[-−]?\d[\d.,]*\s*(?:to|-|–|and|or)\s*)?$"
DIFFERENCES = r"\b(?:duration|difference|differed|span|lasted|(?:rose|fell|increased|decreased|climbed|dropped|declined|jumped|went (?:up|down)) by)\b"
TOLERANCE, HEDGE_REACH = 0.05, 28
#: A scope with more claims and values than WIDE, or more pairs of them than WIDE_PAIRS, is dealt to many tasks; a task judges scopes of about CHUNK rows and PAIRS pairs at once.
WIDE, WIDE_PAIRS, CHUNK, PAIRS = 100_000, 50_000_000, 100_000, 1_000_000
REMOVED = "[number not in sources]"

_NUMBER = (
    r"(?<![A-Za-z0-9_.])(?:\d{1,3}(?:,\d{3})+(?!\d)|\d+(?:[\u2009\u202f]\d{3})+|\d+)(?:\.\d+)?|(?<![A-Za-z0-9_.])\.\d+"
    rf"|(?i:\b(?:{'|'.join(TENS)})(?:[- ](?:{'|'.join(SMALL[1:10])}))?\b|\b(?:{'|'.join([*SMALL, 'hundred'])})\b)"
)
#: Labels, not values: identifiers of 16 hexadecimal digits, citations, numbers of list items, ordinals.
_LABELS = [r"(?i)\b[0-9a-f]{16}\b", r"\[\s*[A-Za-z]{0,2}\d{1,3}(?:\s*[,;\-–]\s*[A-Za-z]{0,2}\d{1,3})*\s*\]", r"(?m)^[ \t>]*(?:#{1,6}[ \t]+)?(?:[-*•]\s+)?\**\d{1,3}[.)]\**(?=\s)", r"(?i)\b\d+(?:st|nd|rd|th)\b"]
_OPEN, _SHUT = "\u0001", "\u0002"
_KIND = "decimal(18,6)"
_WORDS = {w: i for i, w in enumerate(SMALL)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | {"hundred": 100}


def parts(text: Column) -> Column:
    """A text cut before each of its numbers; labels don't count as numbers. The first part comes before any number."""
    cut = F.translate(F.coalesce(text, F.lit("")), _OPEN + _SHUT, "")
    for label in _LABELS:
        cut = F.regexp_replace(cut, label, "")
    return F.split(F.regexp_replace(cut, _NUMBER, f"{_OPEN}$0{_SHUT}"), _OPEN)


def _value(token: Column) -> Column:
    """The number that a token of digits or words is; over twelve digits before the point it is none."""
    small = F.lower(token)
    known = F.create_map(*[F.lit(x) for pair in _WORDS.items() for x in pair])
    first, second = F.split_part(F.translate(small, "-", " "), F.lit(" "), F.lit(1)), F.split_part(F.translate(small, "-", " "), F.lit(" "), F.lit(2))
    spelt = F.try_element_at(known, first) + F.coalesce(F.try_element_at(known, second), F.lit(0))
    return F.when(token.rlike(r"\d"), F.regexp_replace(token, "[, \u2009\u202f]", "").try_cast(_KIND)).otherwise(spelt.cast(_KIND))


def numbers(df: DataFrame, text_col: str) -> DataFrame:
    """One row for each number of each text: the columns of ``df`` but the text, and what is known of the number.

    ``place`` (from 1), ``token``, ``value``, ``decimals``, ``negative``, ``hedged``, ``unit`` ("" if none) and
    ``differs`` (the text speaks of a difference). A minus is a sign after a space, a bracket, an operator or "to",
    not between two numbers. In "18 to 22 mmHg" both have the unit. Null and numberless texts give no rows.
    """
    held = df.withColumn("_parts", parts(F.col(text_col))).withColumn("differs", F.coalesce(F.col(text_col).rlike(f"(?i){DIFFERENCES}"), F.lit(False))).drop(text_col)
    own = F.expr("slice(_parts, 2, greatest(size(_parts) - 1, 0))").alias("own")
    rows = held.select(*[c for c in held.columns if c != "_parts"], F.posexplode(F.arrays_zip(own, F.col("_parts").alias("last"), F.concat(F.array(F.lit("")), "_parts").alias("prior"), F.expr("slice(_parts, 3, size(_parts))").alias("next"))).alias("_at", "_x")).where("_x.own is not null")
    token, tail = F.split_part("_x.own", F.lit(_SHUT), F.lit(1)), F.split_part("_x.own", F.lit(_SHUT), F.lit(2))
    before = F.right(F.translate(F.concat("_x.prior", "_x.last"), _SHUT, ""), F.lit(HEDGE_REACH + 2))
    rows = _once(rows, place=F.col("_at") + 1, token=token, _tail=tail, _next=F.split_part(F.coalesce("_x.next", F.lit("")), F.lit(_SHUT), F.lit(2)), _before=before).drop("_at", "_x")
    signed = F.col("_before").rlike(r"(^|[^0-9])−$|(\d\s*[–—-]|\bto)\s*[-−]$|^-$|[(\[{=:~,;<>≈±/]-$|(^|[^0-9\s])[ \t]+-$|\n\s*-$") & F.col("token").rlike(r"\d")
    unit_at = rf"(?i)^[ \t]*[\])]*[ \t]*({UNITS})(?![A-Za-z])"
    range_on = F.col("_tail").rlike(r"^\s*(?:to|[–—-])\s*[-−]?$")
    unit = F.coalesce(F.nullif(F.regexp_extract("_tail", unit_at, 1), F.lit("")), F.when(range_on, F.regexp_extract("_next", unit_at, 1)), F.lit(""))
    rows = _once(rows, negative=signed, _value=_value(F.col("token")), _unit=F.translate(F.regexp_replace(F.lower(unit), r"\s", ""), "₂", "2"))
    lead = F.when(F.col("negative"), F.expr("left(_before, length(_before) - 1)")).otherwise(F.col("_before"))
    minute = F.col("_before").rlike(r"(?i)\bminutes?\s*$")
    unit = F.when(minute & (F.col("_unit") == ""), "min").when(F.col("_unit").startswith("min"), "min").when(F.col("_unit").startswith("sec"), "sec").when(F.col("_unit").rlike("^h(ou)?rs?"), "hour").otherwise(F.col("_unit"))
    value = F.when(F.col("negative"), -F.col("_value")).otherwise(F.col("_value"))
    out = rows.where("_value is not null").withColumns({"hedged": F.right(lead, F.lit(HEDGE_REACH)).rlike(f"(?i){HEDGES}"), "unit": unit, "value": value})
    decimals = F.when(F.col("token").contains("."), F.length(F.regexp_extract("token", r"\.(\d+)$", 1))).otherwise(0)
    return out.withColumn("decimals", decimals).drop("_tail", "_next", "_before", "_value", "_unit")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once, however often later ones use them: a generator isn't merged into what follows."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _half(decimals: Column) -> Column:
    """Half of the last place, exactly."""
    return F.element_at(F.array(*[F.lit(f"{5 * 10.0 ** -(i + 1):.7f}").cast("decimal(18,7)") for i in range(7)]), F.least(decimals, F.lit(6)) + 1)


_ABOUT = ["value", "decimals", "negative", "hedged", "unit", "differs"]
_SCALE = 2_000_000  # of values as whole numbers: half of the sixth decimal is one


def grounded(claims: DataFrame, sources: DataFrame, scope: list[str], parts_of: int = 16, wide: int | None = None) -> DataFrame:
    """``claims`` (rows of ``numbers``) with ``grounded``, by the numbers of the sources of the same scope.

    A number with a unit of measurement is compared with values of that unit if the scope has any, else with all.
    Rounding is half away from zero; an unsigned number may state a negative value. Equal claims and equal values
    of a scope are compared once. A scope of over ``wide`` claims and values (WIDE) is no task of its own: where pairs
    of its values are looked for, they are dealt into ``parts_of`` parts. A scope that is null has no sources.
    Claims and values are found in their texts once and kept.
    """
    claims = kept(claims.select(*scope, *_ABOUT, *[c for c in claims.columns if c not in (*scope, *_ABOUT)]))
    values = kept(sources.select(*scope, "value", "unit").where(" and ".join(f"`{c}` is not null" for c in [*scope, "value"])))
    zero = F.lit(0).cast("long")
    counts = claims.groupBy(*scope).agg(F.count("*").alias("_c")).withColumn("_v", zero).unionByName(values.groupBy(*scope).agg(F.count("*").alias("_v")).withColumn("_c", zero))
    sizes = counts.groupBy(*scope).agg(F.sum("_c").alias("_c"), F.sum("_v").alias("_v"))
    over = (F.col("_c") + F.col("_v") > (WIDE if wide is None else wide)) | (F.col("_c").cast("double") * F.col("_v") > WIDE_PAIRS)
    large = cut(sizes.where(over).select(*scope))
    if large.isEmpty():
        return _merged(claims, values, scope)
    same = reduce(lambda x, y: x & y, [claims[c].eqNullSafe(large[c]) for c in scope])
    rest = _merged(claims.join(large, same, "left_anti"), values.join(large, scope, "left_anti"), scope)
    return rest.unionByName(_paired(claims.join(large, same, "left_semi"), values.join(large, scope, "left_semi"), scope, parts_of))


def _merged(claims: DataFrame, values: DataFrame, scope: list[str]) -> DataFrame:
    """``claims`` with ``grounded``: rows of a scope come to one task together and are judged there, some scopes at once."""
    whole = lambda c: (F.col(c) * F.lit(_SCALE).cast("decimal(7,0)")).cast("long")
    rest = [c for c in claims.columns if c not in scope]
    flags = F.col("negative").cast("int") + 2 * F.col("hedged").cast("int") + 4 * F.col("differs").cast("int")
    asked = claims.select(*scope, F.struct(*rest).alias("_claim"), whole("value").alias("_x"), F.col("unit").alias("_unit"), F.least("decimals", F.lit(6)).cast("int").alias("_decimals"), flags.alias("_flags"))
    none = F.lit(None)
    given = values.select(*scope, none.cast(asked.schema["_claim"].dataType).alias("_claim"), whole("value").alias("_x"), F.col("unit").alias("_unit"), none.cast("int").alias("_decimals"), none.cast("int").alias("_flags"))
    rows = asked.unionByName(given).repartition(*scope).sortWithinPartitions(*scope)
    out = rows.select(*scope, "_claim").withColumn("grounded", F.lit(True)).schema
    judge = lambda batches: _judged(batches, scope)
    return rows.mapInArrow(judge, out).select(*scope, *[F.col("_claim")[c].alias(c) for c in rest], "grounded")


def _codes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """A number for each row, equal where the columns are."""
    codes = np.zeros(len(rows), np.int64)
    for c in columns:
        one = rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(codes * (one.max(initial=0) + 1) + one, return_inverse=True)[1]
    return codes


def _judged(batches: Iterator[pa.RecordBatch], scope: list[str]) -> Iterator[pa.RecordBatch]:
    """Verdicts on the claims of rows that come in the order of scopes; a scope is judged when all its rows are there."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            rows = pa.Table.from_batches(held)
            codes = _codes(rows, scope)
            end = int(np.argmax(codes == codes[-1]))
            if end:
                yield from _verdicts(rows.slice(0, end), codes[:end], scope)
            rest = pa.concat_tables([rows.slice(end)]).combine_chunks()
            held, n = rest.to_batches(), len(rest)
            if n >= CHUNK:  # a scope of more rows than a chunk: the next look at it waits for twice as many
                n = 0
    if held:
        rows = pa.Table.from_batches(held)
        yield from _verdicts(rows, _codes(rows, scope), scope)


def _verdicts(rows: pa.Table, codes: np.ndarray, scope: list[str]) -> list[pa.RecordBatch]:
    is_claim = pc.is_valid(rows["_claim"]).to_numpy()
    if not is_claim.any():
        return []
    claims = rows.filter(pa.array(is_claim))
    names = rows["_unit"].combine_chunks().dictionary_encode()
    units, names = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary.to_pylist()
    yes = _held(codes[is_claim], rows["_x"].to_numpy()[is_claim], 10 ** (6 - claims["_decimals"].to_numpy().astype(np.int64)), claims["_flags"].to_numpy().astype(np.int64), units[is_claim], codes[~is_claim], rows["_x"].to_numpy()[~is_claim], units[~is_claim], names)
    return claims.select([*scope, "_claim"]).append_column("grounded", pa.array(yes)).to_batches()


def _held(scope, x, half, flags, unit, v_scope, v, v_unit, names: list[str]) -> np.ndarray:
    """Which claims are grounded, all as whole numbers: exact, without a row for a pair.

    A pool is a scope's values of one unit, or all of them. Each value has its rank among all distinct values, so that
    pools follow each other in one sorted array, in which a band of a pool is a range of places.
    """
    wide = len(names) + 1  # pools of a scope: all values, then by unit
    distinct = np.unique(v)
    ranks = len(distinct) + 1
    rank = np.searchsorted(distinct, v)
    named = np.array([u != "" for u in names], bool)[v_unit]
    at = np.unique(np.concatenate([v_scope * wide * ranks + rank, ((v_scope * wide + v_unit + 1) * ranks + rank)[named]]))

    def any_in(pool, low, high):
        start = np.searchsorted(at, pool * ranks + np.searchsorted(distinct, low, "left"))
        return start < np.searchsorted(at, pool * ranks + np.searchsorted(distinct, high, "right"))

    def size(pool):
        start = np.searchsorted(at, pool * ranks)
        return start, np.searchsorted(at, (pool + 1) * ranks) - start

    kind = lambda *units: np.array([u in units for u in names], bool)[unit]
    everything, own = scope * wide, scope * wide + unit + 1
    pool = np.where(kind(*MEASURES) & (size(own)[1] > 0), own, everything)
    size_x, negative, hedged = np.abs(x), flags & 1 > 0, flags & 2 > 0
    near, far = np.maximum(size_x - half, 1 - size_x - half), size_x + half - 1
    hit = any_in(pool, np.where(x >= 0, near, -far), np.where(x >= 0, far, -near))
    hit |= ~negative & (x > 0) & any_in(pool, 1 - x - half, half - x)
    reach = np.maximum(2 * half, size_x // round(1 / TOLERANCE))
    hit |= hedged & any_in(pool, x - reach, x + reach)

    share = kind("%", "vol%")
    spans = ~kind("") & (((flags & 4) > 0) | kind("min", "sec", "hour"))
    open_ = np.flatnonzero(~hit & (x >= 0) & np.where(share, x <= 100 * _SCALE, spans))
    pool = np.where(share, everything, own)[open_]
    if not len(open_):
        return hit
    asked, back = np.unique(np.stack([share[open_], pool, x[open_], half[open_]]), axis=1, return_inverse=True)
    start, n = size(asked[1])
    found = np.zeros(asked.shape[1], bool)
    cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()) + PAIRS, PAIRS), "right")
    for some in np.split(np.arange(len(n)), np.unique(cuts)):
        claim = np.repeat(some, n[some])
        b = distinct[at[np.arange(len(claim)) + np.repeat(start[some] - np.cumsum(n[some]) + n[some], n[some])] % ranks]
        is_share, pool, x, half = (row[claim] for row in asked)
        for mask, bounds in ((is_share == 0, _gap), (is_share == 1, _share)):
            keep = np.flatnonzero(mask & ((is_share == 0) | (b > 0)))
            low, high = bounds(x[keep], half[keep], b[keep])
            found[claim[keep][(low <= high) & any_in(pool[keep], low, high)]] = True
    hit[open_] |= found[back.reshape(-1)]
    return hit


def _gap(x, half, b):
    """Values below ``b`` whose difference from it rounds to ``x``."""
    return b - x - half + 1, np.minimum(b - x + half, b - 1)


def _share(x, half, b):
    """Values from 0 to ``b`` that are ``x`` percent of it, rounded; products are split, as they go beyond 64 bits."""
    of = 100 * _SCALE
    least = lambda y: y * (b // of) - (-y * (b % of)) // of
    return np.maximum(least(x - half), 0), np.minimum(least(x + half) - 1, b)


def _paired(claims: DataFrame, values: DataFrame, scope: list[str], parts_of: int) -> DataFrame:
    """``claims`` with ``grounded``, by joins of bands that deal the rows of a scope to many tasks."""
    values, about = cut(values.distinct()), _ABOUT
    known = values.where(F.col("unit").isin(MEASURES)).select(*scope, F.col("unit").alias("pool")).distinct()
    pooled = values.select(*scope, "value", F.explode(F.array_distinct(F.array(F.lit(""), "unit"))).alias("pool")).distinct()
    one = claims.select(*scope, *about).distinct().withColumn("pool", F.when(F.col("unit").isin(MEASURES), F.col("unit")).otherwise(F.lit("")))
    one = one.join(known.withColumn("known", F.lit(True)), [*scope, "pool"], "left").withColumn("pool", F.when(F.col("known"), F.col("pool")).otherwise(F.lit(""))).drop("known")
    one = cut(one.withColumnsRenamed({c: f"c_{c}" for c in about}).withColumn("half", _half(F.col("c_decimals"))))
    x, half, least = F.col("c_value"), F.col("half"), F.lit("0.000001").cast(_KIND)
    reach = F.greatest(2 * half, (F.abs(x) * F.lit(str(TOLERANCE)).cast("decimal(3,2)")))
    direct = one.withColumns({"low": x - half, "high": x + half})
    mirror = one.where(~F.col("c_negative") & (x > 0)).withColumns({"low": -x - half, "high": half - x})
    rounds = F.when(F.col("value") >= 0, (F.abs("value") >= F.abs(x) - half) & (F.abs("value") < F.abs(x) + half)).otherwise((F.abs("value") >= F.abs(x) - half) & (F.abs("value") < F.abs(x) + half))
    hedged = one.where("c_hedged").withColumns({"low": x - reach, "high": x + reach})
    keys = [*scope, "pool"]
    found = [
        band_join(direct.unionByName(mirror), pooled, keys, "low", "high", "value").where(rounds),
        band_join(hedged, pooled, keys, "low", "high", "value"),
    ]
    share = F.col("c_unit").isin("%", "vol%")
    spans = (F.col("c_unit") != "") & (F.col("c_differs") | F.col("c_unit").isin("min", "sec", "hour"))
    open_ = one.where((x >= 0) & F.when(share, x <= 100).otherwise(spans)).withColumn("pool", F.when(share, F.lit("")).otherwise(F.col("c_unit")))
    dealt = pooled.withColumnRenamed("value", "b").withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts_of)).cast("int"))
    pairs = open_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of - 1)))).hint("merge").join(dealt, [*keys, "part"]).drop("part")
    b = F.col("b")
    gaps = pairs.where(~share).withColumns({"low": b - x - half, "high": b - x + half})
    shares = pairs.where(share & (b > 0)).withColumns({"low": (x - half).cast("double") * b.cast("double") / 100 - 1e-6, "high": (x + half).cast("double") * b.cast("double") / 100 + 1e-6})
    found.append(band_join(gaps, pooled.where("pool <> ''"), keys, "low", "high", "value").where((F.col("value") < b) & (b - F.col("value") >= x - half) & (b - F.col("value") < x + half)))
    hundred = F.lit(100).cast("decimal(3,0)")
    of = F.col("value") * hundred
    found.append(band_join(shares, pooled.where("pool = ''"), keys, "low", "high", "value").where((F.col("value") >= 0) & (F.col("value") <= b) & (of >= (x - half) * b) & (of < (x + half) * b)))
    hit = reduce(DataFrame.unionByName, [f.select(*scope, *[f"c_{c}" for c in about]) for f in found]).distinct()
    hit = hit.withColumnsRenamed({f"c_{c}": c for c in about}).withColumn("hit", F.lit(True))
    return claims.join(hit, [*scope, *about], "left").withColumn("grounded", F.coalesce("hit", F.lit(False))).drop("hit")


def without(texts: DataFrame, judged: DataFrame, keys: list[str], text_col: str, mark: str = REMOVED) -> DataFrame:
    """``texts`` with ``kept``, the text with a mark in place of each ungrounded number, and ``n_removed``; labels are left out of it."""
    bad = judged.where("not grounded").groupBy(*keys).agg(F.collect_set("place").alias("_bad"))
    rows = texts.join(bad, keys, "left").withColumn("_parts", parts(F.col(text_col)))
    gone = lambda i: F.coalesce(F.array_contains("_bad", i), F.lit(False))
    kept = F.array_join(F.transform("_parts", lambda p, i: F.when(gone(i), F.concat(F.lit(mark), F.split_part(p, F.lit(_SHUT), F.lit(2)))).otherwise(F.translate(p, _SHUT, ""))), "")
    return rows.withColumns({"kept": kept, "n_removed": F.coalesce(F.size("_bad"), F.lit(0))}).withColumn("n_removed", F.greatest("n_removed", F.lit(0))).drop("_bad", "_parts")
