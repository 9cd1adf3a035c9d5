"""Timelines of cases, what a handoff text says of them, and a grade for each thing that it has to say.

A text becomes a table of places: findings, minutes, thresholds and numbers in the order of each sentence. A detail is of
the finding that is named last before it in its sentence, else of the sentence's first. Claims of a case and a finding
meet the episodes and doses of its timeline by a join, and are held against their minutes and values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import clean, runs
from .briefing import preferred_source

# Drugs and the one that is none of them, limits of pressures and saturations, gaps that end a run, words of findings.
DRUGS = {"vasopressor": ["phenylephrine", "ephedrine", "vasopressin", "epinephrine", "norepinephrine"], "inotrope": ["dopamine", "dobutamine", "milrinone", "isoproterenol"]}
EXCLUDED = "phenylephrine nasal"
MAP_LOW, MAP_RANGE, SPAN, ART_GAP, CUFF_GAP = 65.0, (20.0, 200.0), 5, 1, 6
SPO2_LOW, SPO2_RANGE, SPO2_GAP = 90.0, (50.0, 100.0), 1
SENTENCE_END = r"[?!;\n]|\.(?!\d)"
NEGATION, REACH = r"\b(?:no|not|without|denies|denied|never)\b", 40
WORDS = {
    "hypotension": r"hypotensi\w*|low map|low blood pressure|blood pressure|mean arterial pressure|map|bp",
    "desaturation": r"desat\w*|low oxygen|oxygen saturation|saturation|o2 sats?|sats?|spo2|sp02",
}
CONCEPTS = {"hypotension": r"hypotension|low map|low blood pressure", "desaturation": r"desatur\w*|low oxygen"}
GAP_WORDS = r"\b(?:missing|unavailable|absent|unrecorded|not recorded|not measured|no reading|none recorded|not available)\b"
_LOW = {"hypotension": MAP_LOW, "desaturation": SPO2_LOW}
_GAPS = {"hypotension": "missing_map", "desaturation": "missing_spo2"}

_ALL_DRUGS = [d for names in DRUGS.values() for d in names]
_NAMES = "|".join([*WORDS.values(), *_ALL_DRUGS, *DRUGS])
_NUMBER = r"\d+(?:\.\d+)?"
_MINUTES = rf"\bminutes\s*[:#]?\s*{_NUMBER}(?:\s*,\s*{_NUMBER})+|\b(?:minutes|minute|mins|min)\s*[:#]?\s*{_NUMBER}(?:\s*(?:to|through|thru|and|-|–)\s*{_NUMBER})?"
_UNDER = rf"(?:under|below|<)\s*{_NUMBER}(?!\d)"
_TOKENS = rf"(?:{NEGATION}.{{0,{REACH}}}?)?(?<![a-z0-9])(?:{_NAMES})(?![a-z0-9])|{_MINUTES}|{_UNDER}|(?<![\d.]){_NUMBER}(?!\d)"


def drug_class(name: Column) -> Column:
    """``vasopressor`` or ``inotrope`` for a drug's whole name, whatever its case and spaces; null for any other."""
    folded = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.when(folded.isin(DRUGS["vasopressor"]), "vasopressor").when(folded.isin(DRUGS["inotrope"]), "inotrope")


def timeline(samples: DataFrame, doses: DataFrame) -> DataFrame:
    """``case``, ``kind``, ``finding``, ``t_start``, ``t_end`` and ``readings`` (an array) of all that a handoff has to tell.

    ``samples`` has ``case``, ``minute``, ``map_art``, ``nmap`` and ``spo2``, ``doses`` ``case``, ``drug``, ``minute`` and
    ``end_minute``. Arterial readings go before those of a cuff where a case has any that can be. Low pressures last over
    SPAN minutes; two low saturations in a row are enough. A case of ``samples`` without any reading that can be has a gap.
    """
    can = lambda c, bounds: F.when(F.col(c).between(*bounds), F.col(c))
    rows = samples.select("case", "minute", can("map_art", MAP_RANGE).alias("art"), can("nmap", MAP_RANGE).alias("cuff"), can("spo2", SPO2_RANGE).alias("spo2"))
    pressure = preferred_source(rows, ["case"], "art", "cuff", ("art", "cuff")).where("reading is not null")
    found = []
    for finding, df, gap, span in (("hypotension", pressure.where("source = 'art'"), ART_GAP, SPAN), ("hypotension", pressure.where("source = 'cuff'"), CUFF_GAP, SPAN), ("desaturation", rows.select("case", "minute", F.col("spo2").alias("reading")).where("reading is not null"), SPO2_GAP, 0)):
        spans = runs.low_runs(df.select("case", "minute", "reading"), ["case"], "minute", "reading", _LOW[finding], gap, 2, span).select("case", "t_start", "t_end")
        inside = runs.covering(spans, df.select("case", "minute", "reading"), ["case"], "minute", width=60)
        found.append(inside.groupBy("case", "t_start", "t_end").agg(F.collect_list("reading").alias("readings")).select("case", F.lit(finding).alias("kind"), F.lit(finding).alias("finding"), "t_start", "t_end", "readings"))
    none = F.lit(None).cast("long")
    empty = F.array().cast("array<double>")
    for finding, columns in (("hypotension", ("art", "cuff")), ("desaturation", ("spo2",))):
        lacks = rows.groupBy("case").agg(F.count(F.coalesce(*columns)).alias("n")).where("n = 0")
        found.append(lacks.select("case", F.lit(_GAPS[finding]).alias("kind"), F.lit(finding).alias("finding"), none.alias("t_start"), none.alias("t_end"), empty.alias("readings")))
    name = F.lower(F.trim(F.regexp_replace("drug", r"\s+", " ")))
    end = F.when(clean.dose_kind(F.col("minute"), F.col("end_minute")) == "infusion", F.col("end_minute")).otherwise(F.col("minute"))
    given = doses.withColumn("kind", drug_class(F.col("drug"))).where("kind is not null")
    found.append(given.select("case", "kind", name.alias("finding"), F.col("minute").cast("long").alias("t_start"), end.cast("long").alias("t_end"), empty.alias("readings")))
    typed = [f.select("case", "kind", "finding", F.col("t_start").cast("long").alias("t_start"), F.col("t_end").cast("long").alias("t_end"), "readings") for f in found]
    return reduce(DataFrame.unionByName, typed)


def claims(handoffs: DataFrame) -> DataFrame:
    """What each text (``case``, ``text``) says of each finding: ``named``, ``denied``, ``minutes``, ``values``, ``under``, ``lacking``.

    A value is the last number of a stretch from one finding to the next; thresholds (under, below) are apart from
    values. ``lacking`` is set where a sentence names the series and that it is missing. A null text says nothing.
    """
    text = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[ \t\r\f\v]+", " "), EXCLUDED, " ")
    sentences = handoffs.select("case", F.posexplode(F.split(text, SENTENCE_END)).alias("sentence", "_s"))
    tokens = sentences.select("case", "sentence", F.col("_s").rlike(GAP_WORDS).alias("_gap"), F.posexplode(F.regexp_extract_all("_s", F.lit(_TOKENS), F.lit(0))).alias("place", "_t"))
    minute, under = F.col("_t").rlike(rf"^(?:{_MINUTES})$"), F.col("_t").rlike(rf"^(?:{_UNDER})$")
    number = F.col("_t").rlike(rf"^{_NUMBER}$")
    name = F.when(~(minute | under | number), F.regexp_extract("_t", rf"(?<![a-z0-9])({_NAMES})$", 1))
    finding = reduce(lambda c, f: c.when(name.rlike(f"^(?:{WORDS[f]})$"), f), WORDS, F.when(name.isNull(), None)).otherwise(name)
    rows = tokens.select("*", F.inline(F.array(F.struct(minute.alias("_m"), under.alias("_u"), number.alias("_n"), name.alias("_name"), finding.alias("_f")))))
    within = Window.partitionBy("case", "sentence")
    upto = within.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stretch = F.count("_f").over(upto)
    owner = F.coalesce(F.last("_f", ignorenulls=True).over(upto), F.min(F.when(F.col("_f").isNotNull(), F.struct("place", "_f"))).over(within)["_f"])
    rows = rows.withColumns({"finding": owner, "_stretch": stretch}).where("finding is not null")
    concept = reduce(lambda c, f: c.when(F.col("_f") == f, F.col("_name").rlike(f"^(?:{CONCEPTS[f]})$")), CONCEPTS, F.when(F.col("_f").isNull(), False)).otherwise(True)
    deny = F.col("_t").rlike(f"^{NEGATION}")
    last = F.max_by(F.regexp_extract("_t", _NUMBER, 0), F.when(F.col("_n"), F.col("place")))
    per = rows.groupBy("case", "finding", "sentence", "_stretch").agg(
        F.bool_or(concept & ~deny).alias("named"),
        F.bool_or(concept & deny).alias("denied"),
        F.flatten(F.collect_list(F.when(F.col("_m"), F.regexp_extract_all("_t", F.lit(_NUMBER), F.lit(0))))).alias("minutes"),
        last.alias("value"),
        F.collect_list(F.when(F.col("_u"), F.regexp_extract("_t", _NUMBER, 0))).alias("under"),
        F.bool_or(F.col("_f").isNotNull() & ~concept & (F.col("_gap") | F.col("_t").rlike(r"^no\s"))).alias("lacking"),
    )
    numbers = lambda c, kind: F.transform(F.flatten(F.collect_list(c)), lambda x: x.cast("double").cast(kind))
    return per.groupBy("case", "finding").agg(
        F.bool_or("named").alias("named"), F.bool_or("denied").alias("denied"), numbers("minutes", "long").alias("minutes"), F.transform(F.collect_list("value"), lambda x: x.cast("double")).alias("values"), numbers("under", "double").alias("under"), F.bool_or("lacking").alias("lacking")
    )


def grades(events: DataFrame, said: DataFrame) -> DataFrame:
    """``case``, ``status`` (mentioned, missed or unsupported), ``kind``, ``finding`` and ``t_start`` for all that a handoff told, or should have.

    An episode is mentioned if it is named and not denied, with a minute inside it, a value of it, or its threshold, and
    nothing that no episode of its kind has; a denial or such a detail is unsupported, and the episode missed. A dose is
    mentioned if it is named, and no minute lies outside of all doses of its drug. A gap is mentioned if it is told, and
    unsupported where a value is. What is named, but isn't on the timeline, is unsupported.
    """
    over = Window.partitionBy("case", "finding")
    rows = events.withColumns({"_spans": F.collect_list(F.struct("t_start", "t_end")).over(over), "_known": F.flatten(F.collect_list("readings").over(over))}).join(said, ["case", "finding"], "left")
    array = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({"minutes": array("minutes", "long"), "values": array("values", "double"), "under": array("under", "double"), "named": yes("named"), "denied": yes("denied"), "lacking": yes("lacking")})
    low = F.when(F.col("finding") == "hypotension", MAP_LOW).when(F.col("finding") == "desaturation", SPO2_LOW)
    same = lambda list_, x: F.exists(list_, lambda y: F.abs(y - x) < 0.01)
    inside = F.exists("minutes", lambda m: m.between(F.col("t_start"), F.col("t_end")))
    outside = F.exists("minutes", lambda m: ~F.exists("_spans", lambda s: m.between(s["t_start"], s["t_end"])))
    threshold = same("under", low) | same("values", low)
    matches = F.exists("values", lambda v: same("readings", v))
    odd = F.exists("values", lambda v: ~same("_known", v) & ~(F.abs(v - low) < 0.01))
    low_value = F.exists("values", lambda v: (v < SPO2_LOW) & same("readings", v))
    told = F.when(F.col("finding") == "desaturation", F.col("named") | same("under", low) | low_value).otherwise(F.col("named") | same("under", low))
    episode, dose = F.col("kind").isin(*_LOW), F.col("kind").isin(*DRUGS)
    good = F.when(episode, told & ~F.col("denied") & ((inside & ~outside) | threshold | matches) & ~outside & ~odd).when(dose, F.col("named") & ~outside).otherwise(F.col("lacking") & (F.size("values") == 0))
    wrong = F.when(episode, F.col("denied") | outside | odd).when(dose, (F.col("denied") & ~F.col("named")) | outside).otherwise(F.size("values") > 0)
    gap = ~episode & ~dose
    status = F.when(good, F.array(F.lit("mentioned"))).when(wrong & gap, F.array(F.lit("unsupported"))).when(wrong, F.array(F.lit("unsupported"), F.lit("missed"))).otherwise(F.array(F.lit("missed")))
    on = rows.select("case", F.explode(status).alias("status"), "kind", "finding", "t_start")
    there = events.select("case", "finding").where(~F.col("kind").isin(*_GAPS.values())).unionByName(events.select("case", F.col("kind").alias("finding"))).distinct()
    extra = said.where(F.col("named") | ((F.col("finding") == "desaturation") & F.exists("values", lambda v: v < SPO2_LOW) & ~F.col("lacking"))).join(there, ["case", "finding"], "left_anti")
    kind = F.when(F.col("finding").isin(*_ALL_DRUGS), "medication").otherwise(F.col("finding"))
    return on.unionByName(extra.select("case", F.lit("unsupported").alias("status"), kind.alias("kind"), "finding", F.lit(None).cast("long").alias("t_start")))


def counts(graded: DataFrame) -> DataFrame:
    """``case``, ``mentioned``, ``missed`` and ``unsupported``."""
    return graded.groupBy("case").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("mentioned", "missed", "unsupported")])
