"""Scalar functions on strings and vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search ignores.
STOPWORDS = tuple(
    "a an and any are be by can case cases did do does find for from give has have how i in is it list many me of on or "
    "patient patients show tell that the there these this those to was were what when where which who why will with".split()
)


def question_terms(question: str) -> list[str]:
    """Distinct search tokens of a question, by the rules of ``tokens``, for use as literals."""
    words = re.findall(r"[^\W_]+", question.replace("₂", "2").lower())
    return sorted({w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in words if w not in STOPWORDS})


def phrases(query: str) -> list[str]:
    """Terms of a query, lower case; a quoted phrase is one term."""
    return [(a or b).lower() for a, b in re.findall(r'"([^"]+)"|(\S+)', query) if (a or b).strip()]


def contains_all(text: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out &= F.contains(F.lower(text), F.lit(t))
    return out


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out |= F.contains(F.lower(text), F.lit(t))
    return out


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Search tokens: lower-case runs of letters and digits, without stopwords, singular by a trailing s."""
    words = F.regexp_extract_all(F.lower(F.replace(text, F.lit("₂"), F.lit("2"))), F.lit(r"([\p{L}\p{N}]+)"))
    kept = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w))


def folded(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("₂"), F.lit("2")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if they are empty, of unlike length, or of no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def shape(text: Column) -> Column:
    """Digits as 9 and letters as A."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "A")


def band(age: Column, width: int = 5) -> Column:
    """The floor of the age band."""
    return (F.floor(age / width) * width).cast("long")


def near_miss(a: Column, b: Column) -> Column:
    """Whether one id begins the other, or one edit turns it into the other; equal ids are no miss."""
    return (a != b) & (a.startswith(b) | b.startswith(a) | (F.levenshtein(a, b) <= 1))


def integers(text: Column) -> Column:
    """Plain numbers of a text in order."""
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"))


def nice_step(width: Column) -> Column:
    """The least of 1, 2, 2.5, 5 and 10 times a power of ten that is at least ``width``."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(width)))
    ratio = width / power
    return power * F.when(ratio <= 1, 1.0).when(ratio <= 2, 2.0).when(ratio <= 2.5, 2.5).when(ratio <= 5, 5.0).otherwise(10.0)


def magnitude(value: Column) -> Column:
    """The power of ten that a number lies in, as ``1e2..1e3``; null for zero."""
    e = F.floor(F.log10(F.abs(value))).cast("int")
    return F.concat(F.lit("1e"), e.cast("string"), F.lit("..1e"), (e + 1).cast("string"))


def shown(value: Column) -> Column:
    """A number without decimals if it is whole, else with one."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.format_string("%.1f", F.bround(value, 1)))
