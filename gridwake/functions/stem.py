"""Stems of English words by Porter's rules, as SQL expressions over a column ``w``.

Each step is one expression that both Spark and DuckDB read; ``match`` is the dialect's regular-expression test. A
word's form in terms of vowels and consonants is tested by patterns: ``y`` is a consonant at the start and after a
vowel. Stemming is meant for distinct words, a small table beside the texts they are from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffixes of the published rules (with logi and bli), and the lengths of words that are stemmed.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
SHORTEST, LONGEST = 3, 64

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_SOME, _MORE, _ONE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL, _CVC = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

Match = Callable[[str, str], str]


def _drop(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _suffixes(rules: dict[str, str], match: Match, form: str) -> str:
    """The longest suffix that fits is replaced if what stands before it has the form."""
    cases = []
    for s in sorted(rules, key=len, reverse=True):
        before = _drop(len(s))
        held = f" and {match(before, '[st]$')}" if s == "ion" else ""
        cases.append(f"when {match('w', s + '$')}{held} then case when {match(before, form)} then {before} || '{rules[s]}' else w end")
    return f"case {' '.join(cases)} else w end"


def steps(match: Match) -> list[str]:
    """Expressions over ``w``, each to be applied to the result of the one before; a ``#`` marks a word whose ending step 1b took off."""
    ending = f"case when {match('w', 'eed$')} then case when {match(_drop(3), _SOME)} then {_drop(1)} else w end when {match('w', 'ed$')} and {match(_drop(2), _VOWEL)} then {_drop(2)} || '#' when {match('w', 'ing$')} and {match(_drop(3), _VOWEL)} then {_drop(3)} || '#' else w end"
    doubles = "|".join(2 * c for c in "bcdfghjkmnpqrtvwxy")
    bare = _drop(1)
    mended = f"case when not {match('w', '#$')} then w when {match('w', '(at|bl|iz)#$')} then {bare} || 'e' when {match('w', f'({doubles})#$')} then {_drop(2)} when {match(bare, _CVC)} then {bare} || 'e' else {bare} end"
    last_e = f"case when {match('w', 'e$')} and ({match(bare, _MORE)} or ({match(bare, _ONE)} and not {match(bare, _CVC)})) then {bare} else w end"
    return [
        f"case when {match('w', '(ss|i)es$')} then {_drop(2)} when {match('w', '[^s]s$')} then {bare} else w end",
        ending,
        mended,
        f"case when {match('w', 'y$')} and {match(bare, _VOWEL)} then {bare} || 'i' else w end",
        _suffixes(STEP2, match, _SOME),
        _suffixes(STEP3, match, _SOME),
        _suffixes(dict.fromkeys(STEP4, ""), match, _MORE),
        last_e,
        f"case when {match('w', 'll$')} and {match('w', _MORE)} then {bare} else w end",
    ]


def stemmed(words: DataFrame, column: str, out: str = "stem") -> DataFrame:
    """``words`` with the stem of a column of lower-case words; words of other letters, and very short or long ones, are their own."""
    fits = F.col(column).rlike(f"^[a-z]{{{SHORTEST},{LONGEST}}}$")
    rows = words.select("*", F.col(column).alias("w"))
    for step in steps(lambda x, pattern: f"rlike({x}, '{pattern}')"):
        rows = rows.select("*", F.inline(F.array(F.struct(F.expr(step).alias("_next"))))).drop("w").withColumnRenamed("_next", "w")  # a generator keeps steps apart
    return rows.withColumn(out, F.when(fits, F.col("w")).otherwise(F.col(column))).drop("w")


def sql(source: str, column: str) -> str:
    """DuckDB SQL of ``stemmed`` for the distinct words of a column of a relation: (word, stem)."""
    inner = f"select distinct {column} as word, {column} as w from {source}"
    for step in steps(lambda x, pattern: f"regexp_matches({x}, '{pattern}')"):
        inner = f"select word, {step} as w from ({inner})"
    return f"select word, case when regexp_matches(word, '^[a-z]{{{SHORTEST},{LONGEST}}}$') then w else word end as stem from ({inner})"
