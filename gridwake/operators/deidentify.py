"""Texts without what identifies a person: aliases, age bands, minutes from an event, categories.

One pass finds all that is to go: a text is cut at the matches of one pattern, and each match is replaced by what it is.
Identifiers meet a table of aliases by a join of those that occur, and clock times of events the time they count from,
so neither is part of the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notes in place of what goes, lines of a text, and the categories of procedures; the first that fits holds.
NOT_SENT, LINES = "[{} not sent]", 400
CATEGORIES = {
    "Transplant": r"transplant",
    "Cardiac": r"cabg|coronary|cardiac|heart|valve|mitral|sternotomy",
    "Thoracic": r"lobectomy|thoracoscop|thoracotomy|vats\b|lung|pneumonectomy|esophagectomy|mediastin",
    "Neurosurgery": r"craniotomy|craniectomy|ventriculo|burr hole|brain|intracranial",
    "Spine": r"laminectomy|laminotomy|discectomy|spin|vertebr|kyphoplasty|lumbar|foraminotomy",
    "Vascular": r"endarterectomy|aneurysm|evar\b|fistula|carotid|vascular|bypass graft|embolectomy",
    "Urology": r"prostat|cystoscop|cystectomy|nephr|ureter|bladder|kidney|turp\b|urethr|orchi",
    "Gynecology and obstetrics": r"hysterect|cesarean|caesarean|c-section|ovar|uter|myomect|salping|dilation and curettage|d&c\b",
    "Head and neck": r"thyroid|parathyroid|tonsil|adenoid|sinus|laryn|tracheost|mastoid|septo|parotid|neck dissection|tympan",
    "Eye": r"cataract|vitrect|retin|ocular|strabism|cornea",
    "Orthopedic": r"arthroplast|arthroscop|orif\b|fractur|fixation|knee|hip\b|shoulder|joint|tendon|ligament|osteotomy|amputation|open reduction|closed reduction|acl\b|menisc|rotator cuff",
    "Breast and plastic": r"breast|mastectomy|mammoplast|flap|skin graft|plastic|reconstruct",
    "Endoscopy": r"endoscop|colonoscop|egd\b|bronchoscop|ercp\b",
    "General and abdominal": r"cholecyst|append|hernia|colectomy|bowel|gastr|whipple|pancrea|hepat|liver|splen|laparotom|laparoscop|bariatric|colon|rect|abdom",
}
OTHER = "Other or not classified"

ID = r"\b(?:SYN[0-9a-fA-F]{10}|[0-9a-fA-F]{16})\b"
_ALIAS = r"\bCase-\w+\b"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|June?|July?|Aug|Sept?|Oct|Nov|Dec)[a-z]*\.?"
_STAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?"
_AGE_TAIL = r"(?:-year[- ]old|\s+years?[- ]old|\s+years?\s+of\s+age|\s*y/o\b|\s*yo\b|\s*yrs?\b|[ \t]?[FM](?![A-Za-z]))"
#: Kinds of matches, in the order in which they are tried at a place.
_KINDS = {
    "procedure": r"(?m:(?<![^\n])(?:- )?Procedure: .*?(?=\. Age: |$))",
    "event": rf"(?m:(?<![^\n])- {_STAMP}(?=: \S))",
    "path": r"(?<![\w:/])/(?:[^/\s]+/)+[^/\s]+|[A-Za-z]:\\[^\s]+",
    "id": ID,
    "time": rf"\b{_STAMP}(?:\.\d+)?\b|\b\d{{1,2}}:\d{{2}}(?::\d{{2}})?\b|\b(?:[01]\d|2[0-3])[0-5]\dh\b",
    "date": rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|(?i:\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}\s+\d{{4}}\b|\b{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b)",
    "age": rf"(?i:(?:\bage:\s*|\baged\s+|\bage\s+of\s+)\d{{1,3}}(?:\.\d+)?(?![\d.]*\d)|(?<![\w.–-])\d{{1,3}}(?:\.\d+)?{_AGE_TAIL})",
}
#: Where any kind can begin: it holds at each match of _KINDS, and most places of a text are passed by it alone.
_START = r"(?:(?<!\w)(?=[-/0-9A-FJMNOPSa-fjmnos])|(?=[A-Za-z]:\\))"
_OPEN, _SHUT = "\u0001", "\u0002"


def category(procedure: Column) -> Column:
    """The first category whose words a procedure has."""
    out = None
    for name, words in CATEGORIES.items():
        fits = procedure.rlike(rf"(?i)\b(?:{words})")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(OTHER)


def age_band(age: Column) -> Column:
    """Five years, from a multiple of five."""
    low = (F.floor(age / 5) * 5).cast("int")
    return F.concat(low.cast("string"), F.lit("–"), (low + 4).cast("string"))


def _cut(text: Column, pattern: str) -> Column:
    clean = F.translate(F.coalesce(text, F.lit("")), _OPEN + _SHUT, "")
    return F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_SHUT}"), _OPEN)


def _joined(parts: str, told: str) -> Column:
    """The parts again, with what is told in place of the matches before their ends."""
    rest = F.transform(F.expr(f"slice({parts}, 2, greatest(size({parts}) - 1, 0))"), lambda p, i: F.concat(F.get(told, i), F.split_part(p, F.lit(_SHUT), F.lit(2))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def _mapped(rows: DataFrame, table: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """For each key, a map of those of its words ``_word`` that the table has."""
    return rows.join(table.select(F.col(source).alias("_word"), F.col(target).alias("_to")), "_word").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("_word", "_to"))).alias("_map"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once: a generator isn't merged into the functions of arrays that use them, which would compute them for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def outbound(texts: DataFrame, key: str, text_col: str, aliases: DataFrame, case_col: str | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """``texts`` with ``sent``, the text as it may leave.

    ``aliases`` holds an ``alias`` for an ``id`` (one row each); an identifier without one is masked. ``anchors`` holds
    for a ``case`` the time ``at`` that its events' times are counted from; without it no time goes out. Procedures
    become their category, ages five-year bands, other times, dates and paths notes, and lines over LINES a count. A
    null text is empty. ``key`` is unique; other columns stay.
    """
    every = _START + "(?:" + "|".join(f"(?:{p})" for p in _KINDS.values()) + ")"
    ids = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(ID), F.lit(0)))).alias("_word"))
    told_of = _mapped(ids, aliases, key, "id", "alias").withColumn("_at", F.lit(None).cast("timestamp"))
    if anchors is not None and case_col:  # met by keys alone, so texts are dealt out once
        at = texts.select(key, F.col(case_col).alias("case")).join(anchors.select("case", F.col("at").alias("_at")), "case").select(key, F.lit(None).cast(told_of.schema["_map"].dataType).alias("_map"), "_at")
        told_of = told_of.unionByName(at).groupBy(key).agg(F.first("_map", True).alias("_map"), F.first("_at", True).alias("_at"))
    rows = _once(texts.join(told_of, key, "left"), _parts=_cut(F.col(text_col), every))
    is_ = lambda t, kind: t.rlike(f"^(?:{_KINDS[kind]})")

    def told(t: Column, tail: Column) -> Column:
        stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(t, _STAMP, 0), "T", " "))
        since = F.array(F.unix_micros(stamp) - F.unix_micros("_at"))
        minute = F.get(F.transform(since, lambda d: F.concat(F.lit("- minute "), F.when(d >= 0, F.lit("+")).otherwise(F.lit("")), F.round(d / 6e7).cast("long").cast("string"), F.lit(" from incision"))), F.lit(0))
        age = F.regexp_extract(t, r"(\d{1,3})(?:\.\d+)?", 1).cast("int")
        return (
            F.when(t.startswith("Procedure: ") | t.startswith("- Procedure: "), F.concat(F.regexp_extract(t, "^(- )?", 0), F.lit("Procedure category: "), category(F.regexp_replace(t, "^(- )?Procedure: ", ""))))
            .when(t.startswith("- ") & tail.startswith(": "), F.coalesce(minute, F.lit("- time not sent")))
            .when(t.startswith("/") | t.rlike(r"^[A-Za-z]:\\"), NOT_SENT.format("path"))
            .when(F.length(t).isin(13, 16) & t.rlike(f"^{ID}$"), F.coalesce(F.try_element_at("_map", t), F.lit(NOT_SENT.format("case number"))))
            .when((F.contains(t, F.lit(":")) | F.contains(t, F.lit("h"))) & is_(t, "time"), NOT_SENT.format("time"))
            .when(is_(t, "date"), NOT_SENT.format("date"))
            .otherwise(F.concat(F.regexp_extract(t, r"^\D*", 0), age_band(age), F.regexp_replace(t, r"^\D*\d{1,3}(?:\.\d+)?", "")))
        )

    part = lambda p: F.struct(F.substring_index(p, _SHUT, 1).alias("t"), F.substring_index(p, _SHUT, -1).alias("tail"))
    rows = _once(rows, _found=F.transform(F.expr("slice(_parts, 2, greatest(size(_parts) - 1, 0))"), part))
    rows = _once(rows, _told=F.transform("_found", lambda f: F.concat(told(f["t"], f["tail"]), f["tail"])))
    rows = _once(rows, _sent=F.concat(F.get("_parts", F.lit(0)), F.array_join("_told", "")))
    lines = F.split("_sent", "\n")
    capped = F.when(F.size(lines) > LINES, F.concat(F.array_join(F.slice(lines, 1, LINES), "\n"), F.lit("\n["), (F.size(lines) - LINES).cast("string"), F.lit(" more lines not sent]"))).otherwise(F.col("_sent"))
    return rows.withColumn("sent", capped).drop("_parts", "_found", "_told", "_map", "_at", "_sent")


def inbound(texts: DataFrame, key: str, text_col: str, aliases: DataFrame) -> DataFrame:
    """``texts`` with ``received``: aliases turned back into identifiers; an alias that nobody has stays."""
    words = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(_ALIAS), F.lit(0)))).alias("_word"))
    rows = texts.withColumn("_parts", _cut(F.col(text_col), _ALIAS)).join(_mapped(words, aliases, key, "alias", "id"), key, "left")
    word = lambda p: F.split_part(p, F.lit(_SHUT), F.lit(1))
    rows = rows.withColumn("_told", F.transform(F.expr("slice(_parts, 2, greatest(size(_parts) - 1, 0))"), lambda p: F.coalesce(F.try_element_at("_map", word(p)), word(p))))
    return rows.withColumn("received", _joined("_parts", "_told")).drop("_parts", "_told", "_map")
