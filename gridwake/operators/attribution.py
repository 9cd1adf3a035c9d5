"""Details of texts that are about several cases: whose each is, and which of them only another case has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .deidentify import ID

# Where a sentence ends, how a line of a list begins, and words that deny what follows them.
SENTENCE_END = r"[.!?](?=\s+[A-Z(\[]|\s*$)"
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s"
DENIAL = r"\b(?:no|not|without|never|lacks?)\b[^.;]{0,40}?"


def placed(texts: DataFrame, key: str, text_col: str, detail: str, case: str = ID) -> DataFrame:
    """A row for each detail of each text with its ``case``: ``line``, ``sentence``, ``place``, ``detail``, ``denied``, ``named``.

    A detail belongs to the case that was named last before it in its sentence, else to the sentence's first one; in a
    line of a list that names none, to the only case of the line that the list is under. Others have a null case.
    ``named`` are the cases of the sentence. ``detail`` is a pattern, matched whole; case numbers are read in small letters.
    A null text has no details. Work is by sentence, so a long text is no task of its own.
    """
    lines = texts.select(key, F.posexplode(F.split(text_col, "\n")).alias("line", "_text"))
    cut = lines.select(key, "line", "_text", F.posexplode(F.split("_text", SENTENCE_END)).alias("sentence", "_part"))
    match = rf"(?i:{DENIAL}){detail}|{case}|{detail}"
    found = cut.select(key, "line", "sentence", F.posexplode(F.regexp_extract_all("_part", F.lit(match), F.lit(0))).alias("place", "_token"))
    is_case = F.col("_token").rlike(f"^(?:{case})$")
    own = found.withColumn("_case", F.when(is_case, F.lower("_token")))
    within = Window.partitionBy(key, "line", "sentence")
    upto = within.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    owned = own.withColumns({
        "_last": F.last("_case", ignorenulls=True).over(upto),
        "_first": F.min(F.when(F.col("_case").isNotNull(), F.struct("place", "_case"))).over(within),
        "named": F.sort_array(F.collect_set("_case").over(within)),
    }).where("_case is null")
    told = owned.join(_carried(lines, key, case), [key, "line"], "left")
    named = F.when(F.size("named") > 0, F.col("named")).when(F.col("_carry").isNotNull(), F.array("_carry")).otherwise(F.array().cast("array<string>"))
    return told.select(
        key, "line", "sentence", "place", F.coalesce("_last", "_first._case", "_carry").alias("case"), F.regexp_extract("_token", f"(?:{detail})$", 0).alias("detail"),
        F.col("_token").rlike(rf"(?i)^{DENIAL}").alias("denied"), named.alias("named"),
    )


def _carried(lines: DataFrame, key: str, case: str) -> DataFrame:
    """For each line of a list without a case, the only case of the line that it is under."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(case), F.lit(0)), F.lower))
    told = lines.where(F.trim("_text") != "").select(key, "line", ids.alias("_ids"), F.col("_text").rlike(BULLET).alias("_item"))
    open_ = (F.size("_ids") == 0) & F.col("_item")
    heads = told.withColumn("_head", F.when(~open_, F.struct(F.when(F.size("_ids") == 1, F.get("_ids", F.lit(0))).alias("id"))))
    over = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return heads.withColumn("_above", F.last("_head", ignorenulls=True).over(over)).where(open_ & F.col("_above.id").isNotNull()).select(key, "line", F.col("_above.id").alias("_carry"))


def misattributed(details: DataFrame, key: str, listed: DataFrame, record: DataFrame, claim: Column) -> DataFrame:
    """Details that neither their case nor another one of their sentence has: ``key``, ``case``, ``detail``, ``holder``.

    ``listed`` holds the cases (``case``) of each text's sources, ``record`` what each case has (``case``, ``detail``).
    Only cases that are listed are judged. ``holder`` is the least listed case, not named beside it, that has the detail;
    without one only a ``claim`` (say the name of a flag) is a fault, as other details may come from elsewhere.
    A claim that is denied is none.
    """
    low = lambda df: df.withColumn("case", F.lower("case"))
    known, has = low(listed).select(key, "case").distinct(), low(record).select("case", "detail").distinct()
    said = details.where(~(F.col("denied") & claim) & F.col("case").isNotNull()).select(key, "case", "detail", "named", claim.alias("_claim")).distinct()
    said = said.join(known, [key, "case"], "left_semi").withColumn("_row", F.struct(key, "case", "detail", "named"))
    allowed = said.select("_row", "detail", F.explode(F.array_distinct(F.concat(F.array("case"), "named"))).alias("case"))
    fine = allowed.join(known.select(F.col(key).alias("_key"), F.col("case").alias("_case")), (F.col(f"_row.{key}") == F.col("_key")) & (F.col("case") == F.col("_case")), "left_semi").join(has, ["case", "detail"], "left_semi").select("_row").distinct()
    open_ = said.join(fine, "_row", "left_anti")
    others = open_.select("_row", key, "detail", "named").join(known.withColumnRenamed("case", "holder"), key).where(~F.array_contains("named", F.col("holder")) & (F.col("holder") != F.col("_row.case")))
    held = others.join(has.withColumnRenamed("case", "holder"), ["holder", "detail"], "left_semi").groupBy("_row").agg(F.min("holder").alias("holder"))
    return open_.join(held, "_row", "left").where(F.col("holder").isNotNull() | F.col("_claim")).select(key, "case", "detail", "holder").distinct()
