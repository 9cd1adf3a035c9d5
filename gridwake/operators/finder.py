"""Finding cases: filters that are data, how many rows each leaves, and a shortlist by words and vectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import hybrid, keyword_postings, nearest, with_direct

#: Cases of a shortlist, and extracts that are read of them.
SHORTLIST, EXTRACTS = 10, 3


class Filter(NamedTuple):
    """``op`` of a field and a value: ``eq`` (whatever the case of letters), ``least``, ``most``, ``near`` (value, tolerance), ``any`` (one of some texts is contained), ``is`` (true, false)."""

    field: str
    op: str
    value: object


def condition(f: Filter) -> Column:
    """Whether a row passes; a null field passes nothing."""
    column = F.col(f.field)
    if f.op == "eq":
        test = F.lower(column) == f.value.lower() if isinstance(f.value, str) else column == F.lit(f.value)
    elif f.op == "least":
        test = column >= F.lit(f.value)
    elif f.op == "most":
        test = column <= F.lit(f.value)
    elif f.op == "near":
        middle, reach = f.value
        test = F.abs(column - F.lit(middle)) <= F.lit(reach)
    elif f.op == "any":
        test = F.lit(False)
        for part in f.value:
            test |= F.contains(F.lower(column), F.lit(part.lower()))
    elif f.op == "is":
        test = column == F.lit(bool(f.value))
    else:
        raise ValueError(f"no filter {f.op}")
    return F.coalesce(test, F.lit(False))


def passes(filters: list[Filter]) -> Column:
    every = F.lit(True)
    for f in filters:
        every &= condition(f)
    return every


def from_table(table: DataFrame) -> dict[str, list[Filter]]:
    """Sets of filters from a table (``name``, ``step``, ``field``, ``op``, ``value`` as JSON): a line a filter, so it is small."""
    import json

    out: dict[str, list[Filter]] = {}
    for r in table.orderBy("name", "step").collect():
        out.setdefault(r["name"], []).append(Filter(r["field"], r["op"], json.loads(r["value"])))
    return out


def step_counts(records: DataFrame, sets: dict[str, list[Filter]]) -> DataFrame:
    """``name``, ``step`` (0: before any), ``field`` and ``left``: rows that are left after each filter of each set in turn.

    One pass over the records whatever the number of sets: a row counts for each set once, at the last step that it
    passes, and a step's rows are those of it and of all after it.
    """
    def reached(filters: list[Filter]) -> Column:
        out, open_ = F.lit(0), F.lit(True)
        for f in filters:
            open_ = open_ & condition(f)
            out = out + open_.cast("int")
        return out

    told = [F.struct(F.lit(name).alias("name"), reached(filters).alias("_at")) for name, filters in sets.items()]
    steps = [(name, i, filters[i - 1].field if i else None) for name, filters in sets.items() for i in range(len(filters) + 1)]
    frame = records.sparkSession.createDataFrame(steps, "name string, step int, field string")
    if not told:
        return frame.withColumn("left", F.lit(0).cast("long"))
    counts = records.select(F.explode(F.array(*told)).alias("_t")).groupBy("_t.name", "_t._at").agg(F.count("*").alias("n"))
    rows = frame.join(F.broadcast(counts.withColumnRenamed("_at", "step")), ["name", "step"], "left")  # a row a filter at most
    after = Window.partitionBy("name").orderBy(F.desc("step"))
    return rows.select("name", "step", "field", F.sum(F.coalesce("n", F.lit(0))).over(after).alias("left"))


def shortlist(records: DataFrame, key: str, text_col: str, question: str, filters: list[Filter] = (), vectors: DataFrame | None = None, query_vector: list[float] | None = None, most: int = SHORTLIST) -> DataFrame:
    """``key``, ``place``, ``score`` and ``method`` of the cases that answer a question best, among those that pass the filters.

    An id that the question names comes first (score 2). With vectors (``key``, ``vector``) and the question's, cases
    are ranked by cosine, and as many places as is the share of cases without a vector go to those by words; without,
    by words alone. If filters are given, a case that passes them is kept though no word of the question is in it.
    """
    pool = records.where(passes(list(filters)))
    found = keyword_postings(pool.select(key, text_col), key, text_col, question)
    scored = with_direct(pool.select(key).join(found, key, "left").fillna(0.0, ["score"]).withColumn("score", F.col("score") + (1e-9 if filters else 0.0)), key, question)
    direct = scored.where("score >= 2")
    by_words = scored.select(key, "score", F.lit("keyword").alias("method"))
    if vectors is None or query_vector is None:
        ranked = by_words
    else:
        near = nearest(vectors.join(pool.select(key), key, "left_semi"), key, "vector", query_vector)
        both = pool.select(key).join(found, key, "left").fillna(0.0, ["score"]).join(near, key, "left").join(direct.select(key), key, "left_anti")
        places = hybrid(both, key, most)
        ranked = places.join(both, key).select(key, F.when(F.col("branch") == "keyword", F.col("score")).otherwise(F.col("cos")).alias("score"), F.when(F.col("branch") == "keyword", "keyword").otherwise("embedding").alias("method"))
        ranked = direct.select(key, "score", F.lit("keyword").alias("method")).unionByName(ranked)
    order = [F.desc(F.col("score") >= 2), F.desc("score"), key]
    best = ranked.orderBy(*order).limit(most)
    return best.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"), F.round("score", 6).alias("score"), "method")


def extracts(found: DataFrame, records: DataFrame, key: str, text_col: str, preferred: str, most: int = EXTRACTS, chars: int = 6000) -> DataFrame:
    """``key``, ``place`` and ``extract`` of the first cases of a shortlist, those with ``preferred`` before others; long texts are cut."""
    best = found.join(records.select(key, text_col, F.coalesce(preferred, F.lit(False)).alias("_first")), key)
    order = [F.desc("_first"), "place"]
    top = best.orderBy(*order).limit(most)
    text = F.when(F.length(text_col) > chars, F.concat(F.left(text_col, F.lit(chars)), F.lit(" …"))).otherwise(F.col(text_col))
    return top.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"), text.alias("extract"))
