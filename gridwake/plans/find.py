"""Queries of the finder: counts of filters, shortlists with extracts, and memoised results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import finder
from ..operators.finder import Filter
from ..session import shared_folder
from ..sources.memo import Memo
from .base import query, table
from .search import _COS_SQL, _QUESTION, _SCORE_SQL, _vector

#: The question's terms, and the id that it names, which is one, too.
_ASKED_SQL = _SCORE_SQL.replace("'onnt']", "'onnt', '12']").replace("/ 4.0", "/ 6.0")

_SETS = [
    ("long", 1, "n_chars", "least", "400"), ("long", 2, "lang", "eq", '"EN"'), ("long", 3, "text", "any", '["Thing", "nting"]'), ("long", 4, "has", "is", "true"),
    ("near", 1, "n_chars", "near", "[1000, 500]"), ("near", 2, "lang", "any", '["e", "f"]'),
    ("none", 1, "n_chars", "most", "0"), ("none", 2, "has", "is", "false"),
]
_TESTS = {
    "long": ["n_chars >= 400", "lower(lang) = 'en'", "contains(lower(text), 'thing') or contains(lower(text), 'nting')", "has"],
    "near": ["abs(n_chars - 1000) <= 500", "contains(lang, 'e') or contains(lang, 'f')"],
    "none": ["n_chars <= 0", "not has"],
}


def _steps_sql() -> str:
    parts = []
    for name, tests in _TESTS.items():
        fields = [None, *[r[2] for r in _SETS if r[0] == name]]
        for i, field in enumerate(fields):
            seen = " and ".join(f"coalesce({t}, false)" for t in tests[:i]) or "true"
            parts.append(f"select '{name}' as name, {i} as step, {repr(field) if field else 'null'} as field, count(*) filter (where {seen}) as \"left\" from r")
    return "with r as (select d.*, l.doc_id is not null as has from documents d left join labels l using (doc_id)) " + " union all ".join(parts)


def _records(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))


@query(_steps_sql())
def filter_steps(spark, sf_dir):
    """How many documents each filter of three sets leaves, the sets being rows of a table."""
    kinds = "name string, step int, field string, op string, value string"
    return finder.step_counts(_records(spark, sf_dir), finder.from_table(spark.createDataFrame(_SETS, kinds)))


_POOL_SQL = f"""{_ASKED_SQL}, {_COS_SQL}, p as (select doc_id, text, has, case when score >= 2 then 1 else score end as score, cos from (select d.doc_id, d.text, l.doc_id is not null as has from documents d left join labels l using (doc_id) where n_chars >= 300) join k using (doc_id) left join c on vec_id = doc_id),
o as (select * from p where doc_id <> 12), n as (select count(*) as pool, count(*) filter (where cos is null) as missing, count(*) filter (where cos is null and score > 0) as kw from o),
s as (select least(kw, cast(ceil(10.0 * missing / pool) as bigint)) as slots from n),
f as (select doc_id, score, 'keyword' as method from (select doc_id, score, row_number() over (order by score desc, doc_id) as r from o where cos is null and score > 0), s where r <= slots
  union all select doc_id, cos, 'embedding' from (select doc_id, cos, row_number() over (order by cos desc, doc_id) as r from o where cos is not null), s where r <= 10 - slots
  union all select doc_id, 2.0, 'keyword' from p where doc_id = 12),
g as (select doc_id, row_number() over (order by score >= 2 desc, score desc, doc_id) as place, round(score, 6) as score, method from f qualify place <= 10)"""


@query(f"""with {_POOL_SQL}, x as (select g.doc_id, row_number() over (order by has desc, place) as e, case when length(text) > 200 then left(text, 200) || ' …' else text end as extract from g join p using (doc_id))
select doc_id, place, score, method, case when e <= 3 then e end as extract_place, case when e <= 3 then extract end as extract from g join x using (doc_id)""")
def shortlist_with_extracts(spark, sf_dir):
    """The ten best documents of some length for a question that names one of them, and the first three texts, labelled ones before others."""
    records = _records(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    found = finder.shortlist(records, "doc_id", "text", f"{_QUESTION} 12", [Filter("n_chars", "least", 300)], vectors, _vector(spark, sf_dir))
    texts = finder.extracts(found, records, "doc_id", "text", "has", chars=200).withColumnRenamed("place", "extract_place")
    return found.join(texts, "doc_id", "left")


@query("""with u as (select user_id, count(*) as n, max(event_id) as last from events group by 1), c as (select count(*) filter (where user_id % 3 = 0) as first, count(*) filter (where user_id % 3 = 1) as second from u)
select cast(user_id as varchar) as id, n, last, c.first, c.second, c.first as other from u, c where user_id % 3 < 2""")
def memoised_cases(spark, sf_dir):
    """Figures of a third of the users, then of two thirds: only the new ones are computed, unless the preset is another."""
    folder = f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("id", F.col("user_id").cast("string"))
    compute = lambda ids: events.join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    kinds, some = "id string, n long, last long", lambda k: events.where(F.col("user_id") % 3 < k).select("id")
    memo = Memo(spark, folder, kinds, source="events", preset="default")
    _, first = memo.fetch(some(1), compute)
    rows, second = memo.fetch(some(2), compute)
    _, other = Memo(spark, folder, kinds, source="events", preset="strict").fetch(some(1), compute)
    return rows.withColumns({n: F.lit(v).cast("long") for n, v in (("first", first), ("second", second), ("other", other))})
