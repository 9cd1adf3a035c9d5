"""Queries on stored tables that grow: an inverted index with stems, and vectors of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stem
from ..session import shared_folder
from ..sources.textindex import TextIndex
from ..sources.vectors import VectorCache
from .base import query, table

_QUESTION = "Tioned, Aning élle; the ontings"
_TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def _even(docs):
    return docs.where("doc_id % 2 = 0")


@query(f"""with t as (select doc_id, unnest({_TOKENS.format("text")}) as term from documents), n as (select doc_id, count(*) as length from t group by 1),
s as ({stem.sql("t", "term")}), p as (select stem, doc_id, count(*) as tf from t join s on term = word group by 1, 2),
q as (select distinct stem from ({stem.sql(f"(select unnest({_TOKENS.format(repr(_QUESTION))}) as term)", "term")})), d as (select stem, count(*) as n from p group by 1),
w as (select count(*) as docs, sum(length) / count(*) as mean from (select coalesce(length, 0) as length from documents left join n using (doc_id)))
select cast(doc_id as varchar) as id, round(sum(ln((docs - d.n + 0.5) / (d.n + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from p join q using (stem) join d using (stem) join n using (doc_id), w group by 1""")
def index_search(spark, sf_dir):
    """BM25 by stems from a stored index that two imports built, the second of texts that are partly known."""
    index, docs = TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"), table(spark, sf_dir, "documents")
    index.add(_even(docs), "doc_id", "text")
    index.add(docs, "doc_id", "text")
    return index.search(_QUESTION).select("id", F.round("score", 6).alias("score"))


@query(f"with t as (select unnest({_TOKENS.format('text')}) as term from documents) select word, stem from ({stem.sql('t', 'term')}) where word <> stem")
def word_stems(spark, sf_dir):
    """Words of the documents that aren't their own stems."""
    from ..sources.textindex import tokens

    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return stem.stemmed(words, "word").where("word <> stem")


def _measured(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: lengths and counts of a text."""
    return [[len(t), t.count("e"), t.count(" ") / 4] for t in texts]


@query("""with d as (select doc_id, coalesce(text, '') as text from documents), n as (select count(distinct text) filter (where doc_id % 2 = 0) as first, count(distinct text) as whole from d)
select doc_id, cast(length(text) as double) as length, cast(length(text) - length(replace(text, 'e', '')) as double) as e, (length(text) - length(replace(text, ' ', ''))) / 4.0 as spaces, first, whole - first as second, 0 as third from d, n""")
def incremental_vectors(spark, sf_dir):
    """Vectors of half of the documents, then of all, then once more: how many texts each run embeds, and the vectors."""
    cache, docs = VectorCache(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"), table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = [cache.update(rows, "text", _measured, "measures") for rows in (_even(docs), docs, docs)]
    rows = cache.of(docs, "text", "measures").select("doc_id", *[F.col("vector")[i].cast("double").alias(c) for i, c in enumerate(("length", "e", "spaces"))])
    return rows.withColumns({c: F.lit(n).cast("long") for c, n in zip(("first", "second", "third"), runs, strict=True)})
