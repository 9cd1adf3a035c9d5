"""Search over documents: term filters, keyword and BM25 scores, vector ranking, fusion."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..session import cut

#: BM25's saturation and length weights, and the constant of rank fusion.
K1, B, RRF = 1.2, 0.75, 60


def all_else_any(docs: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows with all terms; if there is none, rows with any."""
    every = docs.where(tx.contains_all(F.col(column), terms))
    return docs.where(tx.contains_any(F.col(column), terms)) if every.isEmpty() else every


def keyword_postings(docs: DataFrame, key: str, column: str, question: str) -> DataFrame:
    """Documents with a term of the question, with their keyword score, from an inverted index of (term, document, sentence).

    The score is half the share of the question's terms in the text, plus half the share in the sentence with most
    of them. Texts without a term are turned away before they are cut; only rows of terms are shuffled.
    """
    wanted = tx.question_terms(question)
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    some = F.lit(False)
    for t in wanted:
        some |= F.contains(tx.folded(F.col(column)), F.lit(t))
    sentences = docs.where(some).select(key, F.posexplode(F.split(column, "[.;]")).alias("place", "sentence"))
    terms = F.array_intersect(F.array(*[F.lit(t) for t in wanted]), tx.tokens(F.col("sentence")))
    by_sentence = sentences.select(key, terms.alias("terms")).where(F.size("terms") > 0)
    by_doc = by_sentence.groupBy(key).agg(F.max(F.size("terms")).alias("best"), *[F.max(F.array_contains("terms", t).cast("int")).alias(f"t{i}") for i, t in enumerate(wanted)])
    every = sum((F.col(f"t{i}") for i in range(1, len(wanted))), F.col("t0"))
    return by_doc.select(key, ((every + F.col("best")) / (2.0 * len(wanted))).alias("score"))


def bm25(docs: DataFrame, key: str, column: str, question: str) -> DataFrame:
    """BM25 of each document with a term of the question.

    Texts are cut once: their lengths and occurrences, a few numbers for each, are kept, and give the totals and the
    scores. A document without tokens counts for neither.
    """
    terms = tx.question_terms(question)
    words = docs.select(key, tx.tokens(F.col(column)).alias("_t"))
    times = lambda term: F.size(F.filter("_t", lambda w: w == term))
    counts = cut(words.select(key, F.size("_t").alias("n"), *[times(t).alias(f"f{i}") for i, t in enumerate(terms)]).where("n > 0"))
    stats = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    score, any_ = F.lit(0.0), F.lit(False)
    for i in range(len(terms)):
        idf = math.log((stats["docs"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5) + 1)
        f = F.col(f"f{i}")
        score += idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(stats["mean"] or 1.0)))
        any_ |= f > 0
    return counts.where(any_).select(key, score.alias("bm25"))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float]) -> DataFrame:
    """Cosine of every vector with one query vector, which is a literal of the plan."""
    return vectors.select(key, tx.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("cos"))


def ranked(scored: DataFrame, key: str, score: str, most: int) -> DataFrame:
    """The ``most`` best by score, then key, with their rank; only these meet in one task."""
    best = scored.orderBy(F.desc(score), key).limit(most)
    return best.select(key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), key)).alias("rank"))


def fuse(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of two rankings."""
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    joined = a.withColumnRenamed("rank", "ra").join(b.withColumnRenamed("rank", "rb"), key, "full_outer")
    return joined.select(key, (part("ra") + part("rb")).alias("fused"))


def hybrid(scored: DataFrame, key: str, most: int) -> DataFrame:
    """Ranking by vector, with places kept for keyword hits that have no vector, as many as their share of the pool.

    ``scored`` has ``score`` and ``cos`` (null without a vector).
    """
    pool, missing, hits = scored.agg(F.count("*"), F.count_if(F.col("cos").isNull()), F.count_if(F.col("cos").isNull() & (F.col("score") > 0))).first()
    slots = min(hits, math.ceil(most * missing / pool)) if pool else 0
    words = scored.where("cos is null and score > 0").orderBy(F.desc("score"), key).limit(slots)
    vectors = scored.where("cos is not null").orderBy(F.desc("cos"), key).limit(most - slots)
    return words.select(key, F.lit("keyword").alias("branch")).unionByName(vectors.select(key, F.lit("vector").alias("branch")))


def ordered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place in an order; for hits of one search, which one task can hold."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def with_direct(scored: DataFrame, key: str, question: str) -> DataFrame:
    """Scores over zero; an id that the question itself names scores 2."""
    named = re.findall(r"[0-9]+", question)
    direct = F.col(key).cast("string").isin(*named) if named else F.lit(False)
    return scored.withColumn("score", F.when(direct, 2.0).otherwise(F.col("score"))).where("score > 0")
