"""Raw CSV and JSON-lines tables.

Every column is read as a string: what a cell means is decided by ``operators.clean``, so no pass over the
data infers types, and one odd cell does not change a column's type.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: longest field of an imported article.
MOST_CHARS = 1_000_000


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, rename: dict[str, str] | None = None, optional: list[str] | None = None) -> DataFrame:
    """A CSV table with a header: all strings, ``\\N`` null, white space around header names dropped, columns renamed.

    Where nothing is at ``path``, an empty table with the columns ``optional`` if they are given, else Spark's error.
    """
    try:
        df = spark.read.options(header=True, inferSchema=False, nullValue="\\N", mode="PERMISSIVE", multiLine=False, escape='"').csv(path)
    except AnalysisException as error:
        if optional is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], strings(optional))
    return df.toDF(*[(rename or {}).get(c.strip(), c.strip()) for c in df.columns])


def of_entities(df: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``entities``; null keys never are."""
    return df.join(entities.select(key).distinct(), key, "left_semi")


def sample_entities(df: DataFrame, key: str, least: int, n: int, seed: int = 42) -> DataFrame:
    """``n`` entities with at least ``least`` rows, by a seeded hash of the key: the same for the same rows, however dealt."""
    enough = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)
    return enough.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def sharded(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard``, the same for all rows of an entity (0 for a null key); write it with ``partitionBy("shard")``."""
    return df.withColumn("shard", F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % shards, F.lit(0)).cast("int"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The objects of a JSON-lines file, and the lines that are none (``line``). Blank lines are neither."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    kind = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    parsed = lines.withColumn("row", F.from_json("line", kind, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull() | ~F.trim("line").startswith("{")
    return parsed.where(~bad).select("row.*").drop("_bad"), parsed.where(bad).select("line")


def article_faults(id_col: str = "id") -> Column:
    """Why a row of articles can't be taken; null if it can."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    year = F.col("year").try_cast("int")
    faults = [
        F.when(blank(id_col), "no id"), F.when(blank("title"), "no title"),
        F.when(~blank("year") & (year.isNull() | ~year.between(1000, 9999)), "bad year"),
        *[F.when(F.length(c) > MOST_CHARS, f"{c} too long") for c in ("title", "abstract")],
    ]
    return F.nullif(F.concat_ws("; ", *faults), F.lit(""))


def import_articles(rows: DataFrame, known: DataFrame | None = None, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows to take, one for each id that is not yet known, and rows left out with their ``reason``.

    Of rows with an equal id the least in the order of all columns is taken.
    """
    judged = rows.withColumn("reason", article_faults(id_col))
    fine = judged.where("reason is null").drop("reason")
    best = fine.groupBy(id_col).agg(F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("row"), F.count("*").alias("n"))
    fresh = best.join(known.select(id_col).distinct(), id_col, "left_anti") if known is not None else best
    out = judged.where("reason is not null").select(id_col, "reason")
    again = best.where("n > 1").select(id_col, F.lit("duplicate id").alias("reason"))
    old = best.join(known.select(id_col).distinct(), id_col, "left_semi").select(id_col, F.lit("known id").alias("reason")) if known is not None else again.limit(0)
    return fresh.select("row.*"), out.unionByName(again).unionByName(old)
