"""From raw documents to packed sequences: five stages, each written and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import hosts, mixing, omh, packing, substring
from gridwake.llm.shared import small, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the rules, or whose host does.

    Each row is judged on its own, repeated ones alike. A null or blank text has no words and fails; a null
    source is a host of its own; ids are not looked at. Columns beyond those of documents are dropped. An empty
    table gives an empty one.
    """
    judged = hosts.judged(docs, others={c: c for c in ("doc_id", "lang", "source", "n_chars")})
    return judged.where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the least id.

    Rows that share an id are documents of their own: they go only if their class is the same (or they have
    no words, both), and the digest of the text, then the other columns, choose among them. Rows with a null
    id all stay, and so do texts without words under ids of their own. Columns beyond those of documents are
    dropped. An empty table gives an empty one.
    """
    if not _repeated(docs):
        gone = omh.classes(docs).where("class_id is not null and class_id != doc_id").select("doc_id").distinct()
        return docs.join(small(stored(gone, "gone")), "doc_id", "left_anti").select(*COLUMNS)
    rows = stored(docs.where("doc_id is not null").select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    wordless = mixing.words("text") == 0
    order = rows.select("row", F.when(wordless, F.col("doc_id")).alias("alone"), F.struct("doc_id", F.sha2("text", 256).alias("digest"), "lang", "source", "n_chars", "row").alias("order"))
    classed = order.join(omh.classes(rows, id_col="row"), "row").withColumn("class_id", F.when(F.col("alone").isNull(), F.col("class_id")))
    kept = classed.groupBy("class_id", "alone").agg(F.min("order").alias("first")).select(F.col("first.row").alias("row"))
    one = rows.join(small(stored(kept, "kept")), "row", "left_semi").select(*COLUMNS)
    return one.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def _repeated(docs: DataFrame) -> bool:
    ids = docs.select("doc_id").where("doc_id is not null")
    return not ids.groupBy("doc_id").count().where("count > 1").isEmpty()


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document that loses all its words goes. Others keep their text as it is.

    Of documents that share a passage that with the least id keeps it; rows with equal ids don't take from each
    other, rows with a null id come last, as one document. Null and blank texts have no words and stay as they
    are. ``n_chars`` is counted anew where a text was cut. Columns beyond those of documents are dropped. An
    empty table gives an empty one.
    """
    cut = substring.dedup(docs, columns=("doc_id", "text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    left = cut.where("n_removed = 0 or n_removed < n_words")
    return left.withColumns({"n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")), "text": text}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics come nearer to their target shares.

    A null source, language or topic is a value of its own. Rows with equal ids, and all with a null id, are
    kept or left together. A document without words has its cell's probability. Columns beyond those of
    documents are dropped. An empty table gives an empty one.
    """
    rows = mixing.topics(docs, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("mix_label")}
    return mixing.mixed(rows, margins, mixing.words("text"), "doc_id").where("mix_kept").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences; every row is packed, repeated and null ids too.

    A null or empty text is its end token alone. Columns beyond id and text are not read. An empty table gives an
    empty one.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Order min-hash, and packing by a tokenizer, have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what one keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
