"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the next
stage reads. All but the last return the columns of ``documents``.

1. language ID: documents without a letter, and so without a language, go;
2. n-gram Jaccard join: of each class of near copies the document with the
   smallest doc_id stays (its first row, where the id is repeated);
3. secret scan: the spans found are replaced by a mark;
4. packing: what is left is cut into sequences of 2048 tokens.

SQL can express neither the trained language model nor the packing, so there
is no ``ORACLE_SQL``; the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsentry.llm import jaccard_join, language_id, packing, secrets_scan
from docsentry.llm.text_queries import BYTE_BPE
from docsentry.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those with a null text or no letter in it go.

    The model is learnt from the labels of ``docs``; where none has a label,
    every document with a letter stays.
    """
    model = language_id.train(docs, F.lit(True))
    if not model.known:
        return docs.filter(F.col("text").rlike("\\p{L}")).select(*COLUMNS)
    found = language_id.predict(docs, model, keep=COLUMNS)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; documents without shingles are classes of their own.

    A doc_id that is repeated keeps one row. Documents without doc_id cannot
    be told apart by it and all stay.
    """
    classes = jaccard_join.join(docs)
    kept = classes.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg((F.count("*") > 1).alias("repeated"))
    kept = materialize(kept, "pipeline-kept")
    own = docs.select(*COLUMNS)
    single = own.join(kept.filter("not repeated").select("doc_id"), "doc_id", "left_semi").unionByName(own.filter(F.col("doc_id").isNull()))
    repeated = own.join(kept.filter("repeated").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(repeated).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    clean = secrets_scan.redact(docs)
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, each mixed like the documents left."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{number}")
    return docs
