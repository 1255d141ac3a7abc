"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` names the stages in order; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame, all but the last with the
columns of ``docs``. ``run`` stores what each stage returns in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sidewise.llm import exactdedup, languageid, neardup, packing, pii
from sidewise.llm.queries import vocabulary
from sidewise.plans.storage import cut

CAPACITY, END_ID = 1024, 2
# SQL can express neither the learned model nor the alignment nor the packing.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters, whatever the share of their main language; a missing label is filled with that.

    Without any language to learn from, nothing can be told about the documents and all are kept as they are.
    """
    model = languageid.learn(docs)
    if not model.languages:
        return docs
    # Only texts without letters have the score 0.
    kept = languageid.identify(docs, model).filter(F.col("__score") > 0)
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest id of each text."""
    return exactdedup.find_exact_duplicates(docs).kept()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that with the smallest id."""
    return neardup.without_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents with personal data replaced by its kind."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json"), END_ID, CAPACITY, keep_ids=False)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
