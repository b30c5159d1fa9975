"""From documents to packed sequences: language, near duplicates, repeated passages, secrets, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and its rows, written as Parquet and read again, are the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, near_dedup, packing, secrets, suffix_dedup
from millrace.llm.common import removed, shared_folder
from millrace.llm.queries import language_model, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a language's centroids stay; where the language is missing it is filled in."""
    out = language_id.identified(docs, language_model(docs), names=("lang_pred", "lang_score", "lang_rejected"))
    return out.filter(~F.col("lang_rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest id."""
    return near_dedup.classed(docs).filter("is_kept").select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id has are cut out."""
    out = suffix_dedup.deduplicated(docs, as_text=True)
    size = F.length("kept_text").cast("long").alias("n_chars")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark."""
    out = secrets.found(docs, secrets.fitted(secrets.labelled_tokens(docs)))
    out = out.withColumn("text", secrets.redacted(F.col("text"), F.col("all_spans")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 4096 tokens."""
    return packing.in_sequences(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("repeated passages", passages),
    ("secrets", without_secrets),
    ("packing", sequences),
]
#: Nearest centroids, near-duplicate classes and Markov models are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The stages before it are written to the session's shared checkpoint folder, each until the next one is."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
