"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintflow.llm.common import fold, free_name
from stintflow.llm.decontaminate import without_leaks
from stintflow.llm.packing import pack_documents
from stintflow.llm.pii import pseudonymise, session_key
from stintflow.llm.simhash import keep_one
from stintflow.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, doesn't reject."""
    return without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: that of the smallest doc_id."""
    return keep_one(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms; n_chars follows the text where it changed."""
    if "n_chars" not in docs.columns:
        return pseudonymise(docs, session_key(spark))
    old = free_name(docs, "old_length")
    out = pseudonymise(docs.withColumn(old, F.length("text")), session_key(spark))
    grown = F.col("n_chars") + F.coalesce(F.length("text") - F.col(old), F.lit(0))
    return out.withColumn("n_chars", grown.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    return pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: No SQL: models, fingerprints' components and tokenizers are beyond it. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = fold(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
