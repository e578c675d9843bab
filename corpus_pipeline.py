"""The training-data pipeline: language ID, MinHash near-dedup, benchmark decontamination, PII, packing.

Each stage takes all rows that the one before kept, written as Parquet and read again, and but for the last returns the columns of ``documents``. A
document goes if its language is rejected, if it is not the one of its group that stays, or if it holds a benchmark passage; personal data are
replaced in its text (and ``n_chars`` follows); packing returns the place of each piece of each document that is left.

Defined cases are those of the operators; rows with a null doc_id are kept by near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.llm import decontamination, langid, minhash, packing, pii
from quillstone.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, n_entities, n_terms = pii.sanitize_rows(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop(n_entities, n_terms)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate), ("pii", sanitise), ("packing", pack)]
ORACLE_SQL = None  # training, signatures and least squares are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
