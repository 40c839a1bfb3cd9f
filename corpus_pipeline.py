"""The corpus pipeline: five stages over ``documents``, each a function of (spark, docs, sf_dir) that returns a DataFrame.

Each stage but the last returns the columns of its input, whatever they are and whatever their names. Between the stages the rows
are written as Parquet and read again. An empty table gives no rows at every stage; null texts are empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernway.llm.decontam import decontaminate, is_contaminated
from fernway.llm.packing import pack
from fernway.llm.quality import judge
from fernway.llm.secrets import scan_secrets
from fernway.llm.simhash import deduplicated
from fernway.operators.rounds import remove, shared_path, written_at


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and short texts go; rows that repeat are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, then the smallest hash of its text.

    Null ids come last; of rows alike in id and text one stays, whatever their other columns say; texts without words are one group.
    """
    return deduplicated(docs).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark passages; those without words stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).where(~is_contaminated()).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets; n_chars, if there, counts the new text. Null texts stay null."""
    clean = scan_secrets(docs, redact=True)
    if "n_chars" in docs.columns:
        changed = F.size("secrets") > 0
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they lie in; a null text gives its end token alone."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Neither the hashed ratios, the fingerprints nor the tokens can be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's output is deleted when the next one's is written, but for what the last reads."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        docs = written_at(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
