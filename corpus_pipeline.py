"""Documents to packed sequences: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all rows its predecessor kept, which are written as Parquet and read again, and all but the
last give the columns of documents: failing texts go, one document of each near-duplicate group stays, texts
that hold benchmark items go, secrets are masked in place, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import common, decontam, near_dups, packing, quality, secrets
from meridian.llm.tokens import public_path

#: Pieces whose ids a worker keeps: fewer than op9_packing's, as executors that have run the other stages have less room.
PIECES = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=1, cache=PIECES).drop("cost")


STAGES = [
    ("quality", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masks),
    ("packing", packed),
]

#: Suffix arrays, BM25 search and tokenizers are beyond SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            common.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
