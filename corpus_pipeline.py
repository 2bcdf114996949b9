"""A training-data pipeline over documents: quality rules, near-duplicates, decontamination, secrets, BPE.

Each stage's result is written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import stages
from cadenza.llm.common import table, written

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("minhash_dedup", stages.minhash_dedup),
    ("decontamination", stages.decontamination),
    ("secret_scan", stages.secret_scan),
    ("bpe", stages.bpe),
]

#: Binomial cutoffs, MinHash components and merges aren't expressible in SQL: tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
