"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, table, written
from .minhash import BROADCAST_IDS
from .queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with all their columns. Null and empty texts go, as they have too few words; rows that repeat an id are each judged."""
    from .quality_rules import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def _with_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs whose id and text hash are among keys (_id, _same), or aren't (left_semi, left_anti); keys go to the texts if they are few, else texts are shuffled."""
    same = docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == keys["_same"])
    return docs.join(F.broadcast(keys) if fits(keys, BROADCAST_IDS) else keys, same, how)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Five words, a similarity of 0.8 or more.

    Texts that are null, empty or without words stay. Rows without an id leave if a near copy has one; of rows that repeat both id
    and text one stays. Other columns are kept as they are.
    """
    from .minhash import near_duplicates

    leading = written(near_duplicates(docs, size=5, percent=80).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_same")), "leading")
    kept = _with_keys(docs, leading.distinct(), "left_semi")
    # Rows that repeat a leading id with the same text are copies too.
    return kept if leading.groupBy("_id", "_same").count().where("count > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark. Null and empty texts stay; rows that share an id are judged by their own texts."""
    from .decontamination import found_items, keyed

    bad = found_items(keyed(docs), table(spark, sf_dir, "benchmark")).where(F.size("items") > 0).select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("_id"), F.col("same").alias("_same"))
    return _with_keys(docs, written(bad, "bad"), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts (in decoded layers too) replaced by a mark; null texts stay null."""
    from .secrets import redact

    return redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of all documents; a null or empty text has no ids."""
    from .bpe import bpe_ids

    return bpe_ids(docs, tokenizer_path("word_bpe_49k.json"))
