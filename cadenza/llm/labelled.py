"""Bounded labelled samples for the classifiers, and the fold that is held out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of each class a classifier is fitted on at most (those with the smallest hashed ids), and the longest text among them, in characters.
SAMPLE_ROWS, SAMPLE_CHARACTERS = 3_000, 20_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of rows that may be learned from; of contradicting labels the greater holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id")))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, characters: int = SAMPLE_CHARACTERS, *more: str) -> tuple[pd.DataFrame, dict[int, int]]:
    """A bounded sample (text, label and the columns more) of the training rows, in a fixed order, and the number of rows by label.

    docs has doc_id, text (not null) and the columns more. The sample has at most rows of each label, of at most so many characters
    each, drawn by hashed id from the labelled rows that docs has; labels of absent or longer documents don't count.
    """
    there = docs.where(F.length("text") <= characters).select("doc_id").distinct()
    known = written(training_rows(labels, label).join(there, "doc_id", "left_semi"), "labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # Ids are drawn below a hash bound before any is sorted or looked up, half as many again as asked for, so few rows move.
    order = F.xxhash64("doc_id", F.lit(17))
    below = lambda x: min(1.0, (1.5 * rows + 100) / max(1, sizes.get(x, 0)))
    drawn = known.where(F.pmod(order, F.lit(1 << 20)) < F.when(F.col("label") == 1, below(1)).otherwise(below(0)) * (1 << 20))
    chosen = [drawn.where(F.col("label") == x).orderBy(order, "doc_id").limit(rows) for x in (0, 1)]
    # Bounded by 2 * rows ids, whatever the tables' size.
    found = docs.where(F.length("text") <= characters).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("text", *more)).alias("x")).select("doc_id", "label", "x.*", order.alias("order"))
    return one.toPandas().sort_values(["order", "doc_id"]).reset_index(drop=True), sizes


def sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def auc(score, label) -> float:
    """Area under the ROC curve, ties by half; for tests and figures."""
    import numpy as np

    score, label = np.asarray(score, dtype=float), np.asarray(label)
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    s = score[order]
    first = np.searchsorted(s, s, "left")
    last = np.searchsorted(s, s, "right")
    ranks[order] = (first + last + 1) / 2
    n1 = (label == 1).sum()
    n0 = len(label) - n1
    return float((ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n0 and n1 else 0.5
