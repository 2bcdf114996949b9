"""Connected components of a link table, by min labels and pointer jumping; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """node, label (the smallest node of its component) for the nodes of links (a, b); link rows may repeat.

    Each round takes the least label among neighbours and then the label of that label, so the distance covered doubles; a
    round's labels are written to the shared folder.
    """
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).where("node != other").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fresh = written(stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), name)
        # A round reads the one before only.
        discard(labels)
        labels = fresh
        if fresh.where("label != old").isEmpty():
            discard(both)
            return fresh.select("node", "label")
