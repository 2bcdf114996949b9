"""Driver tables shaped as time series, each with the SQL text that gives the same rows.

series(stream_id, n, v): events per user, integer samples in order of (ts, event_id).
items(stream_id, n, v, qty): lineitem per supplier, integer prices in a total order.
frames(stream_id, frame_no, bands): embeddings per label, 64 bands quantised to 0-255.
packets(stream_id, n, size): orders per customer, price as a packet size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return e.select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("n"), ((F.col("value") * 100).cast("long") - 2000).alias("v"))


SERIES = """series AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(trunc(value * 100) AS BIGINT) - 2000 AS v FROM events
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return i.select(F.col("l_suppkey").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("n"), F.col("l_extendedprice").cast("long").alias("v"), F.col("l_quantity").cast("long").alias("qty"))


ITEMS = """items AS (
  SELECT l_suppkey AS stream_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n,
    CAST(trunc(l_extendedprice) AS BIGINT) AS v, CAST(trunc(l_quantity) AS BIGINT) AS qty FROM lineitem
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    quantised = F.transform("embedding", lambda x: F.least(F.greatest((x.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0)).cast("int"))
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_no"), quantised.alias("bands"))


FRAMES = """frames AS (
  SELECT CAST(label AS BIGINT) AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no,
    list_transform(embedding, lambda x: CAST(trunc(least(greatest((CAST(x AS DOUBLE) + 1) * 127.5, 0.0), 255.0)) AS INTEGER)) AS bands FROM embeddings
)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.select(F.col("o_custkey").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("n"), F.call_function("div", F.col("o_totalprice").cast("long"), F.lit(100).cast("long")).alias("size"))


PACKETS = """packets AS (
  SELECT o_custkey AS stream_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, CAST(trunc(o_totalprice) AS BIGINT) // 100 AS size FROM orders
)"""
