"""A Spark session with the settings this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cadenza", **conf: str) -> SparkSession:
    """getOrCreate with UTC, adaptive execution and Arrow; conf overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
