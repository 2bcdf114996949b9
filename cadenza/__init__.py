"""cadenza: Spark-first analytics over sampled time series and audio containers."""

__version__ = "0.1.0"
