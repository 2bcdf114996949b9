"""Min/max envelope pyramid: chunks of samples, roll-ups by 16, and range queries that pick a level.

Generated minima and maxima start from 0 (so min <= 0 <= max); range queries take the plain extremes of what is stored.
Aggregates are decomposable, so Spark combines them before the shuffle and each level reuses the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pcm import div, scale_i8

CHUNK, RATIO = 128, 16


def level0(samples: DataFrame, chunk: int = CHUNK, shift: int = 8, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """samples(stream_id, n, columns...) to stream_id, chunk_no, <c>_min, <c>_max; the last chunk may be partial."""
    parts = [e for c in columns for e in (F.least(F.min(scale_i8(F.col(c), shift)), F.lit(0)).alias(f"{c}_min"), F.greatest(F.max(scale_i8(F.col(c), shift)), F.lit(0)).alias(f"{c}_max"))]
    return samples.groupBy("stream_id", div("n", chunk).alias("chunk_no")).agg(*parts)


def roll_up(envelope: DataFrame, ratio: int = RATIO) -> DataFrame:
    """The next level: extremes of ratio chunks, the last group may be partial."""
    values = [c for c in envelope.columns if c not in ("stream_id", "chunk_no")]
    return envelope.groupBy("stream_id", div("chunk_no", ratio).alias("chunk_no")).agg(*((F.min if c.endswith("_min") else F.max)(c).alias(c) for c in values))


def pyramid(samples: DataFrame, chunk: int = CHUNK, shift: int = 8, columns: tuple[str, ...] = ("v",), levels: int = 3) -> list[DataFrame]:
    out = [level0(samples, chunk, shift, columns)]
    for _ in range(levels - 1):
        out.append(roll_up(out[-1]))
    return out


def pick_level(ms_per_point: Column, chunk_ms: float, counts: list[Column]) -> Column:
    """The coarsest level whose chunks are no longer than a point, among those with chunks."""
    out = F.lit(0)
    for k in range(1, len(counts)):
        out = F.when((ms_per_point >= chunk_ms * RATIO**k) & (counts[k] > 0), k).otherwise(out)
    return out


def streams_of(samples: DataFrame, rate: int) -> DataFrame:
    """stream_id, frames, duration_ms."""
    return samples.groupBy("stream_id").agg(F.count("*").alias("frames")).withColumn("duration_ms", div(F.col("frames") * 1000, rate))


def points(streams: DataFrame, start_ms: int, n_points: int, chunk_ms: float, duration_ms: Column) -> DataFrame:
    """Points of a range query: stream_id, point, chunks, and from and step in chunks; none where the start is past the end."""
    chunks = F.ceil(F.col("duration_ms") / chunk_ms).cast("long")
    step = duration_ms / chunk_ms / n_points
    p = streams.where((F.col("duration_ms") > 0) & (duration_ms > 0) & (F.lit(start_ms) < F.col("duration_ms")))
    return p.select("stream_id", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point"), chunks.alias("chunks"), step.alias("step"), F.lit(start_ms / chunk_ms).alias("start"))


def overview(envelope: DataFrame, at: DataFrame) -> DataFrame:
    """Extremes over the chunks of each point, both ends included (neighbours share one). A range becomes rows of an equi-join."""
    last = F.col("chunks") - 1
    c0 = F.least(F.floor(F.col("start") + F.col("point") * F.col("step")), last)
    c1 = F.greatest(F.least(F.floor(F.col("start") + (F.col("point") + 1) * F.col("step")), last), c0)
    rows = at.where("step >= 1").select("stream_id", "point", F.explode(F.sequence(c0, c1)).alias("chunk_no"))
    values = [c for c in envelope.columns if c not in ("stream_id", "chunk_no")]
    return rows.join(envelope, ["stream_id", "chunk_no"]).groupBy("stream_id", "point").agg(*((F.min if c.endswith("_min") else F.max)(c).alias(c) for c in values))


def zoom(envelope: DataFrame, at: DataFrame) -> DataFrame:
    """Values between neighbouring chunks, rounded half away from zero, min held at most max; for points closer than chunks."""
    place = F.col("start") + F.col("point") * F.col("step")
    last = F.col("chunks") - 1
    rows = at.where("step < 1").select("stream_id", "point", (place - F.floor(place)).alias("alpha"), F.least(F.floor(place), last).alias("c0"), F.least(F.floor(place) + 1, last).alias("c1"))
    values = [c for c in envelope.columns if c not in ("stream_id", "chunk_no")]
    e0 = envelope.select("stream_id", F.col("chunk_no").alias("c0"), *(F.col(c).alias(f"{c}_0") for c in values))
    e1 = envelope.select("stream_id", F.col("chunk_no").alias("c1"), *(F.col(c).alias(f"{c}_1") for c in values))
    between = lambda c: F.round((1 - F.col("alpha")) * F.col(f"{c}_0") + F.col("alpha") * F.col(f"{c}_1")).cast("long")
    joined = rows.join(e0, ["stream_id", "c0"]).join(e1, ["stream_id", "c1"])
    out = [F.least(between(c), between(c[:-3] + "max")).alias(c) if c.endswith("_min") else between(c).alias(c) for c in values]
    return joined.select("stream_id", "point", *out)


def to_mono(envelope: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    return envelope.select("stream_id", "chunk_no", F.least(f"{left}_min", f"{right}_min").alias("v_min"), F.greatest(f"{left}_max", f"{right}_max").alias("v_max"))


def to_stereo(envelope: DataFrame, column: str = "v") -> DataFrame:
    return envelope.select("stream_id", "chunk_no", *(F.col(f"{column}_{k}").alias(f"{side}_{k}") for side in ("l", "r") for k in ("min", "max")))
