"""Block switching of a transform coder: attacks in sub-blocks, and the sequence of window shapes they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pcm import div
from .folds import folded

#: Window shapes.
LONG, START, SHORT, STOP = range(4)
SUBBLOCKS = 8


def subblock_energies(samples: DataFrame, size: int = 256, alpha: float = 0.95) -> DataFrame:
    """stream_id, sub, energy: sums of squared (x - alpha * previous x) over sub-blocks of samples(stream_id, n, x), each by itself; whole ones only."""
    s = samples.select("stream_id", div("n", size).alias("sub"), "n", "x")
    w = Window.partitionBy("stream_id", "sub").orderBy("n")
    d = s.withColumn("d", F.col("x") - alpha * F.coalesce(F.lag("x").over(w), F.lit(0.0)))
    return d.groupBy("stream_id", "sub").agg(F.sum(F.col("d") * F.col("d")).alias("energy"), F.count("*").alias("size")).where(F.col("size") == size).drop("size")


def attacks(energies: DataFrame, ratio: float = 8.0) -> DataFrame:
    """stream_id, frame_no, attack: frames of eight sub-blocks, four apart; an energy far above what comes before it is an attack.

    A sub-block lies in two frames at most, so frames are made by an explode of two rows.
    """
    last = div("sub", SUBBLOCKS // 2)
    e = energies.select("stream_id", "sub", "energy", F.explode(F.array(last, last - 1)).alias("frame_no")).where("frame_no >= 0")
    e = e.withColumn("b", F.col("sub") - F.col("frame_no") * (SUBBLOCKS // 2))
    w = Window.partitionBy("stream_id", "frame_no").orderBy("b")
    sums = F.sum(F.when(F.col("b") == 0, F.greatest("energy", F.lit(1e-5))).otherwise(F.col("energy"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    loud = F.greatest(F.lag("energy").over(w), sums / F.col("b"), F.lit(1e-4))
    e = e.withColumn("jump", (F.col("b") > 0) & (F.col("energy") > 1e-3) & (F.col("energy") > ratio * loud))
    frames = e.groupBy("stream_id", "frame_no").agg(F.max("jump").alias("jump"), F.count("*").alias("n"), F.min_by("energy", "b").alias("first"), F.max_by("energy", "b").alias("last")).where(F.col("n") == SUBBLOCKS)
    before = F.coalesce(F.lag("last").over(Window.partitionBy("stream_id").orderBy("frame_no")), F.lit(0.0))
    f = frames.withColumn("before", before)
    return f.select("stream_id", "frame_no", (F.col("jump") | ((F.col("before") > 1e-4) & (F.col("first") > ratio * F.col("before")) & (F.col("first") > 1e-3))).alias("attack"))


def window_sequence(frames: DataFrame) -> DataFrame:
    """stream_id, frame_no, shape: a start shape leads to short blocks, which last while there are attacks; a stop shape leads back.

    The shape depends on the one before, so a stream is one ordered fold.
    """

    def start():
        now = [LONG]

        def step(frame_no: int, attack: bool) -> list[tuple]:
            if now[0] == START or now[0] == SHORT and attack:
                now[0] = SHORT
            elif now[0] == SHORT:
                now[0] = STOP
            else:
                now[0] = START if attack else LONG
            return [(frame_no, now[0])]

        return step

    return folded(frames, ["frame_no"], ["frame_no", "attack"], start, "frame_no long, shape int")
