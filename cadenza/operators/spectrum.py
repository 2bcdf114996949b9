"""Spectral frames: log-spaced bands, band energies, peak-hold roll-ups and range queries; the STFT itself is a numpy kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pcm import div

FFT, HOP, BANDS = 1024, 512, 64
REFERENCE = (32768.0 * 512.0) ** 2


def band_edges(spark: SparkSession, rate: int, bands: int = BANDS, low: int = 40, high: int = 16000) -> DataFrame:
    """band, k0, k1: inclusive bins of each log-spaced band, within 1 to 511; no rows for settings that make no sense."""
    high = min(high, rate // 2)
    if rate <= 0 or low <= 0 or bands <= 0 or high <= low:
        return spark.createDataFrame([], "band long, k0 long, k1 long")
    bands = min(bands, 64)
    edge = lambda b: low * F.pow(F.lit(high / low), b / bands)
    b = F.col("id").cast("double")
    k0 = F.least(F.greatest(F.floor(edge(b) / (rate / 1024.0)), F.lit(1)), F.lit(511))
    k1 = F.least(F.greatest(F.ceil(edge(b + 1) / (rate / 1024.0)), F.lit(1)), F.lit(511))
    return spark.range(bands).select(F.col("id").alias("band"), k0.cast("long").alias("k0"), F.greatest(k1, k0).cast("long").alias("k1"))


def to_level(energy, reference: float = REFERENCE):
    """Energy to 0-255: -96 to 0 dB of the reference."""
    db = 10 * F.log10(energy / reference + 1e-10)
    return F.least(F.greatest((db + 96) * (255.0 / 96), F.lit(0.0)), F.lit(255.0)).cast("int")


def band_energy(magnitudes: DataFrame, edges: DataFrame, reference: float = REFERENCE) -> DataFrame:
    """stream_id, frame_no, band, energy, level of magnitudes(stream_id, frame_no, magnitudes): inclusive sums per band.

    edges has at most 64 rows by construction: they become one array expression, so a frame stays one row until its bands are made.
    """
    bands = edges.agg(F.sort_array(F.collect_list(F.struct("band", "k0", "k1"))).alias("edges"))

    def energies(edge):
        part = F.slice("magnitudes", (edge["k0"] + 1).cast("int"), (edge["k1"] - edge["k0"] + 1).cast("int"))
        return F.struct(edge["band"].alias("band"), F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x).alias("energy"))

    rows = magnitudes.crossJoin(F.broadcast(bands)).select("stream_id", "frame_no", F.explode(F.transform("edges", energies)).alias("b"))
    return rows.select("stream_id", "frame_no", "b.band", "b.energy", to_level(F.col("b.energy"), reference).alias("level"))


def pick_level(duration_ms: int, columns: int, frames: list[int]) -> int:
    """The level that a range query of so many columns reads, of levels with so many frames: the coarse one from 90 ms a column on, if it has frames."""
    return int(len(frames) > 1 and columns > 0 and frames[1] > 0 and duration_ms / columns >= 90)


def range_query_of(levels: list[DataFrame], start_ms: int, duration_ms: int, columns: int, frame_ms: float, ratio: int = 16) -> DataFrame:
    """range_query on the level that its resolution asks for; levels has the frames and their peak hold over ratio frames."""
    level = pick_level(duration_ms, columns, [1] * len(levels))
    return range_query(levels[level], start_ms, duration_ms, columns, frame_ms * ratio**level)


def peak_hold(frames: DataFrame, ratio: int = 16, bands: int = BANDS) -> DataFrame:
    """stream_id, frame_no, bands: element-wise maxima of ratio frames (the last group may be partial), one partial aggregate."""
    tops = F.array(*[F.max(F.col("bands")[k]) for k in range(bands)])
    return frames.groupBy("stream_id", div("frame_no", ratio).alias("frame_no")).agg(tops.alias("bands"))


def long_form(frames: DataFrame) -> DataFrame:
    return frames.select("stream_id", "frame_no", F.posexplode("bands").alias("band", "value"))


def range_query(frames: DataFrame, start_ms: int, duration_ms: int, columns: int, frame_ms: float) -> DataFrame:
    """stream_id, column, bands: maxima over the inclusive frames of each column; no interpolation. Duration is cut at the end."""
    total = frames.groupBy("stream_id").agg(F.count("*").alias("frames")).withColumn("end_ms", F.col("frames") * frame_ms)
    ok = total.where(F.lit(start_ms) < F.col("end_ms")) if duration_ms > 0 and columns > 0 else total.limit(0)
    span = F.least(F.lit(float(duration_ms)), F.col("end_ms") - start_ms)
    at = ok.select("stream_id", "frames", span.alias("span"), F.explode(F.sequence(F.lit(0), F.lit(max(columns, 1) - 1))).alias("column"))
    edge = lambda c: F.floor((start_ms + c / columns * F.col("span")) / frame_ms)
    f0 = F.least(edge(F.col("column")), F.col("frames") - 1)
    f1 = F.greatest(F.least(edge(F.col("column") + 1), F.col("frames") - 1), f0)
    rows = at.select("stream_id", "column", F.explode(F.sequence(f0, f1)).alias("frame_no"))
    return rows.join(frames, ["stream_id", "frame_no"]).groupBy("stream_id", "column").agg(F.array(*[F.max(F.col("bands")[k]) for k in range(BANDS)]).alias("bands"))


def hann() -> np.ndarray:
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(FFT) / (FFT - 1)))
    return (w * 32767).astype(np.int64)


def magnitudes(windows: np.ndarray) -> np.ndarray:
    """Magnitudes of the first 512 bins of windows of 1024 integer samples."""
    return np.abs(np.fft.rfft(windows.astype(np.float64), axis=-1))[..., :512]


def numpy_edges(rate: int, bands: int = BANDS, low: int = 40, high: int = 16000) -> np.ndarray:
    high = min(high, rate // 2)
    f = low * (high / low) ** (np.arange(bands + 1) / bands)
    k0 = np.clip(np.floor(f[:-1] / (rate / 1024.0)), 1, 511).astype(int)
    return np.stack([k0, np.maximum(np.clip(np.ceil(f[1:] / (rate / 1024.0)), 1, 511).astype(int), k0)], axis=1)


def stft_frames(samples: np.ndarray, rate: int, bands: int = BANDS, backend: Callable[[np.ndarray], np.ndarray] = magnitudes) -> np.ndarray:
    """Frames (ceil(n / 512) x bands) of one stream: the hop before and the hop itself, the first preceded by zeros."""
    hops = -(-len(samples) // HOP)
    padded = np.concatenate([np.zeros(HOP, dtype=np.int64), samples.astype(np.int64), np.zeros(hops * HOP - len(samples), dtype=np.int64)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, FFT)[::HOP] if hops else np.zeros((0, FFT), dtype=np.int64)
    power = np.concatenate([np.zeros((hops, 1)), np.cumsum(backend((windows * hann()) >> 15) ** 2, axis=1)], axis=1)
    e = numpy_edges(rate, bands)
    db = 10 * np.log10((power[:, e[:, 1] + 1] - power[:, e[:, 0]]) / REFERENCE + 1e-10)
    return np.clip((db + 96) * (255 / 96), 0, 255).astype(np.int64)


def stft(blocks: DataFrame, rate: int, bands: int = BANDS) -> DataFrame:
    """stream_id, frame_no, bands of blocks(stream_id, block_no, samples): samples of a block are a whole number of hops, but in the last.

    Each block gets the hop before it from its neighbour, so blocks are transformed in parallel and no stream is gathered.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("block_no")
    tail = F.slice("samples", -HOP, HOP)
    first = F.coalesce(F.sum(F.ceil(F.size("samples") / HOP)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    b = blocks.select("stream_id", "samples", F.lag(tail).over(w).alias("before"), first.alias("first"))

    key = blocks.schema["stream_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sid, samples, before, at in zip(f["stream_id"], f["samples"], f["before"], f["first"]):
                x = np.asarray(samples)
                out = stft_frames(x, rate, bands) if before is None else stft_frames(np.concatenate([before, x]), rate, bands)[1:]
                yield pd.DataFrame({"stream_id": sid, "frame_no": at + np.arange(len(out)), "bands": list(out.astype(np.int32))})

    return b.mapInPandas(run, f"stream_id {key}, frame_no long, bands array<int>")
