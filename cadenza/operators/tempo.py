"""Novelty, tempo estimates, tempo curve, beat grid, and queries of musical time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded

LAGS = (21, 89)
WINDOW, LEAST_SAMPLES = 512, 178
BASS, SNARE, HIGH = (0, 15), (16, 42), (43, 63)


def _order(df_key: str = "frame_no") -> Window:
    return Window.partitionBy("stream_id").orderBy(df_key)


def flux(frames: DataFrame) -> DataFrame:
    """stream_id, frame_no, bass, snare, high, raw: rises against the previous frame by sub-band (the first frame: 0)."""
    before = F.lag("bands").over(_order())
    rise = F.zip_with("bands", F.coalesce(before, F.col("bands")), lambda a, b: F.greatest(a - b, F.lit(0)))
    f = frames.select("stream_id", "frame_no", rise.alias("rise"))
    part = lambda span: F.aggregate(F.slice("rise", span[0] + 1, span[1] - span[0] + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    f = f.select("stream_id", "frame_no", part(BASS).alias("bass"), part(SNARE).alias("snare"), part(HIGH).alias("high"))
    return f.withColumn("raw", F.col("bass") + 0.8 * F.col("snare") + 0.2 * F.col("high"))


def novelty(frames: DataFrame) -> DataFrame:
    """flux with novelty: raw less the mean of the last nine raw values, this one included, not below 0."""
    mean = F.avg("raw").over(_order().rowsBetween(-8, 0))
    return flux(frames).withColumn("novelty", F.greatest(F.col("raw") - mean, F.lit(0.0)))


def prior(lag: Column, frame_rate: float) -> Column:
    octaves = F.log2(60.0 * frame_rate / lag / 120.0)
    return F.exp(-(octaves * octaves) / (2 * 0.8 * 0.8))


def estimate(recent: DataFrame, frame_rate: float) -> DataFrame:
    """stream_id, lag, bpm, confidence from recent(stream_id, x): the last WINDOW novelty values, oldest first, fewer at the start.

    Autocorrelation at a lag, twice and four times it, weighted by a prior around 120 BPM; the first best lag, refined by a
    parabola. The sums are numpy products over the arrays of a batch of streams, WINDOW values at most each.
    """
    key = recent.schema["stream_id"].dataType.simpleString()
    lags = np.arange(LAGS[0], LAGS[1] + 1)

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("x")
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                x = np.zeros((len(sizes), WINDOW))
                ends = np.cumsum(sizes)
                x[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[-1]) - np.repeat(ends - WINDOW, sizes)] = lists.flatten().to_numpy()
                r = {t: (x[:, : WINDOW - t] * x[:, t:]).sum(axis=1) for t in sorted({int(t) for m in (1, 2, 4) for t in m * lags if t < WINDOW})}
                none = np.zeros(len(sizes))
                columns = [np.stack([r.get(int(m * t), none) for t in lags], axis=1).ravel() for m in (1, 2, 4)]
                repeated = batch.select(["stream_id"]).take(pa.array(np.repeat(np.arange(len(sizes)), len(lags))))
                yield pa.RecordBatch.from_arrays([repeated.column(0), pa.array(np.repeat(sizes, len(lags)).astype(np.int32)), pa.array(np.tile(lags, len(sizes)).astype(np.int32)), *map(pa.array, columns)], ["stream_id", "count", "lag", "r1", "r2", "r4"])

    rows = recent.where(F.size("x") > 0).mapInArrow(correlate, f"stream_id {key}, count int, lag int, r1 double, r2 double, r4 double")
    score = (F.col("r1") + 0.5 * F.col("r2") + 0.25 * F.col("r4")) * prior(F.col("lag").cast("double"), frame_rate)
    rows = rows.select("stream_id", "count", "lag", F.round(score, 6).alias("score"))
    w = Window.partitionBy("stream_id").orderBy("lag")
    rows = rows.withColumn("prev", F.lag("score").over(w)).withColumn("next", F.lead("score").over(w))
    best = rows.groupBy("stream_id").agg(F.max("count").alias("count"), F.max(F.struct("score", (-F.col("lag")).alias("minus"), "prev", "next")).alias("b"), F.avg("score").alias("mean"))
    lag, cur = -F.col("b.minus"), F.col("b.score")
    curve = 2 * (F.col("b.prev") - 2 * cur + F.col("b.next"))
    delta = (F.col("b.prev") - F.col("b.next")) / F.when(F.abs(curve) > 1e-6, curve)
    fine = lag + F.when(F.abs(delta) <= 1, delta).otherwise(0.0)
    enough = F.col("count") >= LEAST_SAMPLES
    ratio = F.when(cur > F.col("mean"), (cur - F.col("mean")) / (cur + 1e-4)).otherwise(0.0)
    return best.select(
        "stream_id",
        F.when(enough, fine).otherwise(43.0).alias("lag"),
        F.when(enough, 60.0 * frame_rate / fine).otherwise(120.0).alias("bpm"),
        F.when(enough, F.least(F.greatest(ratio * 255, F.lit(0.0)), F.lit(255.0)).cast("int")).otherwise(0).alias("confidence"),
    )


def recent_novelty(nov: DataFrame, size: int = WINDOW) -> DataFrame:
    """stream_id, x: the last values of each stream, in order; at most size of them leave a window."""
    w = Window.partitionBy("stream_id").orderBy(F.desc("frame_no"))
    last = nov.withColumn("back", F.row_number().over(w)).where(F.col("back") <= size)
    return last.groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_no", "novelty"))), lambda s: s["novelty"]).alias("x"))


def curve_points(estimates: DataFrame, drift: float) -> DataFrame:
    """stream_id, n, bpm: the first estimate, and each that differs from the last kept one by drift or more.

    What is kept decides what comes next, so a stream is one ordered fold.
    """

    def start():
        kept: list[float] = []

        def step(n: int, bpm: float) -> list[tuple]:
            if kept and abs(bpm - kept[0]) < drift:
                return []
            kept[:] = [bpm]
            return [(n, bpm)]

        return step

    return folded(estimates.where("bpm IS NOT NULL").withColumn("bpm", F.col("bpm").cast("double")), ["n"], ["n", "bpm"], start, "n long, bpm double")


#: A tempo curve is estimated every so many frames, from so many on, and by estimates of more confidence only.
EVERY, FIRST_FRAME, CONFIDENT = 64, 256, 50
#: Frames of a stream that a task estimates at a time, and the EVERY-frame chunks that it holds in one array.
BLOCK, CHUNKS = 4096, 1024


def _window_products(x: np.ndarray, starts: np.ndarray, lag: int) -> np.ndarray:
    """Sums of x[i] * x[i + lag] within the windows of WINDOW values from chunks starts on; x has whole chunks and WINDOW values of padding.

    Products are summed by chunk once for all the windows that share a chunk.
    """
    n = len(x) - WINDOW
    a, b = x[:n].reshape(-1, EVERY), x[lag : lag + n].reshape(-1, EVERY)
    whole, left = divmod(WINDOW - lag, EVERY)
    chunks = np.vecdot(a, b)
    size = max(0, len(chunks) - whole - (left > 0) + 1)
    sums = chunks[:size].copy()
    for k in range(1, whole):
        sums += chunks[k : k + size]
    if left:
        sums += np.einsum("ij,ij->i", a[whole:, :left], b[whole:, :left])[:size]
    return sums[starts]


def _confident(x: np.ndarray, starts: np.ndarray, frame_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the estimates over the windows from chunks starts on are confident, and their bpm: the rules of `estimate`, in numpy."""
    lags = np.arange(LAGS[0], LAGS[1] + 1)
    octaves = [math.log(60.0 * frame_rate / lag / 120.0) / math.log(2.0) for lag in lags.tolist()]
    weights = [math.exp(-(o * o) / (2 * 0.8 * 0.8)) for o in octaves]
    r = {t: _window_products(x, starts, t) for t in sorted({int(m * t) for m in (1, 2, 4) for t in lags})}
    score = np.stack([(r[t] + 0.5 * r[2 * t] + 0.25 * r[4 * t]) * weight for t, weight in zip(lags.tolist(), weights)])
    size = np.abs(score)
    rounded = np.copysign(np.floor(size * 1e6 + 0.5) / 1e6, score)
    score = rounded if (size < 1 << 32).all() else np.where(size < 1 << 32, rounded, score)
    best, each = score.argmax(axis=0), np.arange(len(starts))
    cur, mean = score[best, each], np.add.accumulate(score)[-1] / len(lags)
    inside = (best > 0) & (best < len(lags) - 1)
    prev, following = score[np.maximum(best - 1, 0), each], score[np.minimum(best + 1, len(lags) - 1), each]
    bend = 2 * (prev - 2 * cur + following)
    bent = inside & (np.abs(bend) > 1e-6)
    delta = np.where(bent, (prev - following) / np.where(bent, bend, 1.0), 0.0)
    fine = lags[best] + np.where(np.abs(delta) <= 1, delta, 0.0)
    ratio = np.where(cur > mean, (cur - mean) / (cur + 1e-4), 0.0)
    return np.floor(np.clip(ratio * 255, 0.0, 255.0)) > CONFIDENT, 60.0 * frame_rate / fine


def _block_estimates(block: np.ndarray, begins: np.ndarray, frame: np.ndarray, value: np.ndarray, frame_rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, frame and bpm of the confident estimates of blocks, whose frames stand in a row from begins on, in order."""
    last = frame[np.append(begins[1:], len(frame)) - 1]
    low = np.maximum(block * BLOCK, FIRST_FRAME) - WINDOW
    # Windows go on as long as they hold a frame: whether the stream does is seen when all its blocks are known.
    chunks = np.maximum(np.minimum((last - low) // EVERY + WINDOW // EVERY, ((block + 1) * BLOCK - low) // EVERY - 1), 0)
    counts = np.maximum(chunks - WINDOW // EVERY + 1, 0)
    at = np.cumsum(chunks) - chunks
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(frame))))
    place = frame - low[of]
    held = (place >= 0) & (place < chunks[of] * EVERY)
    x = np.zeros(int(chunks.sum()) * EVERY + WINDOW)
    x[(at[of] * EVERY + place)[held]] = value[held]
    made = np.repeat(np.arange(len(begins)), counts)
    nth = np.arange(len(made)) - np.repeat(np.cumsum(counts) - counts, counts)
    sure, bpm = _confident(x, at[made] + nth, frame_rate)
    return made[sure], (low[made] + nth * EVERY + WINDOW)[sure], bpm[sure]


def _curve_estimates(nov: DataFrame, frame_rate: float) -> DataFrame:
    """stream_id, n, bpm: the confident estimates at frames n of each stream, some of them after its end, and the last frame of each block, without bpm."""
    to = lambda frames: F.floor(frames / BLOCK)
    rows = nov.select("stream_id", F.col("frame_no").cast("long").alias("frame_no"), F.col("novelty").cast("double").alias("novelty"))
    # A frame goes to its own block, and to the next one if that one's windows hold it.
    rows = rows.withColumn("block", F.explode(F.sequence(to(F.col("frame_no")), to(F.col("frame_no") + WINDOW))))
    dealt = rows.repartition("stream_id", "block").sortWithinPartitions("stream_id", "block", "frame_no", "novelty")

    def blocks(whole: pa.RecordBatch, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        frame, value, block = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("frame_no", "novelty", "block"))
        ends = np.append(begins[1:], whole.num_rows)
        step = CHUNKS * EVERY // (BLOCK + WINDOW)
        for k in range(0, len(begins), step):
            b, e = begins[k : k + step], ends[k : k + step]
            of, n, bpm = _block_estimates(block[b], b - b[0], frame[b[0] : e[-1]], value[b[0] : e[-1]], frame_rate)
            own = frame[e - 1] >= block[b] * BLOCK
            keys = whole.column("stream_id").take(pa.array(np.concatenate([b[of], b[own]])))
            numbers = pa.array(np.concatenate([n, frame[e[own] - 1]]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([keys, numbers, pa.concat_arrays([pa.array(bpm, pa.float64()), pa.nulls(int(own.sum()), pa.float64())])], ["stream_id", "n", "bpm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = batch if rest is None else pa.concat_batches([rest, batch])
            if not whole.num_rows:
                continue
            key, block = whole.column("stream_id").dictionary_encode(null_encoding="encode").indices.to_numpy(), whole.column("block").to_numpy()
            begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            yield from blocks(whole.slice(0, begins[-1]), begins[:-1])
            rest = whole.slice(begins[-1])
        if rest is not None:
            yield from blocks(rest, np.zeros(1, dtype=np.int64))

    return dealt.mapInArrow(run, f"stream_id {nov.schema['stream_id'].dataType.simpleString()}, n long, bpm double")


def curve(nov: DataFrame, frame_rate: float, drift: float = 0.5) -> DataFrame:
    """stream_id, time_ms, bpm: the tempo curve of nov(stream_id, frame_no, novelty), frames counted from 0; a frame without a row is silent.

    Estimates over the last WINDOW values are made at every EVERY-th frame from FIRST_FRAME on; the confident ones that differ by
    drift from the last point are points, the first of them at time 0. Streams are cut into blocks of BLOCK frames with the WINDOW
    frames before them, so a long stream is many tasks, and only confident estimates are dealt by stream.
    """
    made = _curve_estimates(nov, frame_rate)
    # The estimate at frame a sees the frames before it, and is made if the stream has a frame there or later.
    last = F.max(F.when(F.col("bpm").isNull(), F.col("n"))).over(Window.partitionBy("stream_id"))
    points = curve_points(made.withColumn("last", last).where((F.col("n") <= F.col("last")) & F.col("bpm").isNotNull()).select("stream_id", "n", "bpm"), drift)
    first = F.row_number().over(Window.partitionBy("stream_id").orderBy("n")) == 1
    return points.select("stream_id", F.when(first, 0).otherwise(F.floor(F.col("n") * 1000 / frame_rate)).cast("long").alias("time_ms"), "bpm")


def beat_grid(nov: DataFrame, period: float, signature: int = 4, start: float = 30.0, on: float = 20.0) -> DataFrame:
    """stream_id, beat, frame_no, bar_index, beat_within_bar, interpolated, downbeat of nov(stream_id, frame_no, bass, snare, novelty).

    The first beat needs a novelty above start; a later one at least 0.85 periods after the last, with a novelty above on or
    1.15 periods after it (then interpolated). The phase of four with the most bass over snare gets the downbeats.
    """

    def begin():
        last: list[int] = []
        count = [0]

        def step(n: int, novelty: float, kick: int) -> list[tuple]:
            if last:
                since = n - last[0]
                beat = since >= 0.85 * period and (novelty > on or since >= 1.15 * period)
            else:
                beat = novelty > start
            if not beat:
                return []
            last[:] = [n]
            count[0] += 1
            return [(count[0] - 1, n, novelty <= on, kick)]

        return step

    kicks = nov.select("stream_id", "frame_no", "novelty", (F.col("bass") - F.col("snare")).cast("long").alias("kick"))
    b = folded(kicks, ["frame_no"], ["frame_no", "novelty", "kick"], begin, "beat int, frame_no long, interpolated boolean, kick long")
    scores = b.groupBy("stream_id").agg(*(F.sum(F.when(F.col("beat") % 4 == p, F.col("kick")).otherwise(0)).alias(f"s{p}") for p in range(4)))
    top = F.greatest(*(F.col(f"s{p}") for p in range(4)))
    phase = F.when(F.col("s0") == top, 0).when(F.col("s1") == top, 1).when(F.col("s2") == top, 2).otherwise(3)
    moved = F.col("beat") - F.col("phase")
    b = b.join(scores.select("stream_id", phase.alias("phase")), "stream_id")
    bar = F.when(moved >= 0, F.call_function("div", moved, F.lit(signature)) + 1).otherwise(0)
    within = F.when(moved >= 0, moved % signature + 1).otherwise(signature + moved + 1)
    return b.select("stream_id", "beat", "frame_no", bar.cast("long").alias("bar_index"), within.cast("long").alias("beat_within_bar"), "interpolated", ((moved >= 0) & (within == 1)).alias("downbeat"))


def _as_of(points: DataFrame, probes: DataFrame, time: str, values: list[str]) -> DataFrame:
    """probes(stream_id, t) with the last point at or before t (p_<value>) and the point after it (n_<value>).

    A union ordered by time, with points before probes of their time: one shuffle, no range join.
    """
    w = Window.partitionBy("stream_id").orderBy(time)
    p = points.select("stream_id", F.col(time).alias("t"), *(F.col(v).alias(f"p_{v}") for v in values), *(F.lead(v).over(w).alias(f"n_{v}") for v in values), F.lit(0).alias("probe"))
    both = p.unionByName(probes.select("stream_id", "t", F.lit(1).alias("probe")), allowMissingColumns=True)
    last = Window.partitionBy("stream_id").orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.last(F.when(F.col("probe") == 0, F.struct(*(f"{k}_{v}" for v in values for k in "pn"))), ignorenulls=True).over(last)
    return both.withColumn("m", marked).where("probe = 1").select("stream_id", "t", "m.*")


def bpm_at(curve: DataFrame, probes: DataFrame) -> DataFrame:
    """stream_id, t, bpm: between points in proportion, held at both ends. curve has stream_id, time_ms, bpm."""
    found = _as_of(curve, probes, "time_ms", ["time_ms", "bpm"])
    first = curve.groupBy("stream_id").agg(F.min_by("bpm", "time_ms").alias("first"))
    span = F.col("n_time_ms") - F.col("p_time_ms")
    inside = F.col("p_bpm") + F.when(span > 0, (F.col("t") - F.col("p_time_ms")) / span).otherwise(0.0) * (F.col("n_bpm") - F.col("p_bpm"))
    return found.join(first, "stream_id").select("stream_id", "t", F.coalesce(inside, "p_bpm", "first").alias("bpm"))


def time_to_beat(beats: DataFrame, probes: DataFrame) -> DataFrame:
    """stream_id, t, position: number of the last beat at or before t, and the share of the way to the next. beats: stream_id, beat, time_ms."""
    found = _as_of(beats, probes, "time_ms", ["time_ms", "beat"])
    span = F.col("n_time_ms") - F.col("p_time_ms")
    share = F.when(span > 0, (F.col("t") - F.col("p_time_ms")) / span).otherwise(0.0)
    return found.select("stream_id", "t", F.when(F.col("p_beat").isNull(), 0.0).otherwise(F.col("p_beat") + F.coalesce(share, F.lit(0.0))).alias("position"))


def beat_to_time(beats: DataFrame, probes: DataFrame) -> DataFrame:
    """stream_id, position, time_ms: between beats in proportion, truncated; held at both ends. probes: stream_id, position."""
    w = Window.partitionBy("stream_id").orderBy("beat")
    b = beats.select("stream_id", "beat", F.col("time_ms").alias("t0"), F.lead("time_ms").over(w).alias("t1"))
    last = beats.groupBy("stream_id").agg(F.max("beat").alias("last"))
    p = probes.join(last, "stream_id").withColumn("beat", F.least(F.greatest(F.floor("position"), F.lit(0)), F.col("last")).cast("long"))
    share = F.greatest(F.col("position") - F.col("beat"), F.lit(0.0))
    return p.join(b.withColumn("beat", F.col("beat").cast("long")), ["stream_id", "beat"]).select("stream_id", "position", (F.col("t0") + F.coalesce((share * (F.col("t1") - F.col("t0"))).cast("long"), F.lit(0))).alias("time_ms"))


def nearest_beat(beats: DataFrame, probes: DataFrame) -> DataFrame:
    """stream_id, t, beat, time_ms: the beat closest in time, the earlier one of two as close."""
    found = _as_of(beats, probes, "time_ms", ["time_ms", "beat"])
    first = beats.groupBy("stream_id").agg(F.min(F.struct("time_ms", "beat")).alias("f"))
    later = F.col("p_beat").isNull() | (F.col("n_time_ms") - F.col("t") < F.col("t") - F.col("p_time_ms"))
    f = found.join(first, "stream_id")
    return f.select("stream_id", "t", F.when(later, F.coalesce("n_beat", "f.beat")).otherwise(F.col("p_beat")).alias("beat"), F.when(later, F.coalesce("n_time_ms", "f.time_ms")).otherwise(F.col("p_time_ms")).alias("time_ms"))


def beats_in_range(beats: DataFrame, start_ms: int, duration_ms: int, most: int) -> DataFrame:
    """The first beats of each stream from start on, before start + duration, at most so many (a feature of the query)."""
    w = Window.partitionBy("stream_id").orderBy("time_ms", "beat")
    inside = beats.where((F.col("time_ms") >= start_ms) & (F.col("time_ms") < start_ms + duration_ms))
    return inside.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def beat_at(beats: DataFrame, index: DataFrame) -> DataFrame:
    """The beats of index(stream_id, beat), all their columns; none for numbers that a stream doesn't have."""
    return index.join(beats, ["stream_id", "beat"])
