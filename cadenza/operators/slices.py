"""Onset detection, quantised slices, lookups, playback and MIDI export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pcm import div, vlq_hex
from .folds import folded

PPQN, STEP = 480, 120
HOP_SIZE, HISTORY, NOISE_FLOOR, LEAST_NOVELTY = 32, 16, 500.0, 2000.0
MOST_SLICES = 256


#: Samples of a stream that one task looks at together.
BLOCK = 1 << 16


def with_previous(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """samples(stream_id, n, v), n without gaps, with before: the value of the sample before (null for the first).

    Windows go over blocks of a stream, and each block's first sample gets the last value of the block before by a join of one row
    per block: a long recording is many tasks.
    """
    s = samples.select("stream_id", "n", "v", div("n", block).alias("block"))
    edge = s.where(F.col("n") % block == block - 1).select("stream_id", (F.col("block") + 1).alias("block"), F.col("v").alias("edge"))
    w = Window.partitionBy("stream_id", "block").orderBy("n")
    s = s.join(edge, ["stream_id", "block"], "left")
    return s.withColumn("before", F.coalesce(F.lag("v").over(w), F.when(F.col("n") % block == 0, F.col("edge")))).drop("block", "edge")


def hop_energy(samples: DataFrame, hop: int = HOP_SIZE, alpha: float = 0.95) -> DataFrame:
    """stream_id, hop, energy: sums of |x - alpha * previous x| over whole hops; samples past the last whole hop don't count."""
    high = F.abs(F.col("v") - alpha * F.coalesce("before", F.lit(0)))
    s = with_previous(samples).select("stream_id", div("n", hop).alias("hop"), high.alias("high"))
    return s.groupBy("stream_id", "hop").agg(F.sum("high").alias("energy"), F.count("*").alias("size")).where(F.col("size") == hop).drop("size")


def hop_novelty(energy: DataFrame) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("hop")
    return energy.withColumn("novelty", F.greatest(F.col("energy") - F.coalesce(F.lag("energy").over(w), F.lit(0.0)), F.lit(0.0)))


def rolling(nov: DataFrame, size: int = HISTORY) -> DataFrame:
    """novelty with mean and population deviation of the size values before it (0 where there are none)."""
    w = Window.partitionBy("stream_id").orderBy("hop").rowsBetween(-size, -1)
    return nov.withColumn("mean", F.coalesce(F.avg("novelty").over(w), F.lit(0.0))).withColumn("deviation", F.coalesce(F.stddev_pop("novelty").over(w), F.lit(0.0)))


def candidates(stats: DataFrame, sensitivity: float = 0.5, floor: float = NOISE_FLOOR, least: float = LEAST_NOVELTY) -> DataFrame:
    k = 3.5 - 3 * sensitivity
    return stats.where((F.col("novelty") > F.col("mean") + k * F.col("deviation") + floor) & (F.col("novelty") > least))


def peaks(samples: DataFrame, hops: DataFrame, hop: int = HOP_SIZE) -> DataFrame:
    """stream_id, hop, peak: the first sample with the greatest magnitude of each hop in hops."""
    s = samples.select("stream_id", div("n", hop).alias("hop"), F.struct(F.abs("v").alias("size"), (-F.col("n")).alias("minus")).alias("x"))
    return s.join(hops.select("stream_id", "hop"), ["stream_id", "hop"]).groupBy("stream_id", "hop").agg((-F.max("x")["minus"]).alias("peak"))


def zero_crossings(samples: DataFrame, peak: DataFrame, reach: int = 64) -> DataFrame:
    """peak with snapped: the last sign change at or before the peak, within reach samples, else the peak.

    Crossings go by cells of reach samples, and a peak looks into its own cell and the one before: an equi-join of bounded width.
    """
    crossing = with_previous(samples).where(((F.col("before") <= 0) & (F.col("v") >= 0)) | ((F.col("before") >= 0) & (F.col("v") <= 0)))
    cells = crossing.select("stream_id", F.col("n").alias("zero"), div("n", reach).alias("cell"))
    own = div("peak", reach)
    asked = peak.select("stream_id", "hop", "peak", F.explode(F.array(own, own - 1)).alias("cell"))
    inside = (F.col("zero") <= F.col("peak")) & (F.col("zero") > F.col("peak") - reach)
    found = asked.join(cells, ["stream_id", "cell"], "left").groupBy("stream_id", "hop", "peak").agg(F.max(F.when(inside, F.col("zero"))).alias("zero"))
    return found.select("stream_id", "hop", "peak", F.coalesce("zero", "peak").alias("snapped"))


def refractory(hits: DataFrame, gap: int, hop: int = HOP_SIZE) -> DataFrame:
    """stream_id, k, start_sample of hits(stream_id, hop, snapped) whose hop starts gap or more samples after the last kept hit.

    A kept hit decides which later ones count, so each stream is one ordered fold over its candidates.
    """

    def start():
        kept: list[int] = []
        count = [0]

        def step(at: int, snapped: int) -> list[tuple]:
            if kept and at * hop - kept[0] < gap:
                return []
            kept[:] = [snapped]
            count[0] += 1
            return [(count[0] - 1, snapped)]

        return step

    return folded(hits, ["hop", "snapped"], ["hop", "snapped"], start, "k int, start_sample long")


def onsets(samples: DataFrame, gap: int, sensitivity: float = 0.5, hop: int = HOP_SIZE, alpha: float = 0.95, floor: float = NOISE_FLOOR, least: float = LEAST_NOVELTY) -> DataFrame:
    """The whole detector over one block per stream: energy, novelty, threshold, peak, zero crossing, refractory gap."""
    hot = candidates(rolling(hop_novelty(hop_energy(samples, hop, alpha))), sensitivity, floor, least)
    return refractory(zero_crossings(samples, peaks(samples, hot, hop)), gap, hop)


def ticks_per_bar(numerator: int, denominator: int) -> int:
    return PPQN * 4 * numerator // (denominator or 4) or PPQN * 4


def _musical(tick: Column, k: Column, bar: int) -> list[Column]:
    return [
        tick.cast("long").alias("musical_tick"),
        (36 + k % 64).cast("long").alias("midi_note"),
        (div(tick, bar).bitwiseAND(F.lit(255))).alias("bar_index"),
        div(tick % bar, PPQN).alias("beat_within_bar"),
        div(tick % PPQN, STEP).alias("subdivision"),
    ]


def _lengths(slices: DataFrame, rate: int) -> DataFrame:
    """length_samples (to the next slice, the last to the end) and decay_ms, from start_sample and total."""
    w = Window.partitionBy("stream_id").orderBy("k")
    length = F.coalesce(F.lead("start_sample").over(w), F.col("total")) - F.col("start_sample")
    return slices.withColumn("length_samples", length).withColumn("decay_ms", F.least(div(F.col("length_samples") * 1000, rate), F.lit(65535))).drop("total")


def grid(totals: DataFrame, rate: int, bpm: float = 120.0, numerator: int = 4, denominator: int = 4, most: int = MOST_SLICES) -> DataFrame:
    """Uniform sixteenths over totals(stream_id, total): as many whole ones as fit, at most `most`; the last takes the rest."""
    step = 60.0 / (bpm if bpm > 0 else 120.0) / 4.0 * rate
    n = F.least(F.floor(F.col("total") / step), F.lit(min(most, MOST_SLICES)))
    s = totals.where(n > 0).select("stream_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    s = s.select("stream_id", "total", "k", (F.col("k") * step).cast("long").alias("start_sample"), *_musical(F.col("k") * STEP, F.col("k"), ticks_per_bar(numerator, denominator)))
    return _lengths(s, rate)


def quantize(hits: DataFrame, totals: DataFrame, rate: int, bpm: float = 120.0, numerator: int = 4, denominator: int = 4, most: int = MOST_SLICES) -> DataFrame:
    """Slices at hits(stream_id, k, start_sample), ticks at the nearest sixteenth; a slice at sample 0 comes first if no hit is there."""
    per_sample = (bpm if bpm > 0 else 120.0) * PPQN / (60.0 * rate)
    w = Window.partitionBy("stream_id").orderBy("start_sample")
    first = hits.groupBy("stream_id").agg(F.min("start_sample").alias("least")).where("least > 0").select("stream_id", F.lit(0).cast("long").alias("start_sample"))
    s = hits.select("stream_id", "start_sample").union(first).withColumn("k", (F.row_number().over(w) - 1).cast("long")).where(F.col("k") < min(most, MOST_SLICES))
    tick = F.floor((F.col("start_sample") * per_sample + 60.0) / 120.0) * STEP
    s = s.select("stream_id", "k", "start_sample", *_musical(tick, F.col("k"), ticks_per_bar(numerator, denominator)))
    return _lengths(s.join(totals, "stream_id"), rate)


def summary(slices: DataFrame, totals: DataFrame, rate: int, numerator: int = 4, denominator: int = 4) -> DataFrame:
    """stream_id, slices, duration_ms, num_bars of streams (those without slices have no bars): the last slice's bar, counted from 1."""
    found = slices.groupBy("stream_id").agg(F.count("*").alias("slices"), F.max_by("musical_tick", "k").alias("tick"))
    bars = F.when(F.col("tick").isNull(), 0).otherwise(div(F.col("tick"), ticks_per_bar(numerator, denominator)) + 1)
    return totals.join(found, "stream_id", "left").select("stream_id", F.coalesce("slices", F.lit(0)).cast("long").alias("slices"), div(F.col("total") * 1000, rate).alias("duration_ms"), bars.cast("long").alias("num_bars"))


def slice_at(slices: DataFrame, index: DataFrame) -> DataFrame:
    """The slices of index(stream_id, k), all their columns; none for numbers that a stream doesn't have."""
    return index.join(slices, ["stream_id", "k"])


def one_shots(hits: DataFrame, totals: DataFrame, rate: int, most: int = MOST_SLICES) -> DataFrame:
    """Slices at hits as they are: no ticks."""
    zero = F.lit(0).cast("long")
    s = hits.where(F.col("k") < min(most, MOST_SLICES)).select("stream_id", F.col("k").cast("long").alias("k"), "start_sample", zero.alias("musical_tick"), (36 + F.col("k") % 64).cast("long").alias("midi_note"), *(zero.alias(c) for c in ("bar_index", "beat_within_bar", "subdivision")))
    return _lengths(s.join(totals, "stream_id"), rate)


def _last_at(slices: DataFrame, probes: DataFrame, by: str, values: list[str]) -> DataFrame:
    both = slices.select("stream_id", F.col(by).alias("at"), F.lit(0).alias("probe"), "k", *values).unionByName(probes.select("stream_id", "at", F.lit(1).alias("probe")), allowMissingColumns=True)
    w = Window.partitionBy("stream_id").orderBy("at", "probe", "k").rowsBetween(Window.unboundedPreceding, 0)
    m = F.last(F.when(F.col("probe") == 0, F.struct("k", *values)), ignorenulls=True).over(w)
    return both.withColumn("m", m).where("probe = 1").select("stream_id", "at", "m.*")


def at_sample(slices: DataFrame, probes: DataFrame) -> DataFrame:
    """stream_id, at, k of the slice that holds sample `at` (start included, end not); null in gaps."""
    s = slices.withColumn("end", F.col("start_sample") + F.col("length_samples"))
    return _last_at(s, probes, "start_sample", ["end"]).select("stream_id", "at", F.when(F.col("at") < F.col("end"), F.col("k")).alias("k"))


def at_ms(slices: DataFrame, probes: DataFrame, rate: int) -> DataFrame:
    """The same for probes(stream_id, ms)."""
    return at_sample(slices, probes.select("stream_id", div(F.col("ms") * rate, 1000).alias("at")))


def at_tick(slices: DataFrame, probes: DataFrame) -> DataFrame:
    """stream_id, at, k of the last slice whose tick is at most `at`; null before the first."""
    return _last_at(slices, probes, "musical_tick", []).select("stream_id", "at", "k")


def playback(slices: DataFrame, original_q16: int, target_q16: int) -> DataFrame:
    original = original_q16 or 120 << 16
    interval = div(F.col("length_samples") * original, target_q16 or original)
    return slices.select("stream_id", "k", interval.alias("interval_samples"), F.greatest(interval, F.col("length_samples")).alias("render_samples"), (interval > F.col("length_samples")).alias("needs_tail"))


def attack_ramp(samples: Column, rate: int) -> Column:
    """One millisecond linear ramp up at the start of an array of samples."""
    n = F.least(F.lit(rate // 1000), F.size(samples))
    return F.transform(samples, lambda x, i: F.when(i < n, (x * (i / n)).cast("int")).otherwise(x.cast("int")))


def choke_ramp(samples: Column, rate: int) -> Column:
    """2.5 milliseconds linear ramp down at the end."""
    n = F.least(F.lit(rate * 25 // 10000), F.size(samples))
    at = F.size(samples) - n
    return F.transform(samples, lambda x, i: F.when(i >= at, (x * (1 - (i - at + 1) / n)).cast("int")).otherwise(x.cast("int")))


def midi(slices: DataFrame, bpm: float = 120.0, numerator: int = 4, denominator: int = 4) -> DataFrame:
    """stream_id, midi: a type-0 file of the slices in order, as binary. A note lasts to the next slice's tick, 240 at most, else 120."""
    w = Window.partitionBy("stream_id").orderBy("k")
    gap = F.lead("musical_tick").over(w) - F.col("musical_tick")
    duration = F.when(gap > 0, F.least(gap, F.lit(240))).otherwise(120)
    s = slices.select("stream_id", "k", "musical_tick", "midi_note", duration.alias("duration"))
    now = F.coalesce(F.lag(F.col("musical_tick") + F.col("duration")).over(w), F.lit(0))
    note = F.lpad(F.hex(F.col("midi_note").bitwiseAND(F.lit(127))), 2, "0")
    event = F.concat(vlq_hex(F.greatest(F.col("musical_tick") - now, F.lit(0))), F.lit("90"), note, F.lit("64"), vlq_hex(F.col("duration")), F.lit("80"), note, F.lit("00"))
    s = s.withColumn("event", event)
    power = {1: 0, 2: 1, 4: 2, 8: 3, 16: 4}.get(denominator, 2)
    lead = f"00FF5804{numerator or 4:02X}{power:02X}180800FF5103{int(60000000.0 / (bpm if bpm > 0 else 120.0)):06X}"
    events = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "event"))), lambda e: e["event"]), "")
    t = s.groupBy("stream_id").agg(F.concat(F.lit(lead), events, F.lit("00FF2F00")).alias("track"))
    size = F.lpad(F.hex(div(F.length("track"), 2)), 8, "0")
    return t.select("stream_id", F.unhex(F.concat(F.lit(f"4D546864000000060000000{1}{PPQN:04X}4D54726B"), size, F.col("track"))).alias("midi"))
