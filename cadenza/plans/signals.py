"""Lossy codecs over tones, their kernels, all PCM formats, sidecars, and lookups: queries with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, transforms
from ..functions import samples as formats
from ..operators import envelope, slices, spectrum, tempo
from ..sources import aac, aiff, audio, mp3, sidecars, wav
from .catalogue import GRID, LOD0, ONSETS, QUANTIZED, _grid, _lod0, _onsets, _quantized, _totals, query
from .shapes import FRAMES, ITEMS, SERIES, frames, items, series, table

RATE, SIZE = 44100, 16384

# --- lossy codecs ---


def tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, n, v: for each nation a tone of two frequencies that swells and fades, 16-bit samples."""
    k = F.col("n_nationkey")
    angle = lambda f: 2 * np.pi * f * F.col("n") / RATE
    t = table(spark, sf_dir, "nation").select(k, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIZE - 1).cast("long"))).alias("n"))
    return t.select(k.cast("string").alias("stream_id"), "n", F.round(F.sin(np.pi * F.col("n") / SIZE) * (9000 * F.sin(angle(200 + 37 * k)) + 4000 * F.sin(angle(1700 + 111 * k)))).cast("int").alias("v"))


def _coded(spark: SparkSession, sf_dir: str, kind: str, lag: int, decibels: float, **options: object) -> DataFrame:
    """Frames of each tone that come back, and whether the error is so many decibels below the signal."""
    s = tones(spark, sf_dir)
    back = audio.samples(audio.decode(audio.encode(audio.numbered(s, "v", 4096, RATE), kind, **options)))
    both = s.join(back.select("stream_id", (F.col("n") - lag).alias("n"), F.col("v").alias("w")), ["stream_id", "n"])
    error = F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))
    return both.groupBy("stream_id").agg(F.count("*").alias("frames"), (error * 10 ** (decibels / 10) <= F.sum(F.col("v") * F.col("v"))).alias("close"))


CLOSE = f"SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, CAST({SIZE} AS BIGINT) AS frames, true AS close FROM nation"


@query(CLOSE)
def aac_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "aac", aac.FRAME, 35)


@query(CLOSE)
def aac_kbd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "aac", aac.FRAME, 35, window=aac.KBD)


@query(CLOSE)
def mp4_aac_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "mp4", aac.FRAME, 35)


@query(CLOSE)
def mp3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "mp3", mp3.DELAY, 35, kbps=128)


@query(CLOSE)
def vorbis_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "vorbis", 0, 30)


FRAMES_MP3 = -(-(SIZE + mp3.DELAY) // 1152)


@query(f"""SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, k AS frame_no, 144000 * 128 * k // {RATE} AS "offset", {RATE} AS rate, 128 AS kbps, 1 AS channels,
 CAST(144000 * 128 * (k + 1) // {RATE} - 144000 * 128 * k // {RATE} AS INTEGER) AS bytes FROM nation, range({FRAMES_MP3}) AS r(k)""")
def mp3_frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a constant rate, frames start at whole parts of it."""
    return audio.mp3_frames(audio.encode(audio.numbered(tones(spark, sf_dir), "v", 4096, RATE), "mp3", kbps=128))


@query(f"SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, k AS frame_no, {RATE} AS rate, 1 AS channels FROM nation, range({SIZE // 1024 + 1}) AS r(k)")
def aac_frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.aac_frames(audio.encode(audio.numbered(tones(spark, sf_dir), "v", 4096, RATE), "mp4")).drop("data")


@query("SELECT b AS book, CASE WHEN b <= 6 THEN 81 WHEN b <= 8 THEN 64 WHEN b <= 10 THEN 169 WHEN b = 11 THEN 289 ELSE 121 END AS symbols, 1.0::DOUBLE AS kraft FROM range(1, 13) AS r(b)")
def aac_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books 1 to 11 and that of scale factors: complete prefix codes."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in found:
            codes = [aac.scale_book() if b == 12 else aac.spectral_book(b)[1] for b in f["id"]]
            yield pd.DataFrame({"book": f["id"], "symbols": [len(c.codes) for c in codes], "kraft": [float((0.5**c.lengths).sum()) for c in codes]})

    return spark.range(1, 13).mapInPandas(run, "book long, symbols int, kraft double")


# --- kernels of the lossy codecs ---


def _kernel(df: DataFrame, run, schema: str) -> DataFrame:
    """run takes a batch as a frame and gives one."""

    def each(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in found:
            yield run(f)

    return df.mapInPandas(each, schema)


@query(f"WITH {ITEMS} SELECT stream_id, n, round(sign(q) * pow(abs(q), 4.0::DOUBLE / 3) * pow(2.0::DOUBLE, (n % 33 - 16) / 4.0::DOUBLE), 6) AS x FROM (SELECT stream_id, n, qty * (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) AS q FROM items)")
def codec_requantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir).select("stream_id", "n", (F.col("qty") * F.when(F.col("n") % 2 == 0, 1).otherwise(-1)).alias("q"))
    run = lambda f: f[["stream_id", "n"]].assign(x=transforms.requantise(f["q"].to_numpy(dtype=float), f["n"].to_numpy() % 33 - 16))
    return _kernel(s, run, "stream_id long, n long, x double").withColumn("x", F.round("x", 6))


@query(f"WITH {ITEMS} SELECT stream_id, n, qty AS q FROM items")
def codec_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantising what requantising gave restores it, at any scale."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        scale = f["n"].to_numpy() % 120 - 60
        return f[["stream_id", "n"]].assign(q=transforms.quantise(transforms.requantise(f["q"].to_numpy(dtype=float), scale), scale))

    return _kernel(items(spark, sf_dir).select("stream_id", "n", F.col("qty").alias("q")), run, "stream_id long, n long, q long")


@query(f"WITH {ITEMS} SELECT stream_id, n, round(v * pow(0.5::DOUBLE, (qty - 25) / 4.0::DOUBLE) * (CASE WHEN n % 3 = 0 THEN -1 ELSE 1 END), 4) AS r FROM items")
def codec_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda f: f[["stream_id", "n"]].assign(r=transforms.intensity(f["v"].to_numpy(dtype=float), f["qty"].to_numpy() - 25, f["n"].to_numpy() % 3 == 0))
    return _kernel(items(spark, sf_dir), run, "stream_id long, n long, r double").withColumn("r", F.round("r", 4))


@query(f"WITH {ITEMS} SELECT stream_id, n, v + qty * 1000 AS l, v - qty * 1000 AS r FROM items")
def codec_mid_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        left, right = transforms.mid_side(f["v"].to_numpy(), f["qty"].to_numpy() * 1000)
        return f[["stream_id", "n"]].assign(l=left, r=right)

    return _kernel(items(spark, sf_dir), run, "stream_id long, n long, l long, r long")


LCG = """WITH RECURSIVE s AS (SELECT n_nationkey AS k, 0 AS i, CAST(123456789 + n_nationkey AS BIGINT) AS state FROM nation
  UNION ALL SELECT k, i + 1, (state * 1664525 + 1013904223) % 4294967296 FROM s WHERE i < 32),
x AS (SELECT k, i, state, CAST(CASE WHEN state >= 2147483648 THEN state - 4294967296 ELSE state END AS DOUBLE) AS x FROM s WHERE i > 0)"""


@query(f"{LCG} SELECT k, CAST(i - 1 AS INTEGER) AS i, round(x * sqrt(1000.0::DOUBLE / sum(x * x) OVER (PARTITION BY k)), 6) AS x FROM x")
def codec_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 32 lines of substituted noise, each of energy 1000."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, i, x) for k in f["n_nationkey"] for i, x in enumerate(transforms.noise(123456789 + k, 32, 1000.0)[0])]
        return pd.DataFrame(rows, columns=["k", "i", "x"])

    return _kernel(table(spark, sf_dir, "nation").select("n_nationkey"), run, "k long, i int, x double").withColumn("x", F.round("x", 6))


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[i + 1] AS DOUBLE), 4) AS x FROM embeddings, range(64) AS r(i)")
def codec_tns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra through the prediction filter of their coefficients and, undone by its inverse, back."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, x in zip(f["vec_id"], f["embedding"]):
            a = transforms.reflection_to_direct(np.sin(np.array([k % 7 - 3, k % 5 - 2, k % 3 - 1]) * np.pi / 16))
            y = transforms.all_pole(np.asarray(x, dtype=float), a, down=bool(k % 2))
            y = y[::-1] if k % 2 else y
            back = np.convolve(y, np.append(1.0, a))[: len(y)]
            rows += [(k, i, v) for i, v in enumerate((back[::-1] if k % 2 else back).tolist())]
        return pd.DataFrame(rows, columns=["vec_id", "i", "x"])

    return _kernel(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), run, "vec_id long, i int, x double").withColumn("x", F.round("x", 4))


@query("""WITH RECURSIVE y AS (SELECT vec_id, 0 AS i, CAST(embedding[1] AS DOUBLE) AS y FROM embeddings
  UNION ALL SELECT y.vec_id, i + 1, e.embedding[i + 2] - sin((y.vec_id % 7 - 3) * pi() / 16) * y FROM y JOIN embeddings e ON e.vec_id = y.vec_id WHERE i < 63)
SELECT vec_id, i, round(y, 4) AS x FROM y""")
def codec_tns_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, i, v) for k, x in zip(f["vec_id"], f["embedding"]) for i, v in enumerate(transforms.all_pole(np.asarray(x, dtype=float), np.sin(np.array([(k % 7 - 3) * np.pi / 16]))).tolist())]
        return pd.DataFrame(rows, columns=["vec_id", "i", "x"])

    return _kernel(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), run, "vec_id long, i int, x double").withColumn("x", F.round("x", 4))


@query("""WITH c AS (SELECT * FROM (VALUES (0, -0.6::DOUBLE), (1, -0.535), (2, -0.33), (3, -0.185), (4, -0.095), (5, -0.041), (6, -0.0142), (7, -0.0037)) AS t(i, c)),
p AS (SELECT vec_id, i, CAST(embedding[18 - i] AS DOUBLE) AS up, CAST(embedding[19 + i] AS DOUBLE) AS low, 1 / sqrt(1 + c * c) AS cs, c / sqrt(1 + c * c) AS ca FROM embeddings, c)
SELECT vec_id, i, round(up * cs - low * ca, 6) AS up, round(low * cs + up * ca, 6) AS low FROM p""")
def codec_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Butterflies between the first two subbands of 18 lines."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        y = transforms.alias_butterflies(np.stack(f["embedding"])[:, :36].reshape(-1, 2, 18).astype(float))
        rows = [(k, i, v[0, 17 - i], v[1, i]) for k, v in zip(f["vec_id"], y) for i in range(8)]
        return pd.DataFrame(rows, columns=["vec_id", "i", "up", "low"])

    found = _kernel(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), run, "vec_id long, i int, up double, low double")
    return found.select("vec_id", "i", F.round("up", 6).alias("up"), F.round("low", 6).alias("low"))


@query("""WITH e AS (SELECT vec_id, unnest(range(64)) AS t, unnest(embedding) AS x FROM embeddings), k AS (SELECT k FROM range(32) AS r(k))
SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(x * sin(pi() / 64 * (t + 0.5)) * cos(pi() / 32 * (t + 0.5 + 16) * (k + 0.5))), 4) AS x FROM e, k GROUP BY vec_id, k""")
def codec_mdct(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        y = transforms.mdct(np.stack(f["embedding"]).astype(float) * transforms.sine_window(64))
        return pd.DataFrame({"vec_id": np.repeat(f["vec_id"].to_numpy(), 32), "k": np.tile(np.arange(32), len(y)), "x": y.ravel()})

    return _kernel(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), run, "vec_id long, k int, x double").withColumn("x", F.round("x", 4))


@query("""WITH b AS (SELECT n, i, CAST(1 AS DOUBLE) AS term FROM range(65) AS r(n), range(40) AS s(i)),
arg AS (SELECT n, pi() * 4 * sqrt(greatest(1 - pow(2 * n / 64.0 - 1, 2), 0)) / 2 AS h FROM range(65) AS r(n)),
fact AS (SELECT i, exp(lgamma(i + 1)) AS f FROM range(40) AS s(i)), kaiser AS (SELECT n, sum(pow(h, 2 * i) / (f * f)) AS v FROM arg, fact GROUP BY n),
w AS (SELECT n, sqrt(sum(v) OVER (ORDER BY n) / (SELECT sum(v) FROM kaiser)) AS w FROM kaiser)
SELECT CAST(n AS INTEGER) AS n, round(w, 9) AS w FROM w WHERE n < 64 UNION ALL SELECT CAST(127 - n AS INTEGER), round(w, 9) FROM w WHERE n < 64""")
def codec_kbd_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, round(float(w), 9)) for n, w in enumerate(transforms.kbd_window(128, 4.0))], "n int, w double")


# --- PCM formats ---

LOSSLESS = ("s16", "s24", "s32", "f32")
#: The greatest error of formats that lose something: of 8 bits, and of companded ones for the range of these tones.
LOSSY = {"u8": 256, "alaw": 1024, "mulaw": 1024}


def _formats(spark: SparkSession, sf_dir: str, kind: str, module) -> DataFrame:
    """format, stream_id, frames, ok: for each format, whether what comes back is the same, or within its error."""
    names = [n for n in module.FORMATS]
    s = tones(spark, sf_dir)
    out = None
    for name in names:
        back = audio.samples(audio.decode(audio.encode(audio.numbered(s, "v", 4096, RATE), kind, name=name)))
        both = s.join(back.select("stream_id", "n", F.col("v").alias("w")), ["stream_id", "n"])
        worst = F.max(F.abs(F.col("v") - F.col("w")))
        plain = re.sub("le$|be$", "", name)
        rows = both.groupBy("stream_id").agg(F.lit(name).alias("format"), F.count("*").alias("frames"), (worst <= {"s8": 256, **LOSSY}.get(plain, 0)).alias("ok"))
        out = rows if out is None else out.union(rows)
    return out.select("format", "stream_id", "frames", "ok")


def _formats_sql(module) -> str:
    return f"SELECT f AS format, CAST(n_nationkey AS VARCHAR) AS stream_id, CAST({SIZE} AS BIGINT) AS frames, true AS ok FROM nation, (VALUES {', '.join(f'({n!r})' for n in module.FORMATS)}) AS t(f)"


@query(_formats_sql(wav))
def wav_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir, "wav", wav)


@query(_formats_sql(aiff))
def aiff_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir, "aiff", aiff)


G711 = """WITH b AS (SELECT CAST(b AS INTEGER) AS b, xor(b, 85) AS x, 255 - b AS y FROM range(256) AS r(b)),
a AS (SELECT b, x, (x >> 4) & 7 AS seg, (x & 15) << 4 AS t, y FROM b)"""


@query(f"""{G711} SELECT b, CAST((CASE WHEN (x & 128) > 0 THEN 1 ELSE -1 END) * (CASE WHEN seg = 0 THEN t + 8 ELSE (t + 264) << greatest(seg - 1, 0) END) AS INTEGER) AS alaw,
 CAST((CASE WHEN (y & 128) > 0 THEN -1 ELSE 1 END) * (((((y & 15) << 3) + 132) << ((y >> 4) & 7)) - 132) AS INTEGER) AS mulaw FROM a""")
def g711_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, m = formats.g711_table("a"), formats.g711_table("m")
    return spark.createDataFrame([(b, int(a[b]), int(m[b])) for b in range(256)], "b int, alaw int, mulaw int")


# --- checksums, spectra, MIDI ---

def _crc_sql(kind: str) -> str:
    """Bitwise: each byte goes in at the top, then eight steps of shift and conditional xor, as nested expressions over a table of 256."""
    width, poly = checksums.CRC[kind]
    top, mask = 1 << width - 1, (1 << width) - 1
    c = f"(b << {width - 8})"
    steps = [f"{kind}_0 AS (SELECT b, CAST({c} AS BIGINT) AS c FROM range(256) AS r(b))"]
    for k in range(8):
        steps.append(f"{kind}_{k + 1} AS (SELECT b, CASE WHEN (c & {top}) > 0 THEN xor((c << 1) & {mask}, {poly}) ELSE (c << 1) & {mask} END AS c FROM {kind}_{k})")
    return ", ".join(steps)


_TABLES = ", ".join(f"t_{k} AS (SELECT list(c ORDER BY b) AS t FROM {k}_8)" for k in checksums.CRC)


def _crc_column(kind: str) -> str:
    width, _ = checksums.CRC[kind]
    return f"list_reduce(list_concat([CAST(0 AS BIGINT)], bytes), lambda c, x: xor((c << 8) & {(1 << width) - 1}, t_{kind}.t[(xor(c >> {width - 8}, x) & 255) + 1])) AS {kind}"


@query(f"""WITH {", ".join(map(_crc_sql, checksums.CRC))}, {_TABLES}, o AS (SELECT o_orderkey, o_orderpriority || '/' || o_orderstatus || '/' || o_orderkey AS s FROM orders),
p AS (SELECT o_orderkey, list_transform(range(1, CAST(length(s) AS BIGINT) + 1), lambda k: CAST(ord(s[CAST(k AS INTEGER)]) AS BIGINT)) AS bytes FROM o)
SELECT o_orderkey, {", ".join(map(_crc_column, checksums.CRC))} FROM p, {", ".join(f"t_{k}" for k in checksums.CRC)}""")
def crc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.encode(F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")), "utf-8").alias("data"))
    return o.select("o_orderkey", *(checksums.crc_udf(k)("data").alias(k) for k in checksums.CRC))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(trunc(0.5::DOUBLE * (1 - cos(2 * pi() * i / 1023)) * 32767) AS BIGINT) AS w FROM range(1024) AS r(i)")
def spectrum_hann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, int(w)) for i, w in enumerate(spectrum.hann())], "i int, w long")


@query("""WITH x AS (SELECT n_nationkey AS k, i, round(9000 * sin(2 * pi() * (200 + 37 * n_nationkey) * i / 44100)) AS v FROM nation, range(1024) AS r(i)),
w AS (SELECT k, i, CAST(v AS BIGINT) * CAST(trunc(0.5::DOUBLE * (1 - cos(2 * pi() * i / 1023)) * 32767) AS BIGINT) >> 15 AS x FROM x)
SELECT k, CAST(b AS INTEGER) AS bin, round(sqrt(pow(sum(x * cos(2 * pi() * b * i / 1024)), 2) + pow(sum(x * sin(2 * pi() * b * i / 1024)), 2)), 3) AS magnitude FROM w, range(64) AS r(b) GROUP BY k, b""")
def spectrum_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest 64 bins of a windowed frame of each nation's tone."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        i = np.arange(spectrum.FFT)
        x = np.stack([np.round(9000 * np.sin(2 * np.pi * (200 + 37 * k) * i / RATE)) for k in f["n_nationkey"]]).astype(np.int64)
        y = spectrum.magnitudes(x * spectrum.hann() >> 15)[:, :64]
        return pd.DataFrame({"k": np.repeat(f["n_nationkey"].to_numpy(), 64), "bin": np.tile(np.arange(64), len(y)), "magnitude": y.ravel()})

    return _kernel(table(spark, sf_dir, "nation").select("n_nationkey"), run, "k long, bin int, magnitude double").withColumn("magnitude", F.round("magnitude", 3))


@query("SELECT CAST(d AS INTEGER) AS duration_ms, CAST(c AS INTEGER) AS columns, CASE WHEN d >= 90 * c THEN 1 ELSE 0 END AS level FROM range(500, 40000, 1500) AS r(d), (VALUES (10), (100), (320)) AS t(c)")
def spectrum_pick_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, c, spectrum.pick_level(d, c, [9, 9])) for d in range(500, 40000, 1500) for c in (10, 100, 320)], "duration_ms int, columns int, level int")


VLQ = "(CASE WHEN {x} < 128 THEN printf('%02X', {x}) WHEN {x} < 16384 THEN printf('%02X%02X', {x} // 128 % 128 + 128, {x} % 128) WHEN {x} < 2097152 THEN printf('%02X%02X%02X', {x} // 16384 % 128 + 128, {x} // 128 % 128 + 128, {x} % 128) ELSE printf('%02X%02X%02X%02X', {x} // 2097152 % 128 + 128, {x} // 16384 % 128 + 128, {x} // 128 % 128 + 128, {x} % 128) END)"


@query(f"""WITH RECURSIVE {QUANTIZED}, notes AS (SELECT stream_id, k, musical_tick, midi_note, lead(musical_tick) OVER w - musical_tick AS gap FROM quantized WINDOW w AS (PARTITION BY stream_id ORDER BY k)),
timed AS (SELECT *, CASE WHEN gap > 0 THEN least(gap, 240) ELSE 120 END AS duration FROM notes),
deltas AS (SELECT *, greatest(musical_tick - coalesce(lag(musical_tick + duration) OVER (PARTITION BY stream_id ORDER BY k), 0), 0) AS delta FROM timed),
events AS (SELECT stream_id, k, {VLQ.format(x="delta")} || '90' || printf('%02X', midi_note & 127) || '64' || {VLQ.format(x="duration")} || '80' || printf('%02X', midi_note & 127) || '00' AS e FROM deltas),
tracks AS (SELECT stream_id, '00FF580404021808' || '00FF510307A120' || string_agg(e, '' ORDER BY k) || '00FF2F00' AS t FROM events GROUP BY stream_id)
SELECT stream_id, '4D546864000000060000000101E04D54726B' || printf('%08X', length(t) // 2) || t AS midi FROM tracks""")
def slice_midi_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.midi(_quantized(spark, sf_dir)).withColumn("midi", F.hex("midi"))


# --- slices, beats and envelopes by other ways ---


@query(f"""WITH RECURSIVE {ONSETS}, s AS (SELECT stream_id, CAST(k AS BIGINT) AS k, start_sample, coalesce(lead(start_sample) OVER (PARTITION BY stream_id ORDER BY k), total) - start_sample AS length_samples FROM hits JOIN totals USING (stream_id) WHERE k < 256)
SELECT stream_id, k, start_sample, CAST(0 AS BIGINT) AS musical_tick, 36 + k % 64 AS midi_note, CAST(0 AS BIGINT) AS bar_index, CAST(0 AS BIGINT) AS beat_within_bar, CAST(0 AS BIGINT) AS subdivision, length_samples, least(length_samples * 1000 // 100, 65535) AS decay_ms FROM s""")
def slice_one_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.one_shots(_onsets(spark, sf_dir), _totals(spark, sf_dir), 100)


@query(f"""WITH RECURSIVE {QUANTIZED} SELECT p.stream_id, p.n * 3 * 100 // 1000 AS "at", q.k FROM series p LEFT JOIN quantized q ON q.stream_id = p.stream_id AND p.n * 3 * 100 // 1000 >= q.start_sample AND p.n * 3 * 100 // 1000 < q.start_sample + q.length_samples""")
def slice_at_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.at_ms(_quantized(spark, sf_dir), series(spark, sf_dir).select("stream_id", (F.col("n") * 3).alias("ms")), 100)


@query(f"""WITH RECURSIVE {QUANTIZED}, f AS (SELECT stream_id, count(*) AS slices, arg_max(musical_tick, k) AS tick FROM quantized GROUP BY stream_id)
SELECT t.stream_id, coalesce(slices, 0) AS slices, total * 1000 // 100 AS duration_ms, CASE WHEN tick IS NULL THEN 0 ELSE tick // 1920 + 1 END AS num_bars FROM totals t LEFT JOIN f ON f.stream_id = t.stream_id""")
def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.summary(_quantized(spark, sf_dir), _totals(spark, sf_dir), 100)


@query(f"WITH {GRID} SELECT stream_id, k, start_sample, length_samples FROM grid WHERE k = 2")
def slice_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _totals(spark, sf_dir).select("stream_id", F.lit(2).cast("long").alias("k"))
    return slices.slice_at(_grid(spark, sf_dir), asked).select("stream_id", "k", "start_sample", "length_samples")


RAMPS = f"""WITH {SERIES}, sized AS (SELECT *, count(*) OVER (PARTITION BY stream_id) AS size FROM series)"""


@query(f"""{RAMPS} SELECT stream_id, n, CAST(CASE WHEN n < least(8, size) THEN trunc(v * (n / CAST(least(8, size) AS DOUBLE))) ELSE v END AS INTEGER) AS up,
 CAST(CASE WHEN n >= size - least(20, size) THEN trunc(v * (1 - (n - (size - least(20, size)) + 1) / CAST(least(20, size) AS DOUBLE))) ELSE v END AS INTEGER) AS down FROM sized""")
def slice_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack and choke ramps over each series as one slice, at 8 kHz."""
    x = series(spark, sf_dir).groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda s: s["v"]).alias("x"))
    r = x.select("stream_id", F.posexplode(F.arrays_zip(slices.attack_ramp(F.col("x"), 8000).alias("up"), slices.choke_ramp(F.col("x"), 8000).alias("down"))).alias("n", "r"))
    return r.select("stream_id", F.col("n").cast("long").alias("n"), F.col("r.up").alias("up"), F.col("r.down").alias("down"))


@query(f"WITH {SERIES} SELECT stream_id, n AS beat, n * 700 AS time_ms FROM series WHERE n = 5")
def beat_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = series(spark, sf_dir).select("stream_id", F.col("n").alias("beat"), (F.col("n") * 700).alias("time_ms"))
    return tempo.beat_at(beats, beats.select("stream_id").distinct().withColumn("beat", F.lit(5).cast("long")))


BEATS = "beats AS (SELECT stream_id, n * 700 AS time_ms, n AS beat, 120 + v / 1000.0 AS bpm FROM series), probes AS (SELECT stream_id, n * 700 + 250 AS t FROM series)"
AS_OF_ALL = f"""WITH {SERIES}, {BEATS}, nexts AS (SELECT *, lead(time_ms) OVER w AS n_time, lead(bpm) OVER w AS n_bpm, lead(beat) OVER w AS n_beat FROM beats WINDOW w AS (PARTITION BY stream_id ORDER BY time_ms)),
j AS (SELECT p.stream_id, p.t, c.* EXCLUDE (stream_id) FROM probes p JOIN nexts c ON c.stream_id = p.stream_id AND c.time_ms = p.t - 250)"""


def _beats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row a beat, and a probe after each."""
    s = series(spark, sf_dir)
    return s.select("stream_id", (F.col("n") * 700).alias("time_ms"), F.col("n").alias("beat"), (120 + F.col("v") / 1000.0).alias("bpm")), s.select("stream_id", (F.col("n") * 700 + 250).alias("t"))


@query(f"{AS_OF_ALL} SELECT stream_id, t, round(coalesce(bpm + (t - time_ms) / CAST(n_time - time_ms AS DOUBLE) * (n_bpm - bpm), bpm), 6) AS bpm FROM j")
def bpm_at_every_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.bpm_at(*_beats(spark, sf_dir)).withColumn("bpm", F.round("bpm", 6))


@query(f"{AS_OF_ALL} SELECT stream_id, t, round(beat + coalesce((t - time_ms) / CAST(n_time - time_ms AS DOUBLE), 0), 6) AS position FROM j")
def time_to_every_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.time_to_beat(*_beats(spark, sf_dir)).withColumn("position", F.round("position", 6))


@query(f"{AS_OF_ALL} SELECT stream_id, t, beat, time_ms FROM j")
def nearest_of_every_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """250 ms after a beat, with the next one 450 ms away, it is still the nearest."""
    return tempo.nearest_beat(*_beats(spark, sf_dir))


@query(f"WITH {SERIES}, {LOD0} SELECT stream_id, chunk_no, v_min AS l_min, v_max AS l_max, v_min AS r_min, v_max AS r_max FROM lod0")
def envelope_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.to_stereo(_lod0(spark, sf_dir))


@query()
def tempo_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tempo curve of pulses that every event series sets off: one per row, 43 frames apart, its height the row's value."""
    pulse = F.struct((F.col("n") * 43).alias("frame_no"), (100.0 + F.abs("v") % 50).alias("novelty"))
    # Frames between a pulse and the last silent one before the next have no rows.
    silent = F.struct((F.col("n") * 43 + 42).alias("frame_no"), F.lit(0.0).alias("novelty"))
    pulses = series(spark, sf_dir).select("stream_id", F.explode(F.array(pulse, silent)).alias("p")).select("stream_id", "p.frame_no", "p.novelty")
    return tempo.curve(pulses, RATE / 512)


# --- sidecars ---


@query(f"WITH {FRAMES} SELECT stream_id, frame_no, CAST(b AS INTEGER) AS band, CAST(bands[b + 1] AS INTEGER) AS value FROM frames, range(64) AS r(b)")
def spectrum_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames packed into one sidecar per stream and read back."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame_no")
        level = np.stack([np.asarray(b) for b in f["bands"]]).astype(np.uint8)
        back = sidecars.Spectrum.unpack(sidecars.Spectrum(RATE, 512 * len(f), [level, level[::16]]).pack())
        n, bands = back.levels[0].shape
        return pd.DataFrame({"stream_id": f["stream_id"].iloc[0], "frame_no": np.repeat(f["frame_no"].to_numpy(), bands), "band": np.tile(np.arange(bands), n), "value": back.levels[0].ravel()})

    key = frames(spark, sf_dir).schema["stream_id"].dataType.simpleString()
    return frames(spark, sf_dir).groupBy("stream_id").applyInPandas(run, f"stream_id {key}, frame_no long, band int, value int")


@query(f"WITH {SERIES} SELECT stream_id, n AS beat, n * 700 AS time_ms, n // 4 + 1 AS bar_index, n % 4 + 1 AS beat_within_bar, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS flags FROM series")
def tempo_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        n = f["n"].sort_values().to_numpy()
        beats = np.zeros(len(n), dtype=sidecars.BEAT)
        beats["time_ms"], beats["bar_index"], beats["beat_within_bar"], beats["flags"] = n * 700, n // 4 + 1, n % 4 + 1, n % 4 == 0
        curve = np.array([(0, 120 << 16)], dtype=sidecars.POINT)
        b = sidecars.Tempo.unpack(sidecars.Tempo(RATE, 700 * len(n), 120 << 16, 200, curve, beats).pack()).beats
        return pd.DataFrame({"stream_id": f["stream_id"].iloc[0], "beat": np.arange(len(b)), **{c: b[c].astype(np.int64) for c in ("time_ms", "bar_index", "beat_within_bar", "flags")}})

    return series(spark, sf_dir).groupBy("stream_id").applyInPandas(run, "stream_id long, beat long, time_ms long, bar_index long, beat_within_bar long, flags int")


@query(f"WITH {GRID} SELECT stream_id, k, start_sample, length_samples, musical_tick, midi_note, bar_index, beat_within_bar, subdivision, decay_ms FROM grid")
def slice_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["start_sample", "length_samples", "musical_tick", "midi_note", "bar_index", "beat_within_bar", "subdivision", "decay_ms"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        rows = np.zeros(len(f), dtype=sidecars.SLICE)
        for c in names:
            rows[c] = f[c].to_numpy()
        back = sidecars.Slices.unpack(sidecars.Slices(100, int(f["start_sample"].iloc[-1] + f["length_samples"].iloc[-1]), rows).pack()).rows
        return pd.DataFrame({"stream_id": f["stream_id"].iloc[0], "k": np.arange(len(back)), **{c: back[c].astype(np.int64) for c in names}})

    return _grid(spark, sf_dir).groupBy("stream_id").applyInPandas(run, "stream_id long, k long, " + ", ".join(f"{c} long" for c in names))
