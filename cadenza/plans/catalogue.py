"""The query catalogue over driver tables: each query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, pcm
from ..operators import blocks, coding, envelope, slices, spectrum, tempo
from .shapes import FRAMES, ITEMS, PACKETS, SERIES, frames, items, packets, series, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- envelope ---

LOD0 = "lod0 AS (SELECT stream_id, n // 16 AS chunk_no, least(min(least(greatest(v >> 4, -128), 127)), 0) AS v_min, greatest(max(least(greatest(v >> 4, -128), 127)), 0) AS v_max FROM series GROUP BY ALL)"
LOD1 = "lod1 AS (SELECT stream_id, chunk_no // 16 AS chunk_no, min(v_min) AS v_min, max(v_max) AS v_max FROM lod0 GROUP BY ALL)"
STREAMS = "streams AS (SELECT stream_id, count(*) AS duration_ms, CAST(ceil(count(*) / 16.0) AS BIGINT) AS chunks FROM series GROUP BY stream_id)"


def _lod0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.level0(series(spark, sf_dir), 16, 4)


@query(f"WITH {SERIES}, {LOD0} SELECT * FROM lod0")
def envelope_lod0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lod0(spark, sf_dir)


@query(f"WITH {SERIES}, {LOD0}, {LOD1} SELECT * FROM lod1")
def envelope_lod1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.roll_up(_lod0(spark, sf_dir))


@query(f"WITH {SERIES}, {LOD0}, {LOD1} SELECT stream_id, chunk_no // 16 AS chunk_no, min(v_min) AS v_min, max(v_max) AS v_max FROM lod1 GROUP BY ALL")
def envelope_lod2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.roll_up(envelope.roll_up(_lod0(spark, sf_dir)))


@query(f"""WITH {SERIES}, {LOD0}, {STREAMS},
spots AS (SELECT stream_id, p AS point, chunks, duration_ms / 16.0 / 4 AS step FROM streams, range(4) AS r(p)),
spans AS (SELECT stream_id, point, least(CAST(floor(point * step) AS BIGINT), chunks - 1) AS c0, least(CAST(floor((point + 1) * step) AS BIGINT), chunks - 1) AS c1 FROM spots WHERE step >= 1)
SELECT s.stream_id, CAST(point AS INTEGER) AS point, min(v_min) AS v_min, max(v_max) AS v_max FROM spans s JOIN lod0 l ON l.stream_id = s.stream_id AND l.chunk_no BETWEEN c0 AND greatest(c0, c1) GROUP BY ALL""")
def envelope_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = envelope.points(envelope.streams_of(series(spark, sf_dir), 1000), 0, 4, 16.0, F.col("duration_ms"))
    return envelope.overview(_lod0(spark, sf_dir), at)


@query(f"""WITH {SERIES}, {LOD0}, {STREAMS},
spots AS (SELECT stream_id, p AS point, chunks, 2 / 16.0 + p * (duration_ms / 16.0 / 64) AS place FROM streams, range(64) AS r(p) WHERE duration_ms > 2 AND duration_ms / 16.0 / 64 < 1),
two AS (SELECT stream_id, point, place - floor(place) AS a, least(CAST(floor(place) AS BIGINT), chunks - 1) AS c0, least(CAST(floor(place) AS BIGINT) + 1, chunks - 1) AS c1 FROM spots),
mixed AS (SELECT t.stream_id, point, CAST(round((1 - a) * x.v_min + a * y.v_min) AS BIGINT) AS lo, CAST(round((1 - a) * x.v_max + a * y.v_max) AS BIGINT) AS hi
  FROM two t JOIN lod0 x ON x.stream_id = t.stream_id AND x.chunk_no = c0 JOIN lod0 y ON y.stream_id = t.stream_id AND y.chunk_no = c1)
SELECT stream_id, CAST(point AS INTEGER) AS point, least(lo, hi) AS v_min, hi AS v_max FROM mixed""")
def envelope_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = envelope.points(envelope.streams_of(series(spark, sf_dir), 1000), 2, 64, 16.0, F.col("duration_ms"))
    return envelope.zoom(_lod0(spark, sf_dir), at)


@query(f"""WITH {ITEMS}, two AS (SELECT stream_id, n // 128 AS chunk_no, least(min(least(greatest((qty * 600) >> 8, -128), 127)), 0) AS l_min, greatest(max(least(greatest((qty * 600) >> 8, -128), 127)), 0) AS l_max,
  least(min(least(greatest((v % 65536 - 32768) >> 8, -128), 127)), 0) AS r_min, greatest(max(least(greatest((v % 65536 - 32768) >> 8, -128), 127)), 0) AS r_max FROM items GROUP BY ALL)
SELECT stream_id, chunk_no, least(l_min, r_min) AS v_min, greatest(l_max, r_max) AS v_max FROM two""")
def envelope_channel_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = items(spark, sf_dir).select("stream_id", "n", (F.col("qty") * 600).alias("l"), (F.col("v") % 65536 - 32768).alias("r"))
    return envelope.to_mono(envelope.level0(two, columns=("l", "r")))


@query(f"""WITH {SERIES}, {STREAMS}, p AS (SELECT stream_id, duration_ms, w, duration_ms / CAST(w AS DOUBLE) AS ms FROM streams, (VALUES (1), (4), (64)) AS x(w))
SELECT stream_id, w AS width, CASE WHEN ms >= 16 * 256 THEN 2 WHEN ms >= 16 * 16 THEN 1 ELSE 0 END AS lod FROM p""")
def envelope_pick_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = envelope.streams_of(series(spark, sf_dir), 1000).withColumn("width", F.explode(F.array(F.lit(1), F.lit(4), F.lit(64))))
    count = lambda size: F.ceil(F.col("frames") / size)
    return s.select("stream_id", "width", envelope.pick_level(F.col("duration_ms") / F.col("width"), 16.0, [count(16), count(256), count(4096)]).alias("lod"))


# --- samples ---


@query(f"WITH {ITEMS} SELECT stream_id, n, CAST(trunc((v - qty * 4000) / 2.0) AS BIGINT) AS mono FROM items")
def pcm_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("stream_id", "n", pcm.downmix(F.col("v"), -F.col("qty") * 4000).alias("mono"))


@query(f"WITH {SERIES} SELECT stream_id, n, least(greatest(v >> 8, -128), 127) AS small FROM series")
def pcm_scale_i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("stream_id", "n", pcm.scale_i8(F.col("v")).alias("small"))


@query(f"""WITH {SERIES}, x AS (SELECT stream_id, n, v / 8192.0 AS x FROM series)
SELECT stream_id, n, CAST(trunc(least(greatest(CASE WHEN x >= 0 THEN x * 32767.0 + 0.5 ELSE x * 32768.0 - 0.5 END, -32768.0), 32767.0)) AS INTEGER) AS sample FROM x""")
def pcm_float_to_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("stream_id", "n", pcm.float_to_i16(F.col("v") / 8192.0).alias("sample"))


def _segment_sql(m: str, first: int) -> str:
    return "CASE " + " ".join(f"WHEN {m} <= {((first + 1) << k) - 1} THEN {k}" for k in range(8)) + " ELSE 8 END"


@query(f"""WITH {ITEMS}, s AS (SELECT stream_id, n, v % 65536 - 32768 AS x FROM items), a AS (SELECT *, x >> 3 AS p FROM s), b AS (SELECT *, CASE WHEN p >= 0 THEN p ELSE -p - 1 END AS m FROM a),
c AS (SELECT *, {_segment_sql("m", 31)} AS seg FROM b), d AS (SELECT *, xor(CASE WHEN seg >= 8 THEN 127 ELSE seg * 16 + ((CASE WHEN seg < 2 THEN m >> 1 ELSE m >> seg END) & 15) END, CASE WHEN p >= 0 THEN 213 ELSE 85 END) AS code FROM c),
e AS (SELECT *, xor(code, 85) AS y FROM d), f AS (SELECT *, (y & 112) >> 4 AS s2, (y & 15) * 16 AS t FROM e), g AS (SELECT *, CASE WHEN s2 = 0 THEN t + 8 WHEN s2 = 1 THEN t + 264 ELSE (t + 264) << (s2 - 1) END AS u FROM f)
SELECT stream_id, n, code, CASE WHEN (y & 128) <> 0 THEN u ELSE -u END AS back FROM g""")
def g711_alaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir).select("stream_id", "n", (F.col("v") % 65536 - 32768).cast("int").alias("x"))
    s = s.select("stream_id", "n", pcm.alaw_encode(F.col("x")).alias("code"))
    return s.withColumn("back", pcm.alaw_decode(F.col("code")))


@query(f"""WITH {ITEMS}, s AS (SELECT stream_id, n, v % 65536 - 32768 AS x FROM items), a AS (SELECT *, x >> 2 AS p FROM s), b AS (SELECT *, least(abs(p), 8159) + 33 AS m FROM a),
c AS (SELECT *, {_segment_sql("m", 63)} AS seg FROM b), d AS (SELECT *, xor(CASE WHEN seg >= 8 THEN 127 ELSE seg * 16 + ((m >> (seg + 1)) & 15) END, CASE WHEN p < 0 THEN 127 ELSE 255 END) AS code FROM c),
e AS (SELECT *, 255 - code AS y FROM d), g AS (SELECT *, ((((y & 15) << 3) + 132) << ((y & 112) >> 4)) - 132 AS u FROM e)
SELECT stream_id, n, code, CASE WHEN (y & 128) <> 0 THEN -u ELSE u END AS back FROM g""")
def g711_ulaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir).select("stream_id", "n", (F.col("v") % 65536 - 32768).cast("int").alias("x"))
    s = s.select("stream_id", "n", pcm.ulaw_encode(F.col("x")).alias("code"))
    return s.withColumn("back", pcm.ulaw_decode(F.col("code")))


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 268435456 AS x FROM orders), d AS (SELECT *, x & 127 AS a, (x >> 7) & 127 AS b, (x >> 14) & 127 AS c, (x >> 21) & 127 AS e FROM o)
SELECT o_orderkey, (CASE WHEN x >= 2097152 THEN printf('%02X', e + 128) ELSE '' END) || (CASE WHEN x >= 16384 THEN printf('%02X', c + 128) ELSE '' END) || (CASE WHEN x >= 128 THEN printf('%02X', b + 128) ELSE '' END) || printf('%02X', a) AS vlq FROM d""")
def midi_vlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_orderkey") * 2654435761) % 268435456
    return table(spark, sf_dir, "orders").select("o_orderkey", pcm.vlq_hex(x).alias("vlq"))


# --- header fields ---

_AT = lambda values, k: "CASE " + k + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " ELSE 0 END"


@query(f"""WITH w AS (SELECT o_orderkey, 268369920 + (o_orderkey * 40503) % 65536 AS hi, (o_orderkey * 2654435761) % 268435456 AS lo FROM orders)
SELECT o_orderkey, (hi >> 16) & 4095 AS sync, (hi >> 15) & 1 AS mpeg2, (hi >> 12) & 1 AS protection_absent, (hi >> 10) & 3 AS profile, (hi >> 6) & 15 AS rate_index, {_AT(pcm.ADTS_RATES, "((hi >> 6) & 15)")} AS sample_rate,
(hi >> 2) & 7 AS channels, (lo >> 13) & 8191 AS frame_length, (lo >> 2) & 2047 AS fullness, (lo & 3) + 1 AS blocks FROM w""")
def adts_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    w = table(spark, sf_dir, "orders").select("o_orderkey", (268369920 + (k * 40503) % 65536).alias("hi"), ((k * 2654435761) % 268435456).alias("lo"))
    return w.select("o_orderkey", *(c.alias(n) for n, c in pcm.adts_fields(F.col("hi"), F.col("lo")).items()))


_V = "((x >> 19) & 3)"
_RATE = f"(CASE {_V} WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END)"


@query(f"""WITH w AS (SELECT o_orderkey, 4292870144 + (o_orderkey * 2654435761) % 2097152 AS x FROM orders),
f AS (SELECT *, {_V} <> 1 AND ((x >> 17) & 3) = 1 AND ((x >> 10) & 3) <> 3 AND (x & 3) <> 2 AND ((x >> 12) & 15) NOT IN (0, 15) AS valid,
 ({_AT([*pcm.MP3_RATES, 0], "((x >> 10) & 3)")}) // {_RATE} AS rate, CASE WHEN {_V} = 3 THEN {_AT(pcm.MP3_KBPS_V1, "((x >> 12) & 15)")} ELSE {_AT(pcm.MP3_KBPS_V2, "((x >> 12) & 15)")} END AS kb FROM w)
SELECT o_orderkey, valid, {_V} AS version, CASE WHEN valid THEN rate END AS sample_rate, CASE WHEN valid THEN kb END AS kbps, CASE WHEN ((x >> 6) & 3) = 3 THEN 1 ELSE 2 END AS channels,
CASE WHEN valid THEN ((CASE WHEN {_V} = 3 THEN 144000 ELSE 72000 END) * kb) // greatest(rate, 1) + ((x >> 9) & 1) END AS frame_bytes FROM f""")
def mp3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "orders").select("o_orderkey", (4292870144 + (F.col("o_orderkey") * 2654435761) % 2097152).alias("x"))
    return w.select("o_orderkey", *(c.alias(n) for n, c in pcm.mp3_fields(F.col("x")).items()))


@query("""WITH w AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4503599627370496 AS x FROM orders)
SELECT o_orderkey, (x >> 32) & 1048575 AS sample_rate, ((x >> 29) & 7) + 1 AS channels, ((x >> 24) & 31) + 1 AS bits_per_sample, x & 16777215 AS total FROM w""")
def flac_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    w = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 2654435761) % 4503599627370496).alias("x"))
    return w.select("o_orderkey", pcm.bits(x, 32, 20).alias("sample_rate"), (pcm.bits(x, 29, 3) + 1).alias("channels"), (pcm.bits(x, 24, 5) + 1).alias("bits_per_sample"), pcm.bits(x, 0, 24).alias("total"))


# --- spectrum ---


@query(f"""WITH {FRAMES}, long AS (SELECT stream_id, frame_no // 16 AS frame_no, unnest(range(64)) AS band, unnest(bands) AS value FROM frames)
SELECT stream_id, frame_no, CAST(band AS INTEGER) AS band, max(value) AS value FROM long GROUP BY ALL""")
def spectrum_peak_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.long_form(spectrum.peak_hold(frames(spark, sf_dir)))


@query(f"""WITH {FRAMES}, total AS (SELECT stream_id, count(*) AS nf FROM frames GROUP BY 1),
spots AS (SELECT stream_id, nf, least(400.0, nf * 12.0 - 30) AS span, c FROM total, range(5) AS r(c) WHERE 30 < nf * 12.0),
f AS (SELECT stream_id, c, least(CAST(floor((30 + c / 5.0 * span) / 12.0) AS BIGINT), nf - 1) AS f0, least(CAST(floor((30 + (c + 1) / 5.0 * span) / 12.0) AS BIGINT), nf - 1) AS f1 FROM spots),
long AS (SELECT stream_id, frame_no, unnest(range(64)) AS band, unnest(bands) AS value FROM frames)
SELECT f.stream_id, CAST(c AS INTEGER) AS "column", CAST(band AS INTEGER) AS band, max(value) AS value FROM f JOIN long l ON l.stream_id = f.stream_id AND l.frame_no BETWEEN f0 AND greatest(f0, f1) GROUP BY ALL""")
def spectrum_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spectrum.range_query(frames(spark, sf_dir), 30, 400, 5, 12.0)
    return q.select("stream_id", "column", F.posexplode("bands").alias("band", "value"))


EDGES = """edges AS (SELECT b AS band, least(greatest(CAST(floor(40 * pow(400.0, b / 64.0) / (44100 / 1024.0)) AS BIGINT), 1), 511) AS k0,
  least(greatest(CAST(ceil(40 * pow(400.0, (b + 1) / 64.0) / (44100 / 1024.0)) AS BIGINT), 1), 511) AS k1 FROM range(64) AS r(b))"""


@query(f"WITH {EDGES} SELECT band, k0, greatest(k0, k1) AS k1 FROM edges")
def spectrum_band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.band_edges(spark, 44100)


@query(f"""WITH {FRAMES}, bins AS (SELECT stream_id, frame_no, unnest(range(64)) AS k, unnest(bands) AS x FROM frames), {EDGES.replace("range(64) AS r(b)", "range(64) AS r(b) WHERE b < 30")},
sums AS (SELECT stream_id, frame_no, band, sum(CAST(x AS DOUBLE) * x) AS energy FROM bins JOIN edges ON k BETWEEN k0 AND greatest(k0, k1) GROUP BY ALL)
SELECT stream_id, frame_no, band, energy, CAST(trunc(least(greatest((10 * log10(energy / 65025.0 + 1e-10) + 96) * (255.0 / 96), 0.0), 255.0)) AS INTEGER) AS level FROM sums""")
def spectrum_band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames(spark, sf_dir).select("stream_id", "frame_no", F.transform("bands", lambda x: x.cast("double")).alias("magnitudes"))
    return spectrum.band_energy(m, spectrum.band_edges(spark, 44100).where("band < 30"), 255.0**2)


@query(f"""WITH {FRAMES}, bins AS (SELECT stream_id, frame_no, unnest(range(64)) AS k, unnest(bands) AS x FROM frames), {EDGES},
sums AS (SELECT f.stream_id, f.frame_no, e.band, coalesce(sum(CAST(x AS DOUBLE) * x), 0) AS energy FROM frames f CROSS JOIN edges e
  LEFT JOIN bins b ON b.stream_id = f.stream_id AND b.frame_no = f.frame_no AND k BETWEEN k0 AND greatest(k0, k1) GROUP BY ALL)
SELECT stream_id, frame_no, band, energy, CAST(trunc(least(greatest((10 * log10(energy / 65025.0 + 1e-10) + 96) * (255.0 / 96), 0.0), 255.0)) AS INTEGER) AS level FROM sums""")
def spectrum_band_energy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 bands, where spectrum_band_energy has 30; those past the frame's last bin have no energy."""
    m = frames(spark, sf_dir).select("stream_id", "frame_no", F.transform("bands", lambda x: x.cast("double")).alias("magnitudes"))
    return spectrum.band_energy(m, spectrum.band_edges(spark, 44100), 255.0**2)


# --- tempo ---

FLUX = f"""{FRAMES}, pairs AS (SELECT stream_id, frame_no, bands, coalesce(lag(bands) OVER (PARTITION BY stream_id ORDER BY frame_no), bands) AS before FROM frames),
bins AS (SELECT stream_id, frame_no, unnest(range(64)) AS b, unnest(bands) AS x, unnest(before) AS y FROM pairs),
parts AS (SELECT stream_id, frame_no, sum(CASE WHEN b <= 15 THEN greatest(x - y, 0) ELSE 0 END)::BIGINT AS bass, sum(CASE WHEN b BETWEEN 16 AND 42 THEN greatest(x - y, 0) ELSE 0 END)::BIGINT AS snare,
  sum(CASE WHEN b >= 43 THEN greatest(x - y, 0) ELSE 0 END)::BIGINT AS high FROM bins GROUP BY ALL),
flux AS (SELECT *, CAST(bass AS DOUBLE) + 0.8::DOUBLE * snare + 0.2::DOUBLE * high AS raw FROM parts)"""
NOVELTY = f"{FLUX}, nov AS (SELECT *, greatest(raw - avg(raw) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0) AS novelty FROM flux)"


@query(f"WITH {FLUX} SELECT stream_id, frame_no, bass, snare, high, round(raw, 6) AS raw FROM flux")
def novelty_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.flux(frames(spark, sf_dir)).withColumn("raw", F.round("raw", 6))


@query(f"WITH {NOVELTY} SELECT stream_id, frame_no, round(novelty, 4) AS novelty FROM nov")
def novelty_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.novelty(frames(spark, sf_dir)).select("stream_id", "frame_no", F.round("novelty", 4).alias("novelty"))


@query(f"""WITH {SERIES}, x0 AS (SELECT stream_id, n, CAST(abs(v) AS DOUBLE) AS x, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC) AS back FROM series),
x AS (SELECT stream_id, 512 - back AS k, x FROM x0 WHERE back <= 512), c AS (SELECT stream_id, count(*) AS cnt FROM x GROUP BY 1),
lags AS (SELECT t AS lag, m FROM range(21, 90) AS r(t), (VALUES (1), (2), (4)) AS mm(m)),
prods AS (SELECT a.stream_id, lag, m, sum(a.x * b.x) AS r FROM lags JOIN x a ON a.k < 512 - lag * m JOIN x b ON b.stream_id = a.stream_id AND b.k = a.k + lag * m GROUP BY ALL),
full_ AS (SELECT c.stream_id, cnt, t AS lag FROM c, range(21, 90) AS r(t)),
scored AS (SELECT f.stream_id, cnt, f.lag, round((coalesce(p1.r, 0) + 0.5::DOUBLE * coalesce(p2.r, 0) + 0.25::DOUBLE * coalesce(p4.r, 0)) * exp(-(log2(60.0::DOUBLE * 86.1328125::DOUBLE / f.lag / 120.0::DOUBLE) ** 2) / (2 * 0.8::DOUBLE * 0.8::DOUBLE)), 6) AS score FROM full_ f
  LEFT JOIN prods p1 ON p1.stream_id = f.stream_id AND p1.lag = f.lag AND p1.m = 1 LEFT JOIN prods p2 ON p2.stream_id = f.stream_id AND p2.lag = f.lag AND p2.m = 2 LEFT JOIN prods p4 ON p4.stream_id = f.stream_id AND p4.lag = f.lag AND p4.m = 4),
near AS (SELECT *, lag(score) OVER w AS prev, lead(score) OVER w AS nxt, avg(score) OVER (PARTITION BY stream_id) AS mean FROM scored WINDOW w AS (PARTITION BY stream_id ORDER BY lag)),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, lag) = 1),
fine AS (SELECT *, CASE WHEN abs(2 * (prev - 2 * score + nxt)) > 1e-6 AND abs((prev - nxt) / (2 * (prev - 2 * score + nxt))) <= 1 THEN (prev - nxt) / (2 * (prev - 2 * score + nxt)) ELSE 0 END AS d FROM best)
SELECT stream_id, round(CASE WHEN cnt >= 178 THEN lag + d ELSE 43 END, 4) AS lag, round(CASE WHEN cnt >= 178 THEN 60.0::DOUBLE * 86.1328125::DOUBLE / (lag + d) ELSE 120 END, 4) AS bpm,
 CASE WHEN cnt >= 178 THEN CAST(trunc(least(greatest(CASE WHEN score > mean THEN (score - mean) / (score + 1e-4::DOUBLE) ELSE 0 END * 255, 0), 255)) AS INTEGER) ELSE 0 END AS confidence FROM fine""")
def tempo_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("stream_id", F.col("n").alias("frame_no"), F.abs("v").cast("double").alias("novelty"))
    e = tempo.estimate(tempo.recent_novelty(s), 44100 / 512)
    return e.select("stream_id", F.round("lag", 4).alias("lag"), F.round("bpm", 4).alias("bpm"), "confidence")


@query(f"""WITH RECURSIVE {SERIES}, e AS MATERIALIZED (SELECT stream_id, n, 120 + v / 1000.0 AS bpm FROM series),
fold AS (SELECT stream_id, n, bpm, bpm AS kept, true AS keep FROM e WHERE n = 0
  UNION ALL SELECT e.stream_id, e.n, e.bpm, CASE WHEN abs(e.bpm - f.kept) >= 1.5 THEN e.bpm ELSE f.kept END, abs(e.bpm - f.kept) >= 1.5 FROM fold f JOIN e ON e.stream_id = f.stream_id AND e.n = f.n + 1)
SELECT stream_id, n, bpm FROM fold WHERE keep""")
def tempo_curve_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.curve_points(series(spark, sf_dir).select("stream_id", "n", (120 + F.col("v") / 1000.0).alias("bpm")), 1.5)


@query(f"""WITH RECURSIVE {NOVELTY}, x AS MATERIALIZED (SELECT stream_id, frame_no, novelty, bass - snare AS kick FROM nov),
fold AS (SELECT stream_id, frame_no, CASE WHEN novelty > 30 THEN frame_no END AS last, novelty > 30 AS beat, false AS interpolated, kick FROM x WHERE frame_no = 0
  UNION ALL SELECT x.stream_id, x.frame_no, CASE WHEN b THEN x.frame_no ELSE last END, b, CASE WHEN last IS NULL THEN false ELSE novelty <= 20 END, x.kick FROM fold f JOIN x ON x.stream_id = f.stream_id AND x.frame_no = f.frame_no + 1,
  LATERAL (SELECT CASE WHEN f.last IS NULL THEN x.novelty > 30 ELSE x.frame_no - f.last >= 0.85::DOUBLE * 6 AND (x.novelty > 20 OR x.frame_no - f.last >= 1.15::DOUBLE * 6) END AS b) AS l),
beats AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY frame_no) - 1 AS beat, frame_no, interpolated, kick FROM fold WHERE beat),
phases AS (SELECT stream_id, p AS phase, sum(CASE WHEN beat % 4 = p THEN kick ELSE 0 END) AS s FROM beats, range(4) AS r(p) GROUP BY ALL),
chosen AS (SELECT stream_id, phase FROM phases QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY s DESC, phase) = 1),
moved AS (SELECT b.*, beat - phase AS m FROM beats b JOIN chosen USING (stream_id))
SELECT stream_id, CAST(beat AS INTEGER) AS beat, frame_no, CASE WHEN m >= 0 THEN m // 4 + 1 ELSE 0 END AS bar_index, CASE WHEN m >= 0 THEN m % 4 + 1 ELSE 4 + m + 1 END AS beat_within_bar, interpolated, m >= 0 AND m % 4 = 0 AS downbeat FROM moved""")
def beat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.beat_grid(tempo.novelty(frames(spark, sf_dir)), 6.0)


CURVE = "curve AS (SELECT stream_id, n * 700 AS time_ms, n // 3 AS beat, 120 + v / 1000.0 AS bpm FROM series WHERE n % 3 = 1)"
PROBES = "probes AS (SELECT stream_id, n * 450 AS t FROM series)"


def _curve(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = series(spark, sf_dir)
    return s.where("n % 3 = 1").select("stream_id", (F.col("n") * 700).alias("time_ms"), F.call_function("div", F.col("n"), F.lit(3).cast("long")).alias("beat"), (120 + F.col("v") / 1000.0).alias("bpm")), s.select("stream_id", (F.col("n") * 450).alias("t"))


AS_OF = f"""WITH {SERIES}, {CURVE}, {PROBES}, nexts AS (SELECT *, lead(time_ms) OVER w AS n_time, lead(bpm) OVER w AS n_bpm, lead(beat) OVER w AS n_beat FROM curve WINDOW w AS (PARTITION BY stream_id ORDER BY time_ms)),
firsts AS (SELECT stream_id, arg_min(bpm, time_ms) AS f_bpm, min(time_ms) AS f_time, min(beat) AS f_beat FROM curve GROUP BY 1),
j AS (SELECT p.stream_id, p.t, c.time_ms, c.bpm, c.beat, n_time, n_bpm, n_beat, f_bpm, f_time, f_beat FROM probes p JOIN firsts f ON f.stream_id = p.stream_id ASOF LEFT JOIN nexts c ON c.stream_id = p.stream_id AND p.t >= c.time_ms)"""


@query(f"{AS_OF} SELECT stream_id, t, round(coalesce(bpm + (t - time_ms) / CAST(n_time - time_ms AS DOUBLE) * (n_bpm - bpm), bpm, f_bpm), 6) AS bpm FROM j")
def bpm_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.bpm_at(*_curve(spark, sf_dir)).withColumn("bpm", F.round("bpm", 6))


@query(f"{AS_OF} SELECT stream_id, t, round(CASE WHEN beat IS NULL THEN 0 ELSE beat + coalesce((t - time_ms) / CAST(n_time - time_ms AS DOUBLE), 0) END, 6) AS position FROM j")
def time_to_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tempo.time_to_beat(*_curve(spark, sf_dir)).withColumn("position", F.round("position", 6))
    # Streams without beats have no position.
    return f.join(_curve(spark, sf_dir)[0].select("stream_id").distinct(), "stream_id", "left_semi")


@query(f"""{AS_OF} SELECT stream_id, t, CASE WHEN beat IS NULL OR n_time - t < t - time_ms THEN coalesce(n_beat, f_beat) ELSE beat END AS beat, CASE WHEN beat IS NULL OR n_time - t < t - time_ms THEN coalesce(n_time, f_time) ELSE time_ms END AS time_ms FROM j""")
def nearest_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.nearest_beat(*_curve(spark, sf_dir))


@query(f"""WITH {SERIES}, {CURVE}, nexts AS (SELECT *, lead(time_ms) OVER (PARTITION BY stream_id ORDER BY beat) AS n_time, max(beat) OVER (PARTITION BY stream_id) AS last FROM curve),
p AS (SELECT stream_id, n / 8.0 AS position FROM series)
SELECT p.stream_id, position, time_ms + coalesce(CAST(trunc((position - beat) * (n_time - time_ms)) AS BIGINT), 0) AS time_ms FROM p JOIN nexts c ON c.stream_id = p.stream_id AND c.beat = least(CAST(floor(position) AS BIGINT), last)""")
def beat_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.beat_to_time(_curve(spark, sf_dir)[0], series(spark, sf_dir).select("stream_id", (F.col("n") / 8.0).alias("position")))


@query(f"WITH {SERIES}, {CURVE} SELECT * FROM curve WHERE time_ms >= 5000 AND time_ms < 35000 QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY time_ms, beat) <= 7")
def beats_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo.beats_in_range(_curve(spark, sf_dir)[0], 5000, 30000, 7)


# --- slices ---

HOPS = f"""{SERIES}, high AS (SELECT stream_id, n, v, n // 4 AS hop, abs(v - 0.95::DOUBLE * coalesce(lag(v) OVER (PARTITION BY stream_id ORDER BY n), 0)) AS h FROM series),
hops AS (SELECT stream_id, hop, sum(h) AS energy FROM high GROUP BY ALL HAVING count(*) = 4),
nov AS (SELECT *, greatest(energy - coalesce(lag(energy) OVER (PARTITION BY stream_id ORDER BY hop), 0), 0) AS novelty FROM hops),
stats AS (SELECT *, coalesce(avg(novelty) OVER w, 0) AS mean, coalesce(stddev_pop(novelty) OVER w, 0) AS deviation FROM nov WINDOW w AS (PARTITION BY stream_id ORDER BY hop ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))"""
HITS = f"""{HOPS}, hot AS (SELECT * FROM stats WHERE novelty > mean + 2.0 * deviation + 500 AND novelty > 2000),
peaks AS (SELECT h.stream_id, h.hop, arg_max(n, abs(v) * 1000000 - n) AS peak FROM hot h JOIN high s ON s.stream_id = h.stream_id AND s.hop = h.hop GROUP BY ALL),
crossings AS (SELECT stream_id, n FROM (SELECT stream_id, n, v, lag(v) OVER (PARTITION BY stream_id ORDER BY n) AS b FROM series) WHERE (b <= 0 AND v >= 0) OR (b >= 0 AND v <= 0)),
snapped AS (SELECT p.stream_id, p.hop, p.peak, coalesce(max(c.n), p.peak) AS snapped FROM peaks p LEFT JOIN crossings c ON c.stream_id = p.stream_id AND c.n <= p.peak AND c.n > p.peak - 64 GROUP BY p.stream_id, p.hop, p.peak)"""


@query(f"WITH {HOPS} SELECT stream_id, hop, round(energy, 4) AS energy FROM hops")
def slice_hop_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.hop_energy(series(spark, sf_dir), 4).withColumn("energy", F.round("energy", 4))


@query(f"WITH {HOPS} SELECT stream_id, hop, round(novelty, 4) AS novelty FROM nov")
def slice_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.hop_novelty(slices.hop_energy(series(spark, sf_dir), 4)).select("stream_id", "hop", F.round("novelty", 4).alias("novelty"))


@query(f"WITH {HOPS} SELECT stream_id, hop, round(mean, 3) AS mean, round(deviation, 3) AS deviation FROM stats")
def slice_rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = slices.rolling(slices.hop_novelty(slices.hop_energy(series(spark, sf_dir), 4)))
    return r.select("stream_id", "hop", F.round("mean", 3).alias("mean"), F.round("deviation", 3).alias("deviation"))


@query(f"WITH {HITS} SELECT * FROM snapped")
def slice_zero_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    hot = slices.candidates(slices.rolling(slices.hop_novelty(slices.hop_energy(s, 4))))
    return slices.zero_crossings(s, slices.peaks(s, hot, 4))


ONSETS = f"""{HITS}, ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY hop) AS i FROM snapped),
fold AS (SELECT stream_id, i, snapped AS last, true AS keep FROM ordered WHERE i = 1
  UNION ALL SELECT o.stream_id, o.i, CASE WHEN o.hop * 4 - f.last >= 12 THEN o.snapped ELSE f.last END, o.hop * 4 - f.last >= 12 FROM fold f JOIN ordered o ON o.stream_id = f.stream_id AND o.i = f.i + 1),
hits AS (SELECT stream_id, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY i) - 1 AS INTEGER) AS k, last AS start_sample FROM fold WHERE keep), totals AS (SELECT stream_id, count(*) AS total FROM series GROUP BY 1)"""


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.onsets(series(spark, sf_dir), 12, hop=4)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("total"))


@query(f"WITH RECURSIVE {ONSETS} SELECT * FROM hits")
def slice_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _onsets(spark, sf_dir)


MUSICAL = "musical_tick, CAST(36 + k % 64 AS BIGINT) AS midi_note, (musical_tick // 1920) & 255 AS bar_index, musical_tick % 1920 // 480 AS beat_within_bar, musical_tick % 480 // 120 AS subdivision"
LENGTHS = "coalesce(lead(start_sample) OVER (PARTITION BY stream_id ORDER BY k), total) - start_sample AS length_samples"
GRID = f"""{SERIES}, totals AS (SELECT stream_id, count(*) AS total FROM series GROUP BY 1), ks AS (SELECT stream_id, total, k, CAST(trunc(k * 12.5) AS BIGINT) AS start_sample, k * 120 AS musical_tick FROM totals, range(256) AS r(k) WHERE k < CAST(floor(total / 12.5) AS BIGINT)),
grid AS (SELECT *, least(length_samples * 1000 // 100, 65535) AS decay_ms FROM (SELECT stream_id, k, start_sample, {MUSICAL}, {LENGTHS} FROM ks))"""
QUANTIZED = f"""{ONSETS}, starts AS (SELECT stream_id, start_sample FROM hits UNION ALL SELECT stream_id, 0 FROM hits GROUP BY stream_id HAVING min(start_sample) > 0),
numbered AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_sample) - 1 AS k, start_sample, CAST(floor((start_sample * (120.0::DOUBLE * 480 / (60.0::DOUBLE * 100)) + 60) / 120) AS BIGINT) * 120 AS musical_tick FROM starts),
quantized AS (SELECT *, least(length_samples * 1000 // 100, 65535) AS decay_ms FROM (SELECT stream_id, k, start_sample, {MUSICAL}, {LENGTHS} FROM numbered JOIN totals USING (stream_id) WHERE k < 256))"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.grid(_totals(spark, sf_dir), 100)


def _quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.quantize(_onsets(spark, sf_dir), _totals(spark, sf_dir), 100)


@query(f"WITH {GRID} SELECT * FROM grid")
def slice_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(f"WITH RECURSIVE {QUANTIZED} SELECT * FROM quantized")
def slice_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantized(spark, sf_dir)


@query(f"""WITH RECURSIVE {QUANTIZED} SELECT p.stream_id, p.n AS "at", q.k FROM series p LEFT JOIN quantized q ON q.stream_id = p.stream_id AND p.n >= q.start_sample AND p.n < q.start_sample + q.length_samples""")
def slice_at_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.at_sample(_quantized(spark, sf_dir), series(spark, sf_dir).select("stream_id", F.col("n").alias("at")))


@query(f"""WITH RECURSIVE {QUANTIZED} SELECT p.stream_id, p.n * 7 AS "at", max(q.k) AS k FROM series p LEFT JOIN quantized q ON q.stream_id = p.stream_id AND q.musical_tick <= p.n * 7 GROUP BY ALL""")
def slice_at_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.at_tick(_quantized(spark, sf_dir), series(spark, sf_dir).select("stream_id", (F.col("n") * 7).alias("at")))


@query(f"WITH {GRID}, p AS (SELECT stream_id, k, length_samples, length_samples * {120 << 16} // {97 << 16} AS i FROM grid) SELECT stream_id, k, i AS interval_samples, greatest(i, length_samples) AS render_samples, i > length_samples AS needs_tail FROM p")
def slice_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.playback(_grid(spark, sf_dir), 120 << 16, 97 << 16)


@query()
def slice_midi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.midi(_quantized(spark, sf_dir)).withColumn("midi", F.hex("midi"))


# --- coding ---

LAGGED = f"""{ITEMS}, lags AS (SELECT stream_id, n // 256 AS block_no, v, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c, lag(v, 4) OVER w AS d FROM items WINDOW w AS (PARTITION BY stream_id, n // 256 ORDER BY n))"""


@query(f"""WITH {LAGGED}, sums AS (SELECT stream_id, block_no, CAST(sum(abs(v)) AS BIGINT) AS s0, CAST(sum(abs(v - a)) AS BIGINT) AS s1, CAST(sum(abs(v - 2 * a + b)) AS BIGINT) AS s2, CAST(sum(abs(v - 3 * a + 3 * b - c)) AS BIGINT) AS s3, CAST(sum(abs(v - 4 * a + 6 * b - 4 * c + d)) AS BIGINT) AS s4 FROM lags WHERE d IS NOT NULL GROUP BY ALL)
SELECT stream_id, block_no, CASE least(s0, s1, s2, s3, s4) WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 ELSE 4 END AS "order", s0, s1, s2, s3, s4 FROM sums""")
def flac_fixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.fixed_order(items(spark, sf_dir), 256)


@query(f"""WITH {LAGGED}, r AS (SELECT stream_id, block_no, CASE WHEN v - a >= 0 THEN (v - a) * 2 ELSE (v - a) * -2 - 1 END AS u FROM lags WHERE a IS NOT NULL),
costs AS (SELECT stream_id, block_no, CAST(k AS INTEGER) AS k, CAST(sum((u >> k) + 1 + k) AS BIGINT) AS bits FROM r, range(15) AS x(k) GROUP BY ALL)
SELECT * FROM costs QUALIFY row_number() OVER (PARTITION BY stream_id, block_no ORDER BY bits, k) = 1""")
def flac_rice_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id", "block_no").orderBy("n")
    r = items(spark, sf_dir).select("stream_id", pcm.div("n", 256).alias("block_no"), "n", "v").withColumn("r", F.col("v") - F.lag("v").over(w))
    return coding.rice_parameter(r.where("r IS NOT NULL").select("stream_id", "block_no", "r"))


@query(f"""WITH {ITEMS}, p AS (SELECT stream_id, n // 64 AS block_no, v AS l, qty * 1000 AS r FROM items), s AS (SELECT stream_id, block_no, CAST(sum(abs(l)) AS BIGINT) AS a, CAST(sum(abs(r)) AS BIGINT) AS b, CAST(sum(abs(l - r)) AS BIGINT) AS s, CAST(sum(abs((l + r) >> 1)) AS BIGINT) AS m FROM p GROUP BY ALL),
c AS (SELECT *, least(a + b, a + s, s + b, m + s) AS cost FROM s) SELECT stream_id, block_no, CASE cost WHEN a + b THEN 0 WHEN a + s THEN 1 WHEN s + b THEN 2 ELSE 3 END AS mode, cost FROM c""")
def flac_stereo_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.stereo_mode(items(spark, sf_dir).select("stream_id", pcm.div("n", 64).alias("block_no"), F.col("v").alias("l"), (F.col("qty") * 1000).alias("r")))


@query(f"""WITH {ITEMS}, b AS (SELECT stream_id, n // 256 AS block_no, n % 256 AS i, v, count(*) OVER (PARTITION BY stream_id, n // 256) AS m FROM items),
x AS (SELECT stream_id, block_no, i, v * 0.5::DOUBLE * (1 - cos(2 * 3.141592653589793::DOUBLE * i / m)) AS x FROM b)
SELECT a.stream_id, a.block_no, CAST(k AS INTEGER) AS lag, round(sum(coalesce(a.x * c.x, 0)) / 1e6, 2) AS r FROM x a CROSS JOIN range(5) AS r(k) LEFT JOIN x c ON c.stream_id = a.stream_id AND c.block_no = a.block_no AND c.i = a.i - k GROUP BY ALL""")
def flac_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.autocorrelation(items(spark, sf_dir), 4, 256).withColumn("r", F.round(F.col("r") / 1e6, 2))


@query(f"WITH {PACKETS} SELECT stream_id, n AS sample_no, n // 3 AS chunk_no, CAST(coalesce(sum(size) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 48 AS BIGINT) AS \"offset\", size FROM packets")
def mp4_sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.sample_index(packets(spark, sf_dir), 3, 48)


@query(f"""WITH {PACKETS}, chunks AS (SELECT stream_id, n // 3 + 1 AS chunk_no, (n // 3 + 1) * 1000000 AS o, count(*) AS c FROM packets GROUP BY ALL)
SELECT p.stream_id, p.n AS sample_no, CAST(o + coalesce(sum(size) OVER (PARTITION BY p.stream_id, chunk_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", size FROM packets p JOIN chunks c ON c.stream_id = p.stream_id AND c.chunk_no = n // 3 + 1""")
def mp4_expand_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    c = p.groupBy("stream_id", (pcm.div("n", 3) + 1).alias("chunk_no")).agg(F.count("*").alias("per_chunk"))
    chunks = c.select("stream_id", "chunk_no", (F.col("chunk_no") * 1000000).alias("chunk_offset"))
    from pyspark.sql import Window

    before = F.lag("per_chunk").over(Window.partitionBy("stream_id").orderBy("chunk_no"))
    runs = c.withColumn("before", before).where("before IS NULL OR before != per_chunk").select("stream_id", F.col("chunk_no").alias("first_chunk"), "per_chunk")
    return coding.expand_sample_table(chunks, runs, p.select("stream_id", F.col("n").alias("sample_no"), "size"))


LACES = f"""{PACKETS}, s AS (SELECT stream_id, n, size, unnest(range(size // 255 + 1)) AS i FROM packets),
laces AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY n, i) - 1 AS segment_no, n, least(size - i * 255, 255) AS lace FROM s)"""


@query(f"WITH {LACES} SELECT * FROM laces")
def ogg_lacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.lacing(packets(spark, sf_dir))


@query(f"WITH {PACKETS} SELECT stream_id, n, size, size // 255 + 1 AS segments FROM packets")
def ogg_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.packets_of(coding.lacing(packets(spark, sf_dir)).drop("n"))


@query(f"""WITH {ITEMS}, b AS (SELECT stream_id, n AS band, qty // 20 AS book FROM items), c AS (SELECT *, CASE WHEN book = lag(book) OVER w THEN 0 ELSE 1 END AS ch FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY band)),
d AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY stream_id ORDER BY band) - 1 AS BIGINT) AS section FROM c) SELECT stream_id, section, min(band) AS first, count(*) AS length, min(book) AS book FROM d GROUP BY stream_id, section""")
def aac_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.sections(items(spark, sf_dir).select("stream_id", F.col("n").alias("band"), pcm.div("qty", 20).alias("book")))


ATTACKS = f"""{SERIES}, x AS (SELECT stream_id, n // 2 AS sub, n, v / 8192.0::DOUBLE AS x FROM series), d AS (SELECT stream_id, sub, x - 0.95::DOUBLE * coalesce(lag(x) OVER (PARTITION BY stream_id, sub ORDER BY n), 0) AS d FROM x),
e AS (SELECT stream_id, sub, sum(d * d) AS energy FROM d GROUP BY ALL HAVING count(*) = 2), f AS (SELECT stream_id, sub // 4 - k AS frame_no, sub - (sub // 4 - k) * 4 AS b, energy FROM e, (VALUES (0), (1)) AS t(k) WHERE sub // 4 - k >= 0),
g AS (SELECT *, lag(energy) OVER w AS p, sum(CASE WHEN b = 0 THEN greatest(energy, 1e-5::DOUBLE) ELSE energy END) OVER (PARTITION BY stream_id, frame_no ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM f WINDOW w AS (PARTITION BY stream_id, frame_no ORDER BY b)),
h AS (SELECT stream_id, frame_no, max(b > 0 AND energy > 1e-3::DOUBLE AND energy > 8 * greatest(p, s / b, 1e-4::DOUBLE)) AS jump, arg_min(energy, b) AS first, arg_max(energy, b) AS last FROM g GROUP BY ALL HAVING count(*) = 8),
i AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY stream_id ORDER BY frame_no), 0) AS before FROM h),
attacks AS MATERIALIZED (SELECT stream_id, frame_no, jump OR (before > 1e-4::DOUBLE AND first > 8 * before AND first > 1e-3::DOUBLE) AS attack FROM i)"""


@query(f"""WITH RECURSIVE {ATTACKS}, fold AS (SELECT stream_id, frame_no, CASE WHEN attack THEN 1 ELSE 0 END AS shape FROM attacks WHERE frame_no = 0
  UNION ALL SELECT a.stream_id, a.frame_no, CASE f.shape WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN a.attack THEN 2 ELSE 3 END ELSE CASE WHEN a.attack THEN 1 ELSE 0 END END FROM fold f JOIN attacks a ON a.stream_id = f.stream_id AND a.frame_no = f.frame_no + 1)
SELECT * FROM fold""")
def aac_window_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("stream_id", "n", (F.col("v") / 8192.0).alias("x"))
    return blocks.window_sequence(blocks.attacks(blocks.subblock_energies(s, 2)))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round(x * 1000) AS DOUBLE)) AS x FROM embeddings), e AS (SELECT id AS entry, x AS y FROM v WHERE id < 16),
d AS (SELECT id, entry, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v, e) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, entry) = 1""")
def vq_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x * 1000).cast("double")).alias("x"))
    return coding.nearest_entry(v, v.where("id < 16").select(F.col("id").alias("entry"), F.col("x").alias("y")))


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("data"))


@query()
def crc_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload(spark, sf_dir).select("doc_id", *(checksums.crc_udf(k)("data").alias(k) for k in checksums.CRC))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def md5_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payload(spark, sf_dir).select("doc_id", F.md5("data").alias("md5"))
