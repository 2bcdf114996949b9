"""Round trips through containers and codecs over driver tables: what comes back must be what SQL reads from the table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import envelope, spectrum
from ..sources import adts, audio, mp4, ogg, sidecars
from .catalogue import LOD0, LOD1, query
from .shapes import ITEMS, SERIES, items, series, table

I16 = f"WITH {ITEMS} SELECT CAST(stream_id AS VARCHAR) AS stream_id, n, CAST(0 AS INTEGER) AS ch, CAST(v % 65536 - 32768 AS INTEGER) AS v FROM items"


def _through(spark: SparkSession, sf_dir: str, kind: str, **options) -> DataFrame:
    s = items(spark, sf_dir).select("stream_id", "n", (F.col("v") % 65536 - 32768).alias("v"))
    return audio.samples(audio.decode(audio.encode(audio.numbered(s, "v", 4096), kind, **options)))


@query(I16)
def wav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "wav")


@query(I16)
def wav_s24_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "wav", name="s24")


@query(I16)
def aiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "aiff")


@query(I16)
def aiff_le_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "aiff", name="s16le")


@query(I16)
def flac_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "flac", block=1152, level=5)


@query(I16)
def flac_parallel_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are cut into frames, and frames are decoded by any task."""
    s = items(spark, sf_dir).select("stream_id", "n", (F.col("v") % 65536 - 32768).alias("v"))
    content = audio.encode(audio.numbered(s, "v", 4096), "flac", block=256, level=0)
    return audio.samples(audio.decode_flac_frames(audio.flac_frame_table(content), 8))


@query(f"WITH {ITEMS} SELECT CAST(stream_id AS VARCHAR) AS stream_id, 'flac' AS container, 44100 AS rate, 1 AS channels, 16 AS bits, 'flac' AS format, count(*) AS frames, CAST(NULL AS VARCHAR) AS error FROM items GROUP BY stream_id")
def flac_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = items(spark, sf_dir).select("stream_id", "n", (F.col("v") % 65536 - 32768).alias("v"))
    return audio.streams(audio.encode(audio.numbered(s, "v", 4096), "flac"))


@query(f"WITH {SERIES} SELECT CAST(stream_id AS VARCHAR) AS stream_id, count(*) AS frames, true AS close FROM series GROUP BY stream_id")
def vorbis_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that come back from a lossy stream, and whether they are within 10 dB below the signal."""
    s = series(spark, sf_dir).select(F.col("stream_id").cast("string").alias("stream_id"), "n", F.greatest(F.least(F.col("v"), F.lit(32767)), F.lit(-32768)).alias("v"))
    back = audio.samples(audio.decode(audio.encode(audio.numbered(s, "v", 4096), "vorbis")))
    both = s.join(back.select("stream_id", "n", F.col("v").alias("w")), ["stream_id", "n"])
    error = F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))
    return both.groupBy("stream_id").agg(F.count("*").alias("frames"), (error * 10 <= F.sum(F.col("v") * F.col("v"))).alias("close"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5 FROM documents")
def ogg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            back = [ogg.packets(ogg.pages(ogg.mux([(t.encode(), 0)], i & 0xFFFFFFFF)))[0].data for i, t in zip(f["doc_id"], f["text"])]
            yield pd.DataFrame({"doc_id": f["doc_id"], "size": [len(b) for b in back], "md5": [hashlib.md5(b).hexdigest() for b in back]})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, size long, md5 string")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS samples, md5(text) AS md5 FROM documents")
def mp4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            back = [mp4.samples(mp4.write(t.encode().split(b"\n"), 44100, 2)) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "samples": [len(b) for b in back], "md5": [hashlib.md5(b"\n".join(b)).hexdigest() for b in back]})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, samples long, md5 string")


@query("SELECT o_orderkey, 44100 AS rate, 2 AS channels, CAST(9 + strlen(o_orderpriority) AS BIGINT) AS frame_bytes, o_orderpriority AS payload FROM orders")
def adts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [adts.frames(b"\xff\x00" + adts.wrap(p.encode(), 44100, 2, protected=True))[0] for p in f["o_orderpriority"]]
            yield pd.DataFrame({"o_orderkey": f["o_orderkey"], "rate": [h.rate for _, h, _ in found], "channels": [h.channels for _, h, _ in found], "frame_bytes": [h.length for _, h, _ in found], "payload": [p.decode() for *_, p in found]})

    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").mapInPandas(run, "o_orderkey long, rate int, channels int, frame_bytes long, payload string")


@query(f"""WITH {SERIES}, {LOD0}, {LOD1}, lod2 AS (SELECT stream_id, chunk_no // 16 AS chunk_no, min(v_min) AS v_min, max(v_max) AS v_max FROM lod1 GROUP BY ALL)
SELECT stream_id, 0 AS lod, chunk_no, v_min, v_max FROM lod0 UNION ALL SELECT stream_id, 1, * EXCLUDE (stream_id) FROM lod1 UNION ALL SELECT stream_id, 2, * EXCLUDE (stream_id) FROM lod2""")
def envelope_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels packed into one sidecar per stream and read back."""
    levels = envelope.pyramid(series(spark, sf_dir), 16, 4)
    rows = None
    for k, e in enumerate(levels):
        e = e.select("stream_id", F.lit(k).alias("lod"), "chunk_no", "v_min", "v_max")
        rows = e if rows is None else rows.union(e)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["lod", "chunk_no"])
        packed = sidecars.Envelope(1000, 16 * int((f["lod"] == 0).sum()), [f.loc[f["lod"] == k, ["v_min", "v_max"]].to_numpy(np.int8) for k in range(3)], 16).pack()
        back = sidecars.Envelope.unpack(packed)
        out = [(f["stream_id"].iloc[0], k, c, int(lo), int(hi)) for k, level in enumerate(back.levels) for c, (lo, hi) in enumerate(level)]
        return pd.DataFrame(out, columns=["stream_id", "lod", "chunk_no", "v_min", "v_max"])

    return rows.groupBy("stream_id").applyInPandas(run, "stream_id long, lod int, chunk_no long, v_min long, v_max long")


@query()
def spectrum_stft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the suppliers' series as 16-bit samples."""
    s = items(spark, sf_dir).select("stream_id", "n", (F.col("v") % 65536 - 32768).alias("v"))
    return spectrum.long_form(spectrum.stft(audio.numbered(s, "v", 4096), 44100))
