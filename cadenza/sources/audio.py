"""Audio files as DataFrames: headers, sample blocks, and files from sample blocks.

Readers take what `spark.read.format("binaryFile")` gives, so any store that Spark reads will do; a file is one row and one task.
pcm(stream_id, block_no, start_frame, rate, channels, samples): samples are interleaved integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.samples import split_round
from . import aac, adts, aiff, flac, mp3, mp4, ogg, vorbis, wav

PCM = "stream_id string, block_no long, start_frame long, rate int, channels int, samples array<int>"
STREAMS = "stream_id string, container string, rate int, channels int, bits int, format string, frames long, error string"
#: Frames in a block: a multiple of the chunks, hops and codec blocks used elsewhere.
BLOCK = 65536

def _aac(frames: list[bytes], rate: int) -> tuple[int, np.ndarray]:
    return rate, split_round(aac.decode(frames, rate)[0], 16)


def _adts(data: bytes) -> tuple[int, np.ndarray]:
    found = adts.frames(data)
    return _aac([p for *_, p in found], found[0][1].rate)


#: The registry of readers: file bytes to (rate, samples of frames x channels).
READERS: dict[str, Callable[[bytes], tuple[int, np.ndarray]]] = {
    "wav": lambda b: (lambda r: (r[0].rate, r[1]))(wav.read(b)),
    "aiff": lambda b: (lambda r: (r[0].rate, r[1]))(aiff.read(b)),
    "flac": lambda b: (lambda r: (r[0].rate, r[1]))(flac.read(b)),
    "ogg": lambda b: (lambda r: (r[0].rate, split_round(r[1], 16)))(vorbis.decode(b)),
    "aac": _adts,
    "mp4": lambda b: _aac(mp4.samples(b), mp4.read(b).config.rate),
    "mp3": lambda b: (lambda r: (r[0], split_round(r[1], 16)))(mp3.decode(b)),
}
#: The registry of writers: (samples, rate, options) to file bytes.
WRITERS: dict[str, Callable[..., bytes]] = {
    "wav": lambda x, rate, **o: wav.write(x.astype(np.int16), rate, **o),
    "aiff": lambda x, rate, **o: aiff.write(x.astype(np.int16), rate, **o),
    "flac": lambda x, rate, **o: flac.write(x, rate, **o),
    "vorbis": lambda x, rate, **o: vorbis.encode(x / 32768.0, rate, **o),
    "aac": lambda x, rate, **o: b"".join(adts.wrap(f, rate, x.shape[1]) for f in aac.encode(x / 32768.0, rate, **o)),
    "mp3": lambda x, rate, **o: mp3.encode(x / 32768.0, rate, **o),
    "mp4": lambda x, rate, **o: mp4.write(aac.encode(x / 32768.0, rate, **o), rate, x.shape[1]),
}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """stream_id (the path) and content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("stream_id"), "content")


def container(head: bytes) -> str:
    for name, test in (("wav", head[:4] in (b"RIFF", b"RF64")), ("aiff", head[:4] == b"FORM"), ("flac", head[:4] == b"fLaC"), ("ogg", head[:4] == b"OggS"), ("mp4", head[4:8] == b"ftyp"), ("aac", adts.parse(head) is not None), ("mp3", head[:3] == b"ID3" or mp3.parse_header(head) is not None)):
        if test:
            return name
    return "unknown"


def _describe(data: bytes) -> tuple:
    kind = container(data[:64])
    try:
        if kind in ("wav", "aiff"):
            i = (wav if kind == "wav" else aiff).parse(data)
            return kind, i.rate, i.channels, i.bits, i.name, i.frames, None
        if kind == "flac":
            i, _ = flac.parse_header(data)
            return kind, i.rate, i.channels, i.bits, "flac", i.total, None
        if kind == "mp4":
            m = mp4.read(data)
            return kind, m.config.rate, m.config.channels, None, "aac", 1024 * len(m.samples), None
        if kind == "aac":
            f = adts.frames(data)
            return kind, f[0][1].rate, f[0][1].channels, None, "aac", 1024 * len(f), None
        if kind == "mp3":
            f = mp3.frames(data)
            if not f:
                raise ValueError("no frame")
            return kind, f[0][1].rate, f[0][1].channels, None, "mp3", sum(576 * h.granules for _, h in f), None
        if kind == "ogg":
            p = ogg.pages(data)
            first = next((x.data for x in ogg.packets(p) if x.data[:7] == b"\1vorbis"), None)
            i = vorbis.unpack_info(first) if first else None
            return kind, i and i.rate, i and i.channels, None, "vorbis" if i else "ogg", max((x.granule for x in p), default=0), None
    except ValueError as e:
        return kind, None, None, None, None, None, str(e)
    return kind, None, None, None, None, None, "unknown container"


def streams(content: DataFrame) -> DataFrame:
    """One row of header fields per file of content(stream_id, content); error says why a file can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, *_describe(bytes(c))) for s, c in zip(f["stream_id"], f["content"])]
            yield pd.DataFrame(rows, columns=["stream_id", "container", "rate", "channels", "bits", "format", "frames", "error"]).astype({"rate": "Int32", "channels": "Int32", "bits": "Int32", "frames": "Int64"})

    return content.mapInPandas(run, STREAMS)


def decode(content: DataFrame, block: int = BLOCK, readers: dict | None = None, errors: str = "skip") -> DataFrame:
    """Sample blocks of files.

    A file that no reader knows or that isn't sound gives no rows (errors="skip"), one row without samples whose column error says
    why (errors="rows", which adds that column), or stops the job (errors="raise").
    """
    known = readers or READERS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sid, c in zip(f["stream_id"], f["content"]):
                data = bytes(c)
                kind = container(data[:64])
                try:
                    if kind not in known:
                        raise ValueError("no reader for it")
                    rate, x = known[kind](data)
                except (ValueError, EOFError, IndexError) as e:
                    why = f"{sid} was not read: {kind}: {e or type(e).__name__}"
                    if errors == "raise":
                        raise ValueError(why) from e
                    if errors == "rows":
                        yield pd.DataFrame({"stream_id": [sid], "block_no": pd.array([None], "Int64"), "start_frame": pd.array([None], "Int64"), "rate": pd.array([None], "Int32"), "channels": pd.array([None], "Int32"), "samples": [None], "error": [why]})
                    continue
                for k, at in enumerate(range(0, len(x), block)):
                    out = pd.DataFrame({"stream_id": [sid], "block_no": [k], "start_frame": [at], "rate": [rate], "channels": [x.shape[1]], "samples": [x[at : at + block].ravel().astype(np.int32)]})
                    yield out.assign(error=None) if errors == "rows" else out

    return content.mapInPandas(run, PCM + ", error string" if errors == "rows" else PCM)


def samples(pcm: DataFrame) -> DataFrame:
    """stream_id, n, ch, v: one row per sample."""
    s = pcm.select("stream_id", "start_frame", "channels", F.posexplode("samples").alias("i", "v"))
    return s.select("stream_id", (F.col("start_frame") + F.call_function("div", F.col("i"), F.col("channels"))).alias("n"), (F.col("i") % F.col("channels")).alias("ch"), "v")


def encode(pcm: DataFrame, to: str, **options) -> DataFrame:
    """stream_id, content: a whole file per stream, so a stream must fit a task, as its file does."""
    write = WRITERS[to]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block_no")
        x = np.concatenate([np.asarray(s) for s in f["samples"]]).reshape(-1, int(f["channels"].iloc[0]))
        return pd.DataFrame({"stream_id": [f["stream_id"].iloc[0]], "content": [write(x, int(f["rate"].iloc[0]), **options)]})

    return pcm.groupBy("stream_id").applyInPandas(run, "stream_id string, content binary")


def flac_frames(pcm: DataFrame, bits: int = 16, level: int = 5) -> DataFrame:
    """stream_id, frame_no, frame: each block is a FLAC frame by itself, so a long stream is encoded by many tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [flac.encode_frame(np.asarray(s).reshape(-1, c), k, bits, level) for s, c, k in zip(f["samples"], f["channels"], f["block_no"])]
            yield pd.DataFrame({"stream_id": f["stream_id"], "frame_no": f["block_no"], "frame": out})

    return pcm.mapInPandas(run, "stream_id string, frame_no long, frame binary")


def flac_frame_table(content: DataFrame) -> DataFrame:
    """stream_id, frame_no, start_frame, block, rate, channels, bits, info, frame: the frames of FLAC files, not decoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sid, c in zip(f["stream_id"], f["content"]):
                data = bytes(c)
                if container(data[:64]) != "flac":
                    continue
                info, spans = flac.frame_spans(data)
                first, rows = 0, []
                for k, (h, a, b) in enumerate(spans):
                    rows.append((sid, k, first, h.block, h.rate, h.channels, h.bits, info.pack(), data[a:b]))
                    first += h.block
                yield pd.DataFrame(rows, columns=["stream_id", "frame_no", "start_frame", "block", "rate", "channels", "bits", "info", "frame"])

    return content.mapInPandas(run, "stream_id string, frame_no long, start_frame long, block int, rate int, channels int, bits int, info binary, frame binary")


def decode_flac_frames(table: DataFrame, parts: int | None = None) -> DataFrame:
    """Sample blocks of flac_frame_table's rows, dealt evenly: a long file is decoded by many tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = [flac.decode_frame(bytes(b), flac.parse_header(b"fLaC\x80\0\0\x22" + bytes(i))[0])[1] for b, i in zip(f["frame"], f["info"])]
            yield pd.DataFrame({"stream_id": f["stream_id"], "block_no": f["frame_no"], "start_frame": f["start_frame"], "rate": f["rate"], "channels": f["channels"], "samples": [v.ravel().astype(np.int32) for v in x]})

    t = table.repartition(parts) if parts else table
    return t.mapInPandas(run, PCM)


def save(content: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes one file per row of content(stream_id, content) below folder, by tasks; gives stream_id, path, bytes.

    folder is a plain path or a URI that pyarrow's filesystems know, in a place that all executors share. A file appears under its
    name only once it is whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        where.create_dir(base, recursive=True)
        for f in frames:
            rows = []
            for sid, c in zip(f["stream_id"], f["content"]):
                path = f"{base}/{sid.rsplit('/', 1)[-1]}{suffix}"
                part = f"{path}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(bytes(c))
                where.move(part, path)
                rows.append((sid, path, len(c)))
            yield pd.DataFrame(rows, columns=["stream_id", "path", "bytes"])

    return content.mapInPandas(run, "stream_id string, path string, bytes long")


def ogg_packets(content: DataFrame) -> DataFrame:
    """stream_id, serial, packet_no, granule, last, data."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sid, c in zip(f["stream_id"], f["content"]):
                rows = [(sid, p.serial, k, p.granule, p.last, p.data) for k, p in enumerate(ogg.packets(ogg.pages(bytes(c))))]
                yield pd.DataFrame(rows, columns=["stream_id", "serial", "packet_no", "granule", "last", "data"])

    return content.mapInPandas(run, "stream_id string, serial long, packet_no long, granule long, last boolean, data binary")


def aac_frames(content: DataFrame) -> DataFrame:
    """stream_id, frame_no, rate, channels, data: raw AAC frames of ADTS and MP4 files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sid, c in zip(f["stream_id"], f["content"]):
                data = bytes(c)
                if container(data[:64]) == "mp4":
                    m = mp4.read(data)
                    rows = [(sid, k, m.config.rate, m.config.channels, data[o : o + n]) for k, (o, n) in enumerate(m.samples)]
                else:
                    rows = [(sid, k, h.rate, h.channels, p) for k, (_, h, p) in enumerate(adts.frames(data))]
                yield pd.DataFrame(rows, columns=["stream_id", "frame_no", "rate", "channels", "data"])

    return content.mapInPandas(run, "stream_id string, frame_no long, rate int, channels int, data binary")


def mp3_frames(content: DataFrame) -> DataFrame:
    """stream_id, frame_no, offset, rate, kbps, channels, bytes: the frames of layer III files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for sid, c in zip(f["stream_id"], f["content"]):
                rows = [(sid, k, at, h.rate, h.kbps, h.channels, h.size) for k, (at, h) in enumerate(mp3.frames(bytes(c)))]
                yield pd.DataFrame(rows, columns=["stream_id", "frame_no", "offset", "rate", "kbps", "channels", "bytes"])

    return content.mapInPandas(run, "stream_id string, frame_no long, offset long, rate int, kbps int, channels int, bytes int")


def numbered(series: DataFrame, value: str, block: int = BLOCK, rate: int = 44100) -> DataFrame:
    """Sample blocks of one channel from rows (stream_id, n, value)."""
    by = F.call_function("div", F.col("n"), F.lit(block).cast("long"))
    s = series.withColumn("block_no", by)
    g = s.groupBy("stream_id", "block_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", value))), lambda x: x[value].cast("int")).alias("samples"))
    return g.select(F.col("stream_id").cast("string").alias("stream_id"), "block_no", (F.col("block_no") * block).alias("start_frame"), F.lit(rate).alias("rate"), F.lit(1).alias("channels"), "samples")
