"""MP4 with one AAC track: box walk, sample index, AudioSpecificConfig, and a writer with one sample per chunk."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.bits import Reader
from ..functions.pcm import ADTS_RATES


class BadMovie(ValueError):
    pass


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and end of the content of each box; sizes of 64 bits and "to the end" included."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def find(data: bytes, path: list[bytes], start: int, end: int) -> tuple[int, int] | None:
    for kind, a, b in boxes(data, start, end):
        if kind == path[0]:
            inner = (a, b) if len(path) == 1 else find(data, path[1:], a, b)
            if inner:
                return inner
    return None


@dataclass
class AudioConfig:
    object_type: int
    rate: int
    channels: int

    def pack(self) -> bytes:
        kind = self.object_type or 2
        word, width = (kind, 5) if kind < 31 else (31 << 6 | kind - 32, 11)
        index = ADTS_RATES.index(self.rate) if self.rate in ADTS_RATES else 15
        word, width = word << 4 | index, width + 4
        if index == 15:
            word, width = word << 24 | self.rate, width + 24
        word, width = word << 7 | self.channels << 3, width + 7
        pad = -width % 8
        return (word << pad).to_bytes((width + pad) // 8, "big")


def parse_config(data: bytes) -> AudioConfig:
    """An AudioSpecificConfig; with an extension type the core type counts."""
    try:
        r = Reader(data)
        kind = r.get(5)
        kind = 32 + r.get(6) if kind == 31 else kind
        index = r.get(4)
        rate = r.get(24) if index == 15 else ADTS_RATES[index]
        channels = r.get(4)
        if kind in (5, 29) and len(r.text) - r.at >= 9:
            if r.get(4) == 15:
                r.get(24)
            kind = r.get(5)
            kind = 32 + r.get(6) if kind == 31 else kind
        return AudioConfig(kind, rate, channels)
    except (EOFError, IndexError):
        raise BadMovie("audio configuration") from None


def _descriptors(data: bytes, at: int, end: int) -> bytes | None:
    """The decoder's specific information (tag 5) within nested descriptors."""
    while at < end:
        tag, at, size = data[at], at + 1, 0
        for _ in range(4):
            size, more, at = size << 7 | data[at] & 127, data[at] & 128, at + 1
            if not more:
                break
        if tag == 5:
            return data[at : at + size]
        skip = {3: 3, 4: 13}.get(tag)
        if tag == 3:
            flags = data[at + 2]
            skip += 2 * bool(flags & 128) + 2 * bool(flags & 32) + (1 + data[at + 3] if flags & 64 else 0)
        if skip is not None:
            found = _descriptors(data, at + skip, at + size)
            if found is not None:
                return found
        at += size
    return None


def _table(data: bytes, span: tuple[int, int], fields: int, wide: bool = False) -> list[tuple[int, ...]]:
    a, b = span
    n, size = struct.unpack_from(">I", data, a + 4)[0], (8 if wide else 4) * fields
    if a + 8 + n * size > b:
        raise BadMovie("table is cut off")
    return [struct.unpack_from(f">{fields}{'Q' if wide else 'I'}", data, a + 8 + k * size) for k in range(n)]


@dataclass
class Movie:
    config: AudioConfig
    samples: list[tuple[int, int]]  # offset, size


def _track(data: bytes, a: int, b: int) -> Movie:
    stbl = find(data, [b"mdia", b"minf", b"stbl"], a, b)
    stsd = stbl and find(data, [b"stsd"], *stbl)
    if not stsd:
        raise BadMovie("no sample table")
    entry = find(data, [b"mp4a"], stsd[0] + 8, stsd[1])
    esds = entry and find(data, [b"esds"], entry[0] + 28, entry[1])
    config = esds and _descriptors(data, esds[0] + 4, esds[1])
    if not config:
        raise BadMovie("no AAC track")
    get = lambda kind: find(data, [kind], *stbl)
    stsz, stsc, stco, co64 = get(b"stsz"), get(b"stsc"), get(b"stco"), get(b"co64")
    if not stsz or not stsc or not (stco or co64):
        raise BadMovie("no sample table")
    fixed, n = struct.unpack_from(">II", data, stsz[0] + 4)
    sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, stsz[0] + 12)) if stsz[0] + 12 + 4 * n <= stsz[1] else None
    if sizes is None:
        raise BadMovie("table is cut off")
    chunks = [c for (c,) in (_table(data, stco, 1) if stco else _table(data, co64, 1, True))]
    runs = _table(data, stsc, 3)
    out: list[tuple[int, int]] = []
    run = 0
    for k, offset in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= k:
            run += 1
        for _ in range(runs[run][1] if runs else 0):
            if len(out) == n:
                break
            size = sizes[len(out)]
            if offset + size > len(data):
                raise BadMovie("a sample lies outside the file")
            out.append((offset, size))
            offset += size
    return Movie(parse_config(config), out)


def read(data: bytes) -> Movie:
    """The first track that can be read."""
    moov = find(data, [b"moov"], 0, len(data))
    if not moov:
        raise BadMovie("no moov box")
    for kind, a, b in boxes(data, *moov):
        if kind == b"trak":
            try:
                return _track(data, a, b)
            except (BadMovie, struct.error, IndexError):
                continue
    raise BadMovie("no AAC track")


def samples(data: bytes) -> list[bytes]:
    return [data[o : o + n] for o, n in read(data).samples]


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _descriptor(tag: int, body: bytes) -> bytes:
    return bytes([tag, len(body)]) + body


def write(frames: list[bytes], rate: int, channels: int, kbps: int = 128) -> bytes:
    """ftyp, mdat, moov: one sample per chunk, each of 1024 time units."""
    u32 = lambda *v: struct.pack(f">{len(v)}I", *v)
    ftyp = _box(b"ftyp", b"M4A ", u32(0), b"M4A mp42isom")
    offsets, at = [], len(ftyp) + 8
    for f in frames:
        offsets.append(at)
        at += len(f)
    length, n = 1024 * len(frames), len(frames)
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    config = AudioConfig(2, rate, channels).pack()
    decoder = _descriptor(4, b"\x40\x15\x00\x06\x00" + u32(kbps * 1000, kbps * 1000) + _descriptor(5, config))
    esds = _full(b"esds", 0, _descriptor(3, b"\0\1\0" + decoder + _descriptor(6, b"\2")))
    mp4a = _box(b"mp4a", bytes(6), b"\0\1", bytes(8), struct.pack(">HHHHI", channels, 16, 0, 0, rate << 16 & 0xFFFFFFFF), esds)
    stbl = _box(
        b"stbl",
        _full(b"stsd", 0, u32(1), mp4a),
        _full(b"stts", 0, u32(1, n, 1024) if n else u32(0)),
        _full(b"stsz", 0, u32(0, n, *map(len, frames))),
        _full(b"stsc", 0, u32(1, 1, 1, 1) if n else u32(0)),
        _full(b"stco", 0, u32(n, *offsets)),
    )
    minf = _box(b"minf", _full(b"smhd", 0, u32(0)), _box(b"dinf", _full(b"dref", 0, u32(1), _full(b"url ", 1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", 0, u32(0, 0, rate, length), b"\x55\xc4\0\0"), _full(b"hdlr", 0, u32(0), b"soun", bytes(12), b"SoundHandler\0"), minf)
    tkhd = _full(b"tkhd", 7, u32(0, 0, 1, 0, length), bytes(8), b"\0\0\0\0\1\0\0\0", matrix, u32(0, 0))
    mvhd = _full(b"mvhd", 0, u32(0, 0, rate, length, 0x10000), b"\1\0\0\0", bytes(8), matrix, bytes(24), u32(2))
    return ftyp + _box(b"mdat", *frames) + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))
