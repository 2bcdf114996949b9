"""AIFF and AIFF-C: header scan, samples, and whole files from samples."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..functions.samples import Format, decode, encode, from_ieee80, to_ieee80
from .wav import BadFile

#: Compression types and stored formats by name.
FORMATS = {
    "s8": (b"NONE", Format("s", 1, True)),
    "s16": (b"NONE", Format("s", 2, True)),
    "s24": (b"NONE", Format("s", 3, True)),
    "s32": (b"NONE", Format("s", 4, True)),
    "s16le": (b"sowt", Format("s", 2)),
    "s24le": (b"sowt", Format("s", 3)),
    "s32le": (b"sowt", Format("s", 4)),
    "f32": (b"fl32", Format("f", 4, True)),
    "alaw": (b"alaw", Format("a", 1)),
    "mulaw": (b"ulaw", Format("m", 1)),
}


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    compression: bytes
    name: str
    frames: int
    data_at: int
    data_bytes: int

    @property
    def format(self) -> Format:
        return FORMATS[self.name][1]


def _name(aifc: bool, compression: bytes, bits: int) -> str:
    by_depth = "s8" if bits <= 8 else "s16" if bits <= 16 else "s24" if bits <= 24 else "s32"
    if not aifc or compression == b"NONE":
        return by_depth
    if compression == b"sowt":
        return "s16le" if bits <= 16 else "s24le" if bits <= 24 else "s32le"
    return {b"fl32": "f32", b"FL32": "f32", b"alaw": "alaw", b"ALAW": "alaw", b"ulaw": "mulaw", b"ULAW": "mulaw", b"in24": "s24", b"in32": "s32"}.get(compression, by_depth)


def parse(data: bytes) -> Info:
    if len(data) < 12 or data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise BadFile("no AIFF file")
    aifc, at, comm = data[8:12] == b"AIFC", 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        at += 8
        if kind == b"COMM":
            if size < 18 or at + size > len(data):
                raise BadFile("short COMM chunk")
            channels, frames, bits = struct.unpack_from(">HIH", data, at)
            rate = int(from_ieee80(data[at + 8 : at + 18]) + 0.5)
            compression = data[at + 18 : at + 22] if aifc and size >= 22 else b"NONE"
            if not channels or not bits or not rate:
                raise BadFile("no channels, bits or rate")
            comm = (rate, channels, bits, compression, _name(aifc, compression, bits), frames)
        elif kind == b"SSND":
            if comm is None:
                raise BadFile("SSND before COMM")
            skip = 8 + struct.unpack_from(">I", data, at)[0]
            info = Info(*comm, at + skip, 0)
            frame = info.channels * info.format.size
            info.data_bytes = max(0, min(size - skip, len(data) - at - skip, info.frames * frame)) // frame * frame
            return info
        at += size + (size & 1)
    raise BadFile("no sound data")


def read(data: bytes, to: str = "i16") -> tuple[Info, np.ndarray]:
    info = parse(data)
    return info, decode(data[info.data_at : info.data_at + info.data_bytes], info.format, to, wav=False).reshape(-1, info.channels)


def write(samples: np.ndarray, rate: int, name: str = "s16") -> bytes:
    """A whole file of frames x channels: plain AIFF for big-endian integers, else AIFF-C."""
    x = np.asarray(samples)
    x = x[:, None] if x.ndim == 1 else x
    compression, fmt = FORMATS[name]
    body = encode(x.ravel(), fmt, wav=False)
    aifc = compression != b"NONE"
    comm = struct.pack(">HIH", x.shape[1], len(x), 16 if fmt.kind in "am" else 8 * fmt.size) + to_ieee80(float(rate))
    chunks = b""
    if aifc:
        comm += compression + b"\0\0"
        chunks = b"FVER" + struct.pack(">II", 4, 0xA2805140)
    chunks += b"COMM" + struct.pack(">I", len(comm)) + comm
    chunks += b"SSND" + struct.pack(">III", len(body) + 8, 0, 0) + body + b"\0" * (len(body) & 1)
    return b"FORM" + struct.pack(">I", 4 + len(chunks)) + (b"AIFC" if aifc else b"AIFF") + chunks
