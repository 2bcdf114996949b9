"""WAV: header scan, samples in blocks, and whole files from samples."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..functions.samples import Format, decode, encode

#: Format tags, and the tail that turns a tag into a sub-format identifier.
PCM, FLOAT, ALAW, MULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
GUID_TAIL = bytes.fromhex("000000001000800000AA00389B71")
FORMATS = {"u8": (PCM, Format("u", 1)), "s16": (PCM, Format("s", 2)), "s24": (PCM, Format("s", 3)), "s32": (PCM, Format("s", 4)), "f32": (FLOAT, Format("f", 4)), "alaw": (ALAW, Format("a", 1)), "mulaw": (MULAW, Format("m", 1))}


class BadFile(ValueError):
    pass


@dataclass
class Info:
    rate: int
    channels: int
    bits: int
    tag: int
    name: str
    mask: int
    frames: int
    data_at: int
    data_bytes: int

    @property
    def format(self) -> Format:
        return FORMATS[self.name][1]

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.format.size


def _format_name(tag: int, bits: int) -> str:
    name = {(PCM, 8): "u8", (PCM, 16): "s16", (PCM, 24): "s24", (PCM, 32): "s32", (FLOAT, 32): "f32"}.get((tag, bits)) or {ALAW: "alaw", MULAW: "mulaw"}.get(tag)
    if not name:
        raise BadFile(f"format {tag} with {bits} bits")
    return name


def parse(data: bytes) -> Info:
    """The header of a RIFF or RF64 file; chunks that aren't known are skipped (with their padding)."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise BadFile("no WAVE file")
    at, found, fact = 12, None, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if kind == b"fmt ":
            body = data[at : at + size]
            if len(body) < 16:
                raise BadFile("short fmt chunk")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            channels, bits, mask = channels & 255, bits & 255, 0
            if not channels or not rate:
                raise BadFile("no channels or no rate")
            if tag == EXTENSIBLE:
                if len(body) < 40 or body[26:40] != GUID_TAIL or body[24:26] not in (b"\1\0", b"\3\0"):
                    raise BadFile("unknown sub-format")
                mask, tag = struct.unpack_from("<I", body, 20)[0], body[24]
            found = (rate, channels, bits, tag, _format_name(tag, bits), mask)
        elif kind == b"fact" and size >= 4:
            fact = struct.unpack_from("<I", data, at)[0]
        elif kind == b"data":
            if found is None:
                raise BadFile("data before fmt")
            info = Info(*found, 0, at, min(size, len(data) - at) if size != 0xFFFFFFFF else len(data) - at)
            whole = info.data_bytes // info.frame_bytes
            info.data_bytes = whole * info.frame_bytes
            info.frames = whole if fact is None else fact
            return info
        at += size + (size & 1)
    raise BadFile("no data chunk")


def read(data: bytes, to: str = "i16", first: int = 0, frames: int | None = None) -> tuple[Info, np.ndarray]:
    """Frames x channels from frame `first` on."""
    info = parse(data)
    start = info.data_at + first * info.frame_bytes
    end = info.data_at + info.data_bytes if frames is None else min(info.data_at + info.data_bytes, start + frames * info.frame_bytes)
    return info, decode(data[start:end], info.format, to).reshape(-1, info.channels)


def write(samples: np.ndarray, rate: int, name: str = "s16", mask: int = 0, extensible: bool = False) -> bytes:
    """A whole file of frames x channels. Extensible if asked for, with a mask or more than two channels; float has a fact chunk."""
    x = np.asarray(samples)
    x = x[:, None] if x.ndim == 1 else x
    tag, fmt = FORMATS[name]
    channels = x.shape[1]
    body = encode(x.ravel(), fmt)
    wide = extensible or mask or channels > 2
    head = struct.pack("<HHIIHH", EXTENSIBLE if wide else tag, channels, rate, rate * channels * fmt.size, channels * fmt.size, 8 * fmt.size)
    if wide:
        head += struct.pack("<HHI", 22, 8 * fmt.size, mask) + struct.pack("<H", tag) + GUID_TAIL
    elif tag != PCM:
        head += b"\0\0"
    chunks = b"fmt " + struct.pack("<I", len(head)) + head
    if tag == FLOAT:
        chunks += b"fact" + struct.pack("<II", 4, len(x))
    chunks += b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks
