"""The four indexed sidecar formats: 128-byte little-endian headers with a directory, then packed rows."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np


class BadSidecar(ValueError):
    pass


#: Header layouts (all 128 bytes) and row layouts.
APV = struct.Struct("<4sHHIBBHQIIIB11x" + "IIQ" * 4 + "16x")
ASV = struct.Struct("<4sHHIBBHHHHHQI" + "IIQ" * 4 + "28x")
ATT = struct.Struct("<4sHHIIIBBBBIIIIQIHHQIHH56x")
ASL = struct.Struct("<4sHHIIIBBBBIHHHHIH86x")
POINT = np.dtype([("time_ms", "<u4"), ("bpm_q16", "<u4")])
BEAT = np.dtype([("time_ms", "<u4"), ("bar_index", "<u4"), ("beat_within_bar", "<u2"), ("flags", "<u2"), ("local_bpm_q16", "<u4")])
SLICE = np.dtype([("start_sample", "<u4"), ("length_samples", "<u4"), ("musical_tick", "<u4"), ("midi_note", "u1"), ("bar_index", "u1"), ("beat_within_bar", "u1"), ("subdivision", "u1"), ("gain_db_q8", "<i2"), ("transient_energy", "<u2"), ("decay_ms", "<u2"), ("tail_mode", "u1"), ("flags", "u1"), ("reserved", "V8")])
RATIOS = (1, 16, 256)


def _directory(levels: list[int], row: int) -> list[int]:
    out, at = [], 128
    for k, n in enumerate(levels):
        out += [16**k, n, at]
        at += n * row
    return out + [0] * (12 - len(out))


def _head(layout: struct.Struct, magic: bytes, data: bytes) -> tuple:
    if len(data) < 128 or data[:4] != magic or struct.unpack_from("<H", data, 4)[0] != 1:
        raise BadSidecar(f"no {magic.decode()} version 1")
    return layout.unpack_from(data)


@dataclass
class Envelope:
    rate: int
    frames: int
    levels: list[np.ndarray]  # chunks x 2 (mono) or x 4 (stereo), int8
    chunk: int = 128

    def pack(self) -> bytes:
        row = self.levels[0].shape[1]
        head = APV.pack(b"APV1", 1, 0, self.rate, row // 2, row, self.chunk, self.frames, self.frames * 1000 // self.rate, 0, 0, len(self.levels), *_directory([len(x) for x in self.levels], row))
        return head + b"".join(np.ascontiguousarray(x, dtype=np.int8).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> Envelope:
        h = _head(APV, b"APV1", data)
        row, lods = h[5], [h[12 + 3 * k : 15 + 3 * k] for k in range(h[11])]
        if h[4] not in (1, 2) or row != 2 * h[4]:
            raise BadSidecar("channels")
        if any(at + n * row > len(data) for _, n, at in lods):
            raise BadSidecar("cut off")
        return cls(h[3], h[7], [np.frombuffer(data, np.int8, n * row, at).reshape(-1, row) for _, n, at in lods], h[6])


@dataclass
class Spectrum:
    rate: int
    frames: int
    levels: list[np.ndarray]  # frames x bands, uint8
    low: int = 20
    high: int = 20000

    def pack(self) -> bytes:
        bands = self.levels[0].shape[1]
        head = ASV.pack(b"ASV1", 1, 2, self.rate, 1, bands, 1024, 512, self.low, self.high, len(self.levels), self.frames, self.frames * 1000 // self.rate, *_directory([len(x) for x in self.levels], bands))
        return head + b"".join(np.ascontiguousarray(x, dtype=np.uint8).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> Spectrum:
        h = _head(ASV, b"ASV1", data)
        bands, lods = h[5], [h[13 + 3 * k : 16 + 3 * k] for k in range(h[10])]
        if not 0 < bands <= 64 or len(lods) > 4 or any(at + n * bands > len(data) for _, n, at in lods):
            raise BadSidecar("bands or size")
        return cls(h[3], h[11], [np.frombuffer(data, np.uint8, n * bands, at).reshape(-1, bands) for _, n, at in lods], h[8], h[9])


@dataclass
class Tempo:
    rate: int
    duration_ms: int
    bpm_q16: int
    confidence: int
    curve: np.ndarray
    beats: np.ndarray
    signature: tuple[int, int] = (4, 4)

    def pack(self) -> bytes:
        down = self.beats["time_ms"][self.beats["flags"] & 1 == 1]
        flags = (1 if len(self.curve) <= 2 else 0) | (2 if len(down) else 0)
        at = 128 + 8 * len(self.curve)
        first, bars = (int(self.beats["time_ms"][0]), int(self.beats["bar_index"][-1])) if len(self.beats) else (0, 0)
        head = ATT.pack(b"ATT1", 1, 128, self.duration_ms, self.rate, self.bpm_q16, self.confidence, *self.signature, flags, first, int(down[0]) if len(down) else 0, len(self.beats), bars, 128, len(self.curve), 8, 0, at, len(self.beats), 16, 0)
        return head + self.curve.astype(POINT).tobytes() + self.beats.astype(BEAT).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tempo:
        h = _head(ATT, b"ATT1", data)
        curve_at, curve_n, beats_at, beats_n = h[14], h[15], h[18], h[19]
        if h[2] != 128 or h[16] != 8 or h[20] != 16 or curve_n > 65536 or curve_at + 8 * curve_n > len(data) or beats_at + 16 * beats_n > len(data):
            raise BadSidecar("directory")
        return cls(h[4], h[3], h[5], h[6], np.frombuffer(data, POINT, curve_n, curve_at), np.frombuffer(data, BEAT, beats_n, beats_at), (h[7], h[8]))


@dataclass
class Slices:
    rate: int
    duration: int
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, SLICE))
    mode: int = 2
    bpm_q16: int = 120 << 16
    signature: tuple[int, int] = (4, 4)

    def pack(self) -> bytes:
        bar = 480 * 4 * self.signature[0] // (self.signature[1] or 4) or 1920
        bars = int(self.rows["musical_tick"][-1]) // bar + 1 if len(self.rows) else 0
        head = ASL.pack(b"ASL1", 1, 128, self.duration, self.duration * 1000 // self.rate, self.rate, 1, *self.signature, self.mode, self.bpm_q16, 480, bars, len(self.rows), 32, 128, 0)
        return head + self.rows.astype(SLICE).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Slices:
        h = _head(ASL, b"ASL1", data)
        n, size, at = h[13], h[14], h[15]
        if h[2] != 128 or size != 32 or at + 32 * n > len(data):
            raise BadSidecar("directory")
        return cls(h[5], h[3], np.frombuffer(data, SLICE, n, at), h[9], h[10], (h[7], h[8]))
