"""Bytes to samples and back for PCM, float and G.711 formats (numpy kernels).

A format is (kind, bytes, big-endian): kind u (unsigned, 8 bits), s (signed), f (float), a (A-law) or m (mu-law).
WAV and AIFF round floats differently, so encoders take the container's rule.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np


class Format(NamedTuple):
    kind: str
    size: int
    big: bool = False


def unpack_integers(data: bytes, fmt: Format) -> np.ndarray:
    """Stored integers of a whole number of samples (24 bits are sign-extended)."""
    raw = np.frombuffer(data, dtype=np.uint8, count=len(data) // fmt.size * fmt.size).reshape(-1, fmt.size)
    if fmt.kind in "uam":
        return raw[:, 0].astype(np.int64)
    order = raw if fmt.big else raw[:, ::-1]
    out = np.zeros(len(raw), dtype=np.int64)
    for k in range(fmt.size):
        out = out << 8 | order[:, k]
    half = 1 << (8 * fmt.size - 1)
    return (out ^ half) - half


def pack_integers(values: np.ndarray, fmt: Format) -> bytes:
    v = np.asarray(values, dtype=np.int64)
    out = np.stack([(v >> 8 * k) & 255 for k in range(fmt.size)], axis=-1).astype(np.uint8)
    return (out[:, ::-1] if fmt.big else out).tobytes()


@lru_cache
def g711_table(kind: str) -> np.ndarray:
    """Linear values of the 256 bytes, from the format's rule."""
    b = np.arange(256)
    if kind == "a":
        x = b ^ 0x55
        seg, t = x >> 4 & 7, (x & 15) << 4
        t = np.where(seg == 0, t + 8, (t + 0x108) << np.maximum(seg - 1, 0))
        return np.where(x & 0x80, t, -t)
    x = 255 - b
    t = ((((x & 15) << 3) + 0x84) << (x >> 4 & 7)) - 0x84
    return np.where(x & 0x80, -t, t)


def g711_encode(v: np.ndarray, kind: str) -> np.ndarray:
    v = np.asarray(v, dtype=np.int64)
    if kind == "a":
        m = np.where(v >= 0, v, -v - 1) >> 3
        seg = np.searchsorted([(32 << k) - 1 for k in range(8)], m)
        code = np.where(seg >= 8, 127, seg << 4 | (m >> np.maximum(seg, 1) & 15))
        return code ^ np.where(v >= 0, 0xD5, 0x55)
    p = v >> 2
    m = np.minimum(np.abs(p), 8159) + 33
    seg = np.searchsorted([(64 << k) - 1 for k in range(8)], m)
    code = np.where(seg >= 8, 127, seg << 4 | (m >> (seg + 1) & 15))
    return code ^ np.where(p < 0, 0x7F, 0xFF)


def _floats(data: bytes, fmt: Format) -> np.ndarray:
    return np.frombuffer(data, dtype=">f4" if fmt.big else "<f4", count=len(data) // 4).astype(np.float32)


def split_round(x: np.ndarray, bits: int) -> np.ndarray:
    """Half up from zero on with the positive range, half down below it with the negative range; truncated and clamped."""
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    # 16 bits are rounded in single precision, wider ones in double.
    x = x.astype(np.float32 if bits <= 16 else np.float64)
    t = x.dtype.type
    raw = np.where(x >= 0, x * t(high) + t(0.5), x * t(-low) - t(0.5))
    return np.clip(np.trunc(raw.astype(np.float64)), low, high).astype(np.int64)


def even_round(x: np.ndarray, bits: int) -> np.ndarray:
    """x times half the range's width, rounded half away from zero, clamped."""
    scale = (1 << (bits - 1)) - 0.5
    raw = (x.astype(np.float64) if bits > 24 else x.astype(np.float32)) * (scale if bits > 24 else np.float32(scale))
    raw = raw.astype(np.float64)
    return np.clip(np.trunc(raw + np.copysign(0.5, raw)), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)


def decode(data: bytes, fmt: Format, to: str, wav: bool = True) -> np.ndarray:
    """Samples as 'f32' (-1 to 1), 'i16' or 'i32'. WAV leaves 24 bits unscaled as i32; AIFF shifts them up."""
    if fmt.kind == "f":
        x = _floats(data, fmt)
        if to == "f32":
            return np.clip(x, np.float32(-1), np.float32(1))
        bits = 16 if to == "i16" else 32
        return (split_round(x, bits) if wav else even_round(x, bits)).astype(np.int16 if to == "i16" else np.int32)
    v = unpack_integers(data, fmt)
    if fmt.kind in "am":
        v, bits = g711_table(fmt.kind)[v], 16
    else:
        v, bits = (v - 128 if fmt.kind == "u" else v), 8 * fmt.size
    if to == "f32":
        return (v.astype(np.float32) / np.float32(1 << (bits - 1))).astype(np.float32)
    if to == "i16":
        return (v << 16 - bits if bits <= 16 else v >> bits - 16).astype(np.int16)
    return (v if wav and bits == 24 else v << 32 - bits).astype(np.int32)


def encode(samples: np.ndarray, fmt: Format, wav: bool = True) -> bytes:
    """Bytes of float32, int16 or int32 samples."""
    x = np.asarray(samples)
    bits = 16 if fmt.kind in "am" else 8 * fmt.size
    if x.dtype.kind == "f":
        clipped = np.clip(x.astype(np.float32), np.float32(-1), np.float32(1))
        if fmt.kind == "f":
            return (x if wav else clipped).astype(">f4" if fmt.big else "<f4").tobytes()
        if fmt.kind == "u":
            v = np.clip(np.trunc(clipped * np.float32(128) + np.float32(128.5)), 0, 255).astype(np.int64)
            return pack_integers(v, fmt)
        if fmt.kind in "am" and wav:
            v = np.trunc(clipped * np.float32(32767.5)).astype(np.int64)
        else:
            v = split_round(clipped, bits) if wav else even_round(x.astype(np.float32), bits)
    else:
        source = 16 if x.dtype == np.int16 else 32
        v = x.astype(np.int64)
        if fmt.kind == "f":
            return (v.astype(np.float32) / np.float32(1 << (source - 1))).astype(">f4" if fmt.big else "<f4").tobytes()
        if source == 16:
            v = v << bits - 16 if bits >= 16 else v >> 8
        elif not (wav and bits == 24):
            v = v >> 32 - bits
        if fmt.kind == "u":
            v = v + 128
    return pack_integers(g711_encode(v, fmt.kind), fmt) if fmt.kind in "am" else pack_integers(v, fmt)


def to_ieee80(value: float) -> bytes:
    """An 80-bit extended float, big-endian."""
    if value == 0 or value != value:
        return bytes(10) if value == 0 else bytes.fromhex("7FFFC000000000000000")
    sign, value = (0x8000, -value) if value < 0 else (0, value)
    if value == float("inf"):
        return (sign | 0x7FFF).to_bytes(2, "big") + bytes(8)
    mantissa, exponent = np.frexp(value)
    return (sign | int(exponent) + 16382).to_bytes(2, "big") + int(float(mantissa) * 2.0**64).to_bytes(8, "big")


def from_ieee80(data: bytes) -> float:
    head, mantissa = int.from_bytes(data[:2], "big"), int.from_bytes(data[2:10], "big")
    exponent = head & 0x7FFF
    if exponent == 0 and mantissa == 0:
        return 0.0
    if exponent == 0x7FFF:
        return float("nan") if mantissa << 1 & (1 << 64) - 1 else float("-inf" if head & 0x8000 else "inf")
    value = float(np.ldexp(float(mantissa), exponent - 16383 - 63))
    return -value if head & 0x8000 else value
