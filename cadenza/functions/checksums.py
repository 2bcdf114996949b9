"""Checksums of the container formats, as table-driven numpy kernels and as JVM-side folds."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width and polynomial by format (most significant bit first, starting from 0, no final xor).
CRC = {"flac8": (8, 0x07), "flac16": (16, 0x8005), "ogg": (32, 0x04C11DB7)}


@lru_cache
def crc_table(kind: str) -> tuple[int, ...]:
    width, poly = CRC[kind]
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return tuple(out)


#: Bytes from which on a text is cut into as many pieces as numpy steps over at once.
PIECES, LEAST = 64, 4096


@lru_cache
def _arrays(kind: str) -> np.ndarray:
    return np.array(crc_table(kind), dtype=np.int64)


def crc(data: bytes, kind: str, start: int = 0) -> int:
    """By table, byte by byte; long data in pieces side by side, which are then put together (a CRC of more bytes is linear in what came before)."""
    if len(data) < LEAST:
        return _serial(data, kind, start)
    size = len(data) // PIECES
    head = _serial(data[: len(data) - size * PIECES], kind, start)
    pieces = crc_rows(np.frombuffer(data, dtype=np.uint8, offset=len(data) - size * PIECES).reshape(PIECES, size), kind)
    shift = _zeros(kind, size)
    for c in pieces.tolist():
        head = _apply(shift, head) ^ c
    return head


def _serial(data: bytes, kind: str, start: int) -> int:
    width, _ = CRC[kind]
    table, mask, c = crc_table(kind), (1 << width) - 1, start
    for b in data:
        c = (c << 8 & mask) ^ table[(c >> (width - 8) ^ b) & 255]
    return c


def crc_rows(rows: np.ndarray, kind: str) -> np.ndarray:
    """CRC of each row of bytes: one step per column, over all rows."""
    width, _ = CRC[kind]
    table, mask = _arrays(kind), (1 << width) - 1
    c = np.zeros(len(rows), dtype=np.int64)
    for column in np.ascontiguousarray(rows.T):
        c = (c << 8 & mask) ^ table[(c >> (width - 8) ^ column) & 255]
    return c


@lru_cache(maxsize=256)
def _zeros(kind: str, size: int) -> tuple[int, ...]:
    """What size zero bytes make of each bit of a CRC: the matrix of one zero byte, to the power of size."""
    width, _ = CRC[kind]
    power = tuple(_serial(b"\0", kind, 1 << k) for k in range(width))
    out = tuple(1 << k for k in range(width))
    while size:
        if size & 1:
            out = tuple(_apply(power, x) for x in out)
        power = tuple(_apply(power, x) for x in power)
        size >>= 1
    return out


def _apply(matrix: tuple[int, ...], c: int) -> int:
    out = 0
    while c:
        low = c & -c
        out ^= matrix[low.bit_length() - 1]
        c ^= low
    return out


def adts_crc(frame: bytes) -> int:
    """CRC-16 of a protected ADTS frame: starts from 0xFFFF and leaves out its own two bytes (7 and 8)."""
    return crc(frame[:7] + frame[9:], "flac16", 0xFFFF)


def crc_udf(kind: str):
    """A vectorised function of a binary column."""

    @F.pandas_udf("long")
    def checksum(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else crc(bytes(x), kind)).astype("Int64")

    return checksum


def crc_fold(data: Column, kind: str) -> Column:
    """The same as an expression: a fold over the bytes in the JVM, by table lookup."""
    width, _ = CRC[kind]
    table = F.array(*(F.lit(x).cast("long") for x in crc_table(kind)))
    byte = F.transform(F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1))), lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("long"))
    step = lambda c, b: F.shiftleft(c, 8).bitwiseAND(F.lit((1 << width) - 1)).bitwiseXOR(F.element_at(table, (F.shiftright(c, width - 8).bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1).cast("int")))
    return F.when(F.length(data) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(byte, F.lit(0).cast("long"), step))
