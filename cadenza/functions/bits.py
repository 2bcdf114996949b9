"""Bit fields of byte strings: whole arrays are packed at once; reading is sequential."""

from __future__ import annotations

import numpy as np


class Packer:
    """Collects unsigned fields (value, width) most significant bit first, and packs them with numpy."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def put(self, value: int, width: int) -> None:
        self.put_all(np.array([value & (1 << width) - 1], dtype=np.uint64), np.array([width]))

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Fields wider than 64 bits have zeros on top."""
        self.values.append(np.asarray(values, dtype=np.uint64))
        self.widths.append(np.asarray(widths, dtype=np.int64))

    def signed(self, values: np.ndarray, width: int) -> None:
        v = np.asarray(values, dtype=np.int64) & (1 << width) - 1
        self.put_all(v.astype(np.uint64), np.full(len(v), width))

    def rice(self, values: np.ndarray, k: int) -> None:
        """Zig-zag folded values: quotient in unary, then k bits."""
        u = np.where(values >= 0, 2 * values, -2 * values - 1).astype(np.int64)
        self.put_all((1 << k) | (u & (1 << k) - 1), (u >> k) + 1 + k)

    def bytes(self) -> bytes:
        values, widths = np.concatenate(self.values), np.concatenate(self.widths)
        ends = np.cumsum(widths)
        left = np.repeat(ends, widths) - 1 - np.arange(ends[-1])
        bits = np.repeat(values, widths) >> np.minimum(left, 63).astype(np.uint64) & np.uint64(1)
        return np.packbits(np.where(left < 64, bits, 0).astype(np.uint8)).tobytes()


class Reader:
    """Reads fields most significant bit first; knows where the next one-bit is."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
        self.ones = np.flatnonzero(self.bits)
        self.text = self.bits.tobytes().translate(bytes([48, 49]) + bytes(254)).decode("ascii")
        self.at = 0

    def get(self, width: int) -> int:
        if not width:
            return 0
        if self.at + width > len(self.text):
            raise EOFError
        out = int(self.text[self.at : self.at + width], 2)
        self.at += width
        return out

    def signed(self, width: int) -> int:
        v = self.get(width)
        return v - (1 << width) if width and v >> (width - 1) else v

    def unary(self) -> int:
        """Zeros before the next one, which is taken too."""
        end = self.text.find("1", self.at)
        if end < 0:
            raise EOFError
        n, self.at = end - self.at, end + 1
        return n

    def rice(self, n: int, k: int) -> list[int]:
        out = []
        text, at = self.text, self.at
        for _ in range(n):
            end = text.find("1", at)
            if end < 0 or end + 1 + k > len(text):
                raise EOFError
            u = (end - at) << k
            at = end + 1 + k
            if k:
                u |= int(text[end + 1 : at], 2)
            out.append(u >> 1 if not u & 1 else -(u + 1 >> 1))
        self.at = at
        return out

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8
