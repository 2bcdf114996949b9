"""Prefix codes: lengths from a rule, canonical codewords, and tables that decode a symbol at a glance."""

from __future__ import annotations

import heapq
from array import array

import numpy as np


def huffman_lengths(weights: list[float], limit: int) -> list[int]:
    """Code lengths of an optimal prefix code; where the longest is over limit, of an optimal one within it."""
    heap = [(w, k, (k,)) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths = [0] * len(weights)
    made = len(weights)
    while len(heap) > 1:
        (w, _, a), (v, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for k in a + b:
            lengths[k] += 1
        heapq.heappush(heap, (w + v, made, a + b))
        made += 1
    return lengths if max(lengths) <= limit else _limited(weights, limit)


def _limited(weights: list[float], limit: int) -> list[int]:
    """Package-merge: pairs of the cheapest packages of one length are packages of the next shorter one."""
    single = [(w, (k,)) for w, k in sorted((w, k) for k, w in enumerate(weights))]
    level: list[tuple[float, tuple[int, ...]]] = []
    for _ in range(limit):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])]
        level = sorted(single + pairs, key=lambda e: e[0])
    lengths = [0] * len(weights)
    for _, package in level[: 2 * len(weights) - 2]:
        for k in package:
            lengths[k] += 1
    return lengths


def canonical(lengths: list[int]) -> list[int]:
    """Codewords in the order of length, then of symbol."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, k in sorted((n, k) for k, n in enumerate(lengths)):
        code <<= n - last
        codes[k] = code
        code, last = code + 1, n
    return codes


class PrefixCode:
    """Codewords and lengths by symbol, and for each string of `width` bits the symbol that it starts with (symbol << 5 | length; 0: none)."""

    def __init__(self, codes: list[int], lengths: list[int]):
        self.codes, self.lengths = np.array(codes, dtype=np.uint64), np.array(lengths, dtype=np.int64)
        self.width = max(lengths)
        self.table = array("i", bytes(4 << self.width))
        for k, (c, n) in enumerate(zip(codes, lengths)):
            if n:
                start, room = c << self.width - n, 1 << self.width - n
                self.table[start : start + room] = array("i", [k << 5 | n]) * room

    @classmethod
    def of_words(cls, words: str) -> PrefixCode:
        """From codewords in binary, in the order of symbols."""
        w = words.split()
        return cls([int(x, 2) for x in w], [len(x) for x in w])

    @classmethod
    def of_weights(cls, weights: list[float], limit: int) -> PrefixCode:
        lengths = huffman_lengths(weights, limit)
        return cls(canonical(lengths), lengths)


class Bits:
    """Most significant bit first; the 24 bits from each place on are at hand."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data + bytes(8), dtype=np.uint8).astype(np.uint64)
        words = sum(b[k : len(data) + k + 1] << np.uint64(24 - 8 * k) for k in range(4))
        self.ahead = (words[:, None] >> np.arange(8, 0, -1, dtype=np.uint64) & np.uint64(0xFFFFFF)).ravel().tolist()
        self.size, self.at = 8 * len(data), 0

    def get(self, width: int) -> int:
        """Up to 24 bits."""
        if self.at + width > self.size:
            raise EOFError
        out = self.ahead[self.at] >> 24 - width
        self.at += width
        return out

    def symbol(self, code: PrefixCode) -> int:
        e = code.table[self.ahead[self.at] >> 24 - code.width]
        self.at += e & 31
        if not e or self.at > self.size:
            raise EOFError
        return e >> 5
