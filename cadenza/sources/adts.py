"""ADTS framing of AAC."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.checksums import adts_crc
from ..functions.pcm import ADTS_RATES


@dataclass
class Header:
    mpeg2: int
    protected: bool
    profile: int
    rate_index: int
    channels: int
    length: int
    fullness: int
    blocks: int

    @property
    def size(self) -> int:
        return 9 if self.protected else 7

    @property
    def rate(self) -> int:
        return ADTS_RATES[self.rate_index] if self.rate_index < len(ADTS_RATES) else 0

    def pack(self) -> bytes:
        word = 0xFFF
        for value, width in ((self.mpeg2, 1), (0, 2), (not self.protected, 1), (self.profile, 2), (self.rate_index, 4), (0, 1), (self.channels, 3), (0, 4), (self.length, 13), (self.fullness, 11), (self.blocks - 1, 2)):
            word = word << width | int(value)
        return word.to_bytes(7, "big")


def parse(data: bytes, at: int = 0) -> Header | None:
    """The header at `at`, or None if there is no valid one."""
    if len(data) < at + 7:
        return None
    w = int.from_bytes(data[at : at + 7], "big")
    bits = lambda low, width: w >> low & (1 << width) - 1
    if bits(44, 12) != 0xFFF or bits(41, 2):
        return None
    h = Header(bits(43, 1), not bits(40, 1), bits(38, 2), bits(34, 4), bits(30, 3), bits(13, 13), bits(2, 11), bits(0, 2) + 1)
    return h if h.length >= h.size else None


def frames(data: bytes) -> list[tuple[int, Header, bytes]]:
    """Place, header and payload of all whole frames; protected ones need a sound checksum; else the next sync is looked for."""
    out, at = [], 0
    while (at := data.find(b"\xff", at)) >= 0:
        h = parse(data, at)
        if h and at + h.length <= len(data):
            frame = data[at : at + h.length]
            if not h.protected or adts_crc(frame) == int.from_bytes(frame[7:9], "big"):
                out.append((at, h, frame[h.size :]))
                at += h.length
                continue
        at += 1
    return out


def wrap(payload: bytes, rate: int, channels: int, protected: bool = False, profile: int = 1) -> bytes:
    h = Header(0, protected, profile, ADTS_RATES.index(rate), channels, 0, 0x7FF, 1)
    h.length = h.size + len(payload)
    head = h.pack()
    return head + (adts_crc(head + b"\0\0" + payload).to_bytes(2, "big") if protected else b"") + payload
