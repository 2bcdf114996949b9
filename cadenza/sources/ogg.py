"""Ogg: pages from packets and packets from pages."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from ..functions.checksums import crc

CONTINUED, FIRST, LAST = 1, 2, 4
#: Segments in a page.
MOST_SEGMENTS = 255


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    laces: bytes
    payload: bytes

    def pack(self) -> bytes:
        head = struct.pack("<4sBBqIII", b"OggS", 0, self.flags, self.granule, self.serial, self.sequence, 0) + bytes([len(self.laces)]) + self.laces
        whole = bytearray(head + self.payload)
        whole[22:26] = struct.pack("<I", crc(bytes(whole), "ogg"))
        return bytes(whole)


def pages(data: bytes) -> list[Page]:
    """All whole pages with a sound checksum; between them the next capture pattern is looked for."""
    out, at = [], 0
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        n = data[at + 26]
        laces = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        if len(laces) < n or end > len(data) or data[at + 4]:
            at += 1
            continue
        whole = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]
        if crc(whole, "ogg") != struct.unpack_from("<I", data, at + 22)[0]:
            at += 1
            continue
        _, _, flags, granule, serial, sequence, _ = struct.unpack_from("<4sBBqIII", data, at)
        out.append(Page(flags, granule, serial, sequence, laces, data[at + 27 + n : end]))
        at = end
    return out


@dataclass
class Packet:
    serial: int
    data: bytes
    granule: int
    last: bool


def packets(found: list[Page]) -> list[Packet]:
    """Packets by stream. A gap in a stream's pages drops what was begun; a continuation without a beginning is skipped.

    Only the last packet that ends on a page has its granule; others have -1.
    """
    out: list[Packet] = []
    begun: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    for p in found:
        if expected.get(p.serial, p.sequence) != p.sequence or not p.flags & CONTINUED:
            begun[p.serial] = None
        expected[p.serial] = p.sequence + 1
        skipping = bool(p.flags & CONTINUED) and begun.get(p.serial) is None
        held, at = begun.get(p.serial) or bytearray(), 0
        ends = [k for k, lace in enumerate(p.laces) if lace < 255]
        for k, lace in enumerate(p.laces):
            held += p.payload[at : at + lace]
            at += lace
            if lace < 255:
                if not skipping:
                    final = k == ends[-1]
                    out.append(Packet(p.serial, bytes(held), p.granule if final else -1, final and bool(p.flags & LAST)))
                held, skipping = bytearray(), False
        open_ = bool(p.laces) and p.laces[-1] == 255 and not skipping
        begun[p.serial] = held if open_ else None
    return out


def mux(items: list[tuple[bytes, int]], serial: int, per_page: int = MOST_SEGMENTS) -> bytes:
    """Pages of packets (data, granule): lacing by 255 with a closing shorter segment; the last page ends the stream."""
    segments: list[tuple[bytes, int, bool, bool]] = []  # bytes, granule, starts a packet, ends one
    for data, granule in items:
        n = len(data) // 255 + 1
        segments += [(data[255 * k : 255 * k + 255], granule, k == 0, k == n - 1) for k in range(n)]
    out = []
    for at in range(0, len(segments), per_page):
        some = segments[at : at + per_page]
        ended = [g for _, g, _, e in some if e]
        flags = (0 if some[0][2] else CONTINUED) | (0 if at else FIRST) | (LAST if at + per_page >= len(segments) else 0)
        out.append(Page(flags, ended[-1] if ended else -1, serial, len(out), bytes(len(s) for s, *_ in some), b"".join(s for s, *_ in some)).pack())
    return b"".join(out)
