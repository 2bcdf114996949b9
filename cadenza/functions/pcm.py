"""Sample conversion, companding, bit fields and variable-length numbers as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column | str, b: int | Column) -> Column:
    """Integer division that truncates towards zero."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("long"), b.cast("long"))


def downmix(left: Column, right: Column) -> Column:
    return div(left + right, 2)


def scale_i8(v: Column, shift: int = 8) -> Column:
    """Arithmetic shift to 8 bits, clamped."""
    return F.least(F.greatest(F.shiftright(v, shift), F.lit(-128)), F.lit(127))


def float_to_i16(x: Column) -> Column:
    """Saturating: x * 32767 + 0.5 from zero on, x * 32768 - 0.5 below, truncated."""
    raw = F.when(x >= 0, x * 32767.0 + 0.5).otherwise(x * 32768.0 - 0.5)
    return F.least(F.greatest(raw, F.lit(-32768.0)), F.lit(32767.0)).cast("int")


def _segment(magnitude: Column, first: int) -> Column:
    """Number of the first of eight doubling ranges that holds magnitude (8: none)."""
    out = F.lit(8)
    for k in range(7, -1, -1):
        out = F.when(magnitude <= ((first + 1) << k) - 1, k).otherwise(out)
    return out


def alaw_encode(v: Column) -> Column:
    """G.711 A-law byte of a 16-bit sample."""
    p = F.shiftright(v, 3)
    positive = p >= 0
    m = F.when(positive, p).otherwise(-p - 1)
    seg = _segment(m, 31)
    low = F.when(seg < 2, F.shiftright(m, 1)).otherwise(F.call_function("shiftright", m, seg)).bitwiseAND(F.lit(15))
    code = F.when(seg >= 8, 127).otherwise(F.shiftleft(seg, 4).bitwiseOR(low))
    return code.bitwiseXOR(F.when(positive, 0xD5).otherwise(0x55))


def alaw_decode(b: Column) -> Column:
    x = b.bitwiseXOR(F.lit(0x55))
    seg, low = F.shiftright(x.bitwiseAND(F.lit(0x70)), 4), F.shiftleft(x.bitwiseAND(F.lit(15)), 4)
    t = F.when(seg == 0, low + 8).when(seg == 1, low + 0x108).otherwise(F.call_function("shiftleft", low + 0x108, seg - 1))
    return F.when(x.bitwiseAND(F.lit(0x80)) != 0, t).otherwise(-t)


def ulaw_encode(v: Column) -> Column:
    """G.711 mu-law byte of a 16-bit sample: clipped at 8159, bias 33 (after a shift by 2)."""
    p = F.shiftright(v, 2)
    m = F.least(F.when(p < 0, -p).otherwise(p), F.lit(8159)) + 33
    seg = _segment(m, 63)
    code = F.when(seg >= 8, 127).otherwise(F.shiftleft(seg, 4).bitwiseOR(F.call_function("shiftright", m, seg + 1).bitwiseAND(F.lit(15))))
    return code.bitwiseXOR(F.when(p < 0, 0x7F).otherwise(0xFF))


def ulaw_decode(b: Column) -> Column:
    x = F.lit(255) - b
    t = F.call_function("shiftleft", F.shiftleft(x.bitwiseAND(F.lit(15)), 3) + 0x84, F.shiftright(x.bitwiseAND(F.lit(0x70)), 4)) - 0x84
    return F.when(x.bitwiseAND(F.lit(0x80)) != 0, -t).otherwise(t)


def bits(word: Column, at: int, width: int) -> Column:
    """width bits of word, the lowest at bit `at`."""
    return F.shiftright(word, at).bitwiseAND(F.lit((1 << width) - 1))


def vlq_hex(value: Column) -> Column:
    """MIDI variable-length quantity, as upper-case hex."""
    out = None
    for k in range(4, -1, -1):
        byte = bits(value, 7 * k, 7) + (128 if k else 0)
        part = F.when((F.shiftright(value, 7 * k) > 0) | F.lit(k == 0), F.lpad(F.hex(byte), 2, "0")).otherwise("")
        out = part if out is None else F.concat(out, part)
    return out


#: Sampling rates by ADTS index, MPEG-1 rates and layer III bit rates (kbit/s) by index.
ADTS_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
MP3_RATES = [44100, 48000, 32000]
MP3_KBPS_V1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
MP3_KBPS_V2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]


def adts_fields(high: Column, low: Column) -> dict[str, Column]:
    """Fields of a 56-bit ADTS header given as two words: its first 28 bits and its last 28 bits."""
    return {
        "sync": bits(high, 16, 12),
        "mpeg2": bits(high, 15, 1),
        "protection_absent": bits(high, 12, 1),
        "profile": bits(high, 10, 2),
        "rate_index": bits(high, 6, 4),
        "sample_rate": F.element_at(F.array(*map(F.lit, [*ADTS_RATES, 0, 0, 0])), (bits(high, 6, 4) + 1).cast("int")),
        "channels": bits(high, 2, 3),
        "frame_length": bits(low, 13, 13),
        "fullness": bits(low, 2, 11),
        "blocks": bits(low, 0, 2) + 1,
    }


def mp3_fields(word: Column) -> dict[str, Column]:
    """Fields of a 32-bit MPEG audio header of layer III; frame_bytes is null where the header isn't valid."""
    version, layer, rate_index, kbps_index, padding = bits(word, 19, 2), bits(word, 17, 2), bits(word, 10, 2), bits(word, 12, 4), bits(word, 9, 1)
    valid = (bits(word, 21, 11) == 0x7FF) & (version != 1) & (layer == 1) & (rate_index != 3) & (bits(word, 0, 2) != 2) & ~kbps_index.isin(0, 15)
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    rate = div(at([*MP3_RATES, 0], rate_index), F.when(version == 3, 1).when(version == 2, 2).otherwise(4))
    kbps = F.when(version == 3, at([*MP3_KBPS_V1, 0], kbps_index)).otherwise(at([*MP3_KBPS_V2, 0], kbps_index))
    size = div(F.when(version == 3, 144000).otherwise(72000) * kbps, F.greatest(rate, F.lit(1))) + padding
    return {
        "valid": valid,
        "version": version,
        "sample_rate": F.when(valid, rate),
        "kbps": F.when(valid, kbps),
        "channels": F.when(bits(word, 6, 2) == 3, 1).otherwise(2),
        "frame_bytes": F.when(valid, size),
    }
