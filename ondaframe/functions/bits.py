"""Bits, headers and checksums as column expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import RATES


def byte(b: Column, i: int) -> Column:
    """Byte i (from 0) as an int; null past the end."""
    return F.when(F.octet_length(b) > i, F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("int"))


def read(b: Column, at: int, n: int) -> Column:
    """n bits (at most 56 with their byte offset) from bit `at`, most significant first; null past the end."""
    first, last = at // 8, (at + n - 1) // 8
    whole = F.when(F.octet_length(b) > last, F.conv(F.hex(F.substring(b, first + 1, last - first + 1)), 16, 10).cast("bigint"))
    drop = 8 * (last + 1) - at - n
    return F.call_function("shiftright", whole, F.lit(drop)).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def byte_array(b: Column) -> Column:
    """array<int> of all bytes."""
    h = F.hex(b)
    return F.transform(F.filter(F.sequence(F.lit(0), F.octet_length(b)), lambda i: i < F.octet_length(b)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def crc(values: Column, width: int, poly: int, start: int, bits: Column | int | None = None) -> Column:
    """Most-significant-bit-first CRC over an array of bytes, or over its first `bits` bits."""
    mask, top = (1 << width) - 1, 1 << (width - 1)

    def by_byte(acc, v):
        for k in range(7, -1, -1):
            acc = by_bit(acc, F.call_function("shiftright", v, F.lit(k)).bitwiseAND(F.lit(1)))
        return acc

    def by_bit(acc, bit):
        flag = (acc >= top).cast("int").bitwiseXOR(bit)
        return (acc * 2).bitwiseAND(F.lit(mask)).bitwiseXOR(flag * poly)

    if bits is None:
        # one fold step a byte would nest eight expressions; bits are unrolled as an array instead
        bits = F.size(values) * 8
    unrolled = F.flatten(F.transform(values, lambda v: F.transform(F.sequence(F.lit(7), F.lit(0)), lambda k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1)))))
    return F.aggregate(F.slice(unrolled, F.lit(1), F.lit(bits) if isinstance(bits, int) else bits), F.lit(start), by_bit)


def adts(b: Column) -> Column:
    """Header fields of a frame; null if it does not start with the sync word or is too short."""
    rate = F.get(F.array(*map(F.lit, RATES)), read(b, 18, 4).cast("int"))
    head = F.struct(
        read(b, 12, 1).alias("id"), read(b, 13, 2).alias("layer"), (read(b, 15, 1) == 1).alias("protection_absent"), (read(b, 16, 2) + 1).alias("object_type"),
        rate.alias("rate"), read(b, 23, 3).alias("channels"), read(b, 30, 13).alias("length"), read(b, 43, 11).alias("fullness"), read(b, 54, 2).alias("blocks"),
    )
    return F.when((read(b, 0, 12) == 0xFFF) & (F.octet_length(b) >= 7), head)


def adts_header(object_type: Column, rate_index: Column, channels: Column, length: Column, fullness: Column) -> Column:
    """Seven header bytes without a checksum, as binary; an unknown rate index falls back to 4."""
    idx = F.when(rate_index.between(0, 12), rate_index).otherwise(4)
    bits = [(F.lit(0xFFF), 12), (F.lit(0), 1), (F.lit(0), 2), (F.lit(1), 1), ((object_type - 1).bitwiseAND(F.lit(3)), 2), (idx, 4), (F.lit(0), 1), (channels, 3), (F.lit(0), 2), (F.lit(0), 2), (length, 13), (fullness, 11), (F.lit(0), 2)]
    high, low, at = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), 0
    for value, n in bits:  # 28 bits, then 28 bits
        if at < 28:
            high = high * (1 << n) + value
        else:
            low = low * (1 << n) + value
        at += n
    return F.unhex(F.concat(F.lpad(F.hex(high), 7, "0"), F.lpad(F.hex(low), 7, "0")))
