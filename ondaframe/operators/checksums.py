"""Checksums of whole byte strings: NumPy where an expression would need a fold over every bit."""

from __future__ import annotations

import functools

import numpy as np

#: Bytes that one table lookup step covers, and bytes that are looked up at a time.
CHUNK, SLAB = 64, 1 << 20


@functools.cache
def _tables(poly: int) -> tuple[list[int], np.ndarray, list[int]]:
    """A byte's remainder; a byte's remainder by its place in a chunk, flat; what a chunk of zeros makes of a state."""
    c = np.arange(256, dtype=np.uint16) << 8
    for _ in range(8):
        c = (c << 1) ^ np.where(c & 0x8000, poly, 0).astype(np.uint16)
    on = lambda x: (x << 8) ^ c[x >> 8]
    place = [c]
    for _ in range(CHUNK - 1):
        place.append(on(place[-1]))
    state = np.arange(1 << 16, dtype=np.uint16)
    for _ in range(CHUNK):
        state = on(state)
    return c.tolist(), np.concatenate(place[::-1]), state.tolist()


def crc16(data: bytes, poly: int = 0x8005, start: int = 0xFFFF) -> int:
    """Most-significant-bit-first CRC over all bytes.

    Zeros in front leave a state of 0 as it is, and a start value is the same
    as its two bytes xored onto the first two: so chunks of any text align to
    its end.
    """
    byte, place, zeros = _tables(poly)
    if len(data) < 2:
        c = start
        for v in data:
            c = (c << 8 & 0xFF00) ^ byte[c >> 8 ^ v]
        return c
    data = bytes(-len(data) % CHUNK) + bytes([data[0] ^ start >> 8, data[1] ^ start & 0xFF]) + data[2:]
    at, c = np.arange(CHUNK, dtype=np.int32) * 256, 0
    for lo in range(0, len(data), SLAB):
        part = np.frombuffer(data, np.uint8, min(SLAB, len(data) - lo), lo).reshape(-1, CHUNK)
        for x in np.bitwise_xor.reduce(place[part + at], axis=1).tolist():
            c = zeros[c] ^ x
    return c
