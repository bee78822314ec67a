"""Masking model as column expressions over per-frame arrays of bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import QUIET_DB, offsets

SELF_MASK, CLIP_LONG, CLIP_SHORT = 0.001258925, 1.0e9, 15_625_000.0
SLOPE_UP, SLOPE_DOWN = 1.5, 3.0
RISE, REMAIN, NO_LIMIT = 2.0, 0.01, 1.0e20


def bark(hz: float) -> float:
    return 13.3 * math.atan(0.00076 * hz) + 3.5 * math.atan(1.3333333e-4 * hz) ** 2


def band_bark(widths: list[int], rate: int) -> list[float]:
    """Bark at each band's centre: the mean of its edges'."""
    off = offsets(widths)
    edge = [bark(o * rate * 0.5 / off[-1]) for o in off]
    edge[0] = 0.0
    return [(a + b) * 0.5 for a, b in zip(edge, edge[1:])]


def slopes(widths: list[int], rate: int, up: float = SLOPE_UP, down: float = SLOPE_DOWN) -> tuple[list[float], list[float]]:
    """Gain from the band below to each band, and from the band above."""
    b = band_bark(widths, rate)
    gap = [y - x for x, y in zip(b, b[1:])]
    return [0.0, *(10 ** (-up * d) for d in gap)], [*(10 ** (-down * d) for d in gap), 0.0]


def quiet(widths: list[int], rate: int) -> list[float]:
    b, lines = band_bark(widths, rate), sum(widths)
    floor = (32768.0 * lines) ** 2 * 10 ** (-9.6)
    db = lambda x: QUIET_DB[min(int(min(max(x, 0.0), 24.0)), 24)]
    low = [0.5 * (x + p) if p is not None else 0.5 * x for x, p in zip(b, [None, *b])]
    high = [0.5 * (x + n) if n is not None else x for x, n in zip(b, [*b[1:], None])]
    return [floor * 10 ** (min(db(x), db(y)) / 10) * w for x, y, w in zip(low, high, widths)]


def doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def band_sums(x: Column, widths: list[int], f=lambda v: v * v) -> Column:
    """array<double>: sum of f over each band's lines."""
    off = offsets(widths)
    return F.array(*[F.aggregate(F.slice(x, a + 1, w), F.lit(0.0), lambda acc, v: acc + f(v)) for a, w in zip(off, widths)])


def self_mask(energy: Column, clip: float = CLIP_LONG) -> Column:
    return F.transform(energy, lambda e: F.least(e * SELF_MASK, F.lit(clip)))


def spread(values: Column, up: list[float], down: list[float]) -> Column:
    """Running maximum upwards, then downwards, each step under its gain."""
    empty = F.array().cast("array<double>")
    gu, gd = doubles(up), doubles(down[::-1])

    def step(gains):
        return lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(F.greatest(v, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) * F.get(gains, F.size(acc))))))

    rising = F.aggregate(values, empty, step(gu))
    return F.reverse(F.aggregate(F.reverse(rising), empty, step(gd)))


def pre_echo(now: Column, before: Column) -> Column:
    """Threshold held to twice the one before, but not below 1 % of itself; before: null for none."""
    return F.greatest(F.least(now, F.coalesce(before, F.lit(NO_LIMIT)) * RISE), now * REMAIN)


def entropy(energy: Column, threshold: Column, widths: list[int]) -> Column:
    """Bits a frame needs: half its lines' log ratio of energy to threshold, none below it."""
    parts = F.transform(F.arrays_zip(energy.alias("e"), threshold.alias("t"), doubles(widths).alias("w")), lambda z: z["w"] * 0.5 * F.log2(F.greatest(z["e"] / z["t"], F.lit(1.0))))
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def least_snr(widths: list[int], rate: int, bitrate: int) -> list[float]:
    """Least noise-to-mask share by the bits that a band's Bark width earns."""
    b, lines = band_bark(widths, rate), sum(widths)
    bits = 1.18 * bitrate / rate * lines
    scale = 1.0 / min(b[-1] / 24.0, 1.0)
    out, before = [], 0.0
    for x, w in zip(b, widths):
        edge = 2.0 * x - before
        snr = 2.0 ** (bits * 0.024 * scale * (edge - before) / max(w, 1)) - 1.5
        out.append(min(max(1.0 / max(snr, 1.0), 0.003), 0.8))
        before = edge
    return out
