"""Power-law quantisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIAS, LARGEST = 0.4054, 8191


def quantise(x: Column, sf: Column | int) -> Column:
    step = F.pow(F.lit(2.0), (sf - 100 if isinstance(sf, Column) else F.lit(sf - 100)) * -0.1875)
    q = F.least(F.floor(F.sqrt(F.abs(x) * F.sqrt(F.abs(x))) * step + BIAS), F.lit(LARGEST))
    return (F.when(x < 0, -q).otherwise(q)).cast("int")


def dequantise(q: Column, sf: Column | int) -> Column:
    """Scalefactors outside 0 to 255 are taken to the nearer end."""
    s = F.least(F.greatest(sf, F.lit(0)), F.lit(255)) if isinstance(sf, Column) else F.lit(min(max(sf, 0), 255))
    return F.signum(q.cast("double")) * F.pow(F.abs(q).cast("double"), F.lit(4 / 3)) * F.pow(F.lit(2.0), (s - 100) / 4)


def peak_scalefactor(peak: Column, target: float) -> Column:
    p34 = F.sqrt(peak * F.sqrt(peak))
    sf = F.round(100 + F.log2(p34 / target) / 0.1875)
    return F.when(peak > 0, F.least(F.lit(255.0), F.greatest(F.lit(0.0), sf))).otherwise(100.0).cast("int")


def form_scalefactor(root_sum: Column, threshold: Column) -> Column:
    """From the sum of the lines' square roots; null for an empty band."""
    return F.when(root_sum > 0, 100 + F.floor(8 / 3 * F.log2(6.75 * threshold / root_sum))).cast("int")


def least_scalefactor(peak: Column, floor: int = 0) -> Column:
    return F.when(peak > 0, 100 + F.ceil(16 / 3 * (0.75 * F.log2(peak) - F.log2(F.lit(LARGEST - 0.5))))).otherwise(floor).cast("int")


def least_codebook(largest: Column) -> Column:
    """First book that holds a band's largest magnitude; null for silence."""
    out = F.when(largest == 0, F.lit(None))
    for bound, book in ((1, 1), (2, 3), (4, 5), (7, 7), (12, 9)):
        out = out.when(largest <= bound, book)
    return out.otherwise(11).cast("int")
