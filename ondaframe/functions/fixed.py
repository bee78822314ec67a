"""Fixed-point arithmetic as column expressions over BIGINT.  Results are 32-bit values unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX32, MIN32 = 2**31 - 1, -(2**31)
MAX64, MIN64 = 2**63 - 1, -(2**63)


def _c(x) -> Column:
    return x.cast("bigint") if isinstance(x, Column) else F.lit(x).cast("bigint")


def sat(x: Column) -> Column:
    return F.least(_c(MAX32), F.greatest(_c(MIN32), x))


def wrap(x: Column) -> Column:
    """Two's complement of the low 32 bits."""
    low = x.bitwiseAND(_c(0xFFFFFFFF))
    return F.when(low > MAX32, low - 2**32).otherwise(low)


def wrap16(x: Column) -> Column:
    low = x.bitwiseAND(_c(0xFFFF))
    return F.when(low > 32767, low - 65536).otherwise(low)


def asr(x: Column, n: Column | int) -> Column:
    """Arithmetic shift right by 0 to 62 bits."""
    return F.call_function("shiftright", x, _c(n).cast("int"))


def shl(a: Column, n: Column) -> Column:
    """Left by n (mod 256); 0 from 32 on."""
    k = n.bitwiseAND(_c(255))
    return F.when(k > 31, _c(0)).otherwise(wrap(F.call_function("shiftleft", a, F.least(k, _c(31)).cast("int"))))


def shr(a: Column, n: Column) -> Column:
    """Arithmetic right by n (mod 256); the sign from 31 on."""
    return asr(a, F.least(n.bitwiseAND(_c(255)), _c(31)))


def shl_sat(a: Column, n: Column) -> Column:
    k = F.greatest(n, _c(0))
    return F.when(n >= 31, F.when(a > 0, _c(MAX32)).when(a < 0, _c(MIN32)).otherwise(_c(0))).otherwise(sat(F.call_function("shiftleft", a, F.least(k, _c(30)).cast("int"))))


def shl_dir_sat(a: Column, n: Column) -> Column:
    return F.when(n < 0, shr(a, -n)).otherwise(shl_sat(a, n))


def shr_dir_sat(a: Column, n: Column) -> Column:
    return F.when(n < 0, shl_sat(a, -n)).otherwise(shr(a, n))


def norm(a: Column) -> Column:
    """Redundant sign bits."""
    m = F.when(a < 0, -a - 1).otherwise(a)
    return F.when(m == 0, _c(31)).otherwise(31 - F.length(F.bin(m))).cast("bigint")


def abs_sat(a: Column) -> Column:
    return F.least(_c(MAX32), F.abs(a))


def negate_sat(a: Column) -> Column:
    return F.least(_c(MAX32), -a)


def mul16(a: Column, b: Column) -> Column:
    return a * b


def mul16_shl_sat(a: Column, b: Column) -> Column:
    return F.when(a * b == 2**30, _c(MAX32)).otherwise(wrap(a * b * 2))


def mul32x16(a: Column, b: Column) -> Column:
    return asr(a * b, 16)


def mul32x16_shl_sat(a: Column, b: Column) -> Column:
    return F.when((a == MIN32) & (b == -32768), _c(MAX32)).otherwise(wrap(asr(a * b, 16) * 2))


def mul32(a: Column, b: Column) -> Column:
    return asr(a * b, 32)


def mul32_shl_sat(a: Column, b: Column) -> Column:
    return F.when((a == MIN32) & (b == MIN32), _c(MAX32)).otherwise(wrap(asr(a * b, 32) * 2))


def add64_sat(a: Column, b: Column) -> Column:
    wide = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.least(F.lit(MAX64).cast("decimal(21,0)"), F.greatest(F.lit(MIN64).cast("decimal(21,0)"), wide)).cast("bigint")


def high16(a: Column) -> Column:
    return asr(a, 16)


def low16(a: Column) -> Column:
    return wrap16(a)


def div(a: Column, b: Column) -> tuple[Column, Column]:
    """Quotient and exponent of a normalised division: 31 bits of |a| 2^norm(a) / (|b| 2^norm(b)), signed.

    The restoring loop's result is the integer quotient of the mantissas
    scaled by 2^30, so it needs no loop.  b = 0 gives a and 0.  Neither may be -2^31.
    """
    x, y = F.abs(a), F.abs(b)
    safe = F.when(b == 0, _c(1)).otherwise(y)
    num = F.call_function("shiftleft", x, norm(x).cast("int")) * 2**30
    q = F.call_function("div", num, F.call_function("shiftleft", safe, norm(safe).cast("int")))
    # without a divisor the sign of a stays
    quotient = F.when(b == 0, a).when((a < 0) != (b < 0), -q).otherwise(q)
    return quotient, F.when(b == 0, _c(0)).otherwise(30 + norm(x) - norm(safe))
