"""Fixed-point operators over 32-bit vectors derived from events, the extremes among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..sources.signals import table
from .registry import plan

_V = """v as (select event_id,
  case when event_id % 17 = 0 then -2147483648 when event_id % 19 = 0 then 2147483647 when event_id % 23 = 0 then 0 else ((event_id * 2654435761) & 4294967295) - 2147483648 end as a,
  case when event_id % 13 = 0 then -2147483648 when event_id % 29 = 0 then 2147483647 when event_id % 31 = 0 then 0 else ((user_id * 2654404609 + event_id * 97003) & 4294967295) - 2147483648 end as b,
  case when event_id % 11 = 0 then -32768 else (event_id * 7919) % 65536 - 32768 end as c,
  case when event_id % 7 = 0 then -32768 else (event_id * 104729) % 65536 - 32768 end as d,
  event_id % 71 - 35 as k from events)"""
#: Wrapping and saturating as SQL over an expression.
_W = lambda x: f"(((({x}) + 2147483648) & 4294967295) - 2147483648)"
_S = lambda x: f"least(2147483647, greatest(-2147483648, {x}))"
_SHR = lambda a, n: f"(({a}) >> cast(least(({n}) & 255, 31) as integer))"
_SHLSAT = lambda a, n: f"(case when ({n}) <= 0 then {a} when ({n}) >= 31 then (case when {a} > 0 then 2147483647 when {a} < 0 then -2147483648 else 0 end) else least(2147483647, greatest(-2147483648, ({a}) * cast(pow(2, least(greatest({n}, 0), 30)) as bigint))) end)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    i, u = F.col("event_id"), F.col("user_id")

    def pick(rest, *cases):
        out = None
        for m, v in cases:
            out = F.when(i % m == 0, F.lit(v).cast("bigint")) if out is None else out.when(i % m == 0, F.lit(v).cast("bigint"))
        return out.otherwise(rest)

    low = F.lit(0xFFFFFFFF).cast("bigint")
    return e.select(
        i,
        pick((i * 2654435761).bitwiseAND(low) - 2**31, (17, X.MIN32), (19, X.MAX32), (23, 0)).alias("a"),
        pick((u * 2654404609 + i * 97003).bitwiseAND(low) - 2**31, (13, X.MIN32), (29, X.MAX32), (31, 0)).alias("b"),
        pick((i * 7919) % 65536 - 32768, (11, -32768)).alias("c"),
        pick((i * 104729) % 65536 - 32768, (7, -32768)).alias("d"),
        (i % 71 - 35).alias("k"),
    )


def _simple(key: str, exprs: dict, sql: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vectors(spark, sf_dir).select("event_id", *[v().cast("bigint").alias(n) for n, v in exprs.items()])

    cols = ", ".join(f"cast({v} as bigint) as {n}" for n, v in sql.items())
    plan(key, f"with {_V} select event_id, {cols} from v")(run)


A, B, C, D, K = (lambda n=n: F.col(n) for n in "abcdk")
_simple("m1_saturating_add", {"add": lambda: X.sat(A() + B()), "sub": lambda: X.sat(A() - B()), "add3": lambda: X.sat(A() + B() + C())}, {"add": _S("a + b"), "sub": _S("a - b"), "add3": _S("a + b + c")})
_simple("m2_wrapping_add", {"add": lambda: X.wrap(A() + B()), "sub": lambda: X.wrap(A() - B())}, {"add": _W("a + b"), "sub": _W("a - b")})
_simple("m3_saturating_shift", {"left": lambda: X.shl_dir_sat(A(), K()), "right": lambda: X.shr_dir_sat(A(), K())}, {"left": f"case when k < 0 then {_SHR('a', '-k')} else {_SHLSAT('a', 'k')} end", "right": f"case when k < 0 then {_SHLSAT('a', '-k')} else {_SHR('a', 'k')} end"})
_simple(
    "m4_limited_shift",
    {"left": lambda: F.when(K() < 0, X.shr(A(), F.least(-K(), F.lit(31).cast("bigint")))).otherwise(X.shl_sat(A(), K())), "plain": lambda: X.shl(A(), F.abs(K()))},
    {"left": f"case when k < 0 then {_SHR('a', 'least(-k, 31)')} else {_SHLSAT('a', 'k')} end", "plain": f"case when abs(k) > 31 then 0 else {_W('a * cast(pow(2, least(abs(k), 31)) as bigint)')} end"},
)
_simple("m5_normalise", {"norm": lambda: X.norm(A()), "norm_small": lambda: X.norm(C())}, {"norm": "case when a in (0, -1) then 31 else 31 - length(bin(case when a < 0 then -a - 1 else a end)) end", "norm_small": "case when c in (0, -1) then 31 else 31 - length(bin(case when c < 0 then -c - 1 else c end)) end"})
_simple("m6_abs_negate", {"absolute": lambda: X.abs_sat(A()), "negated": lambda: X.negate_sat(A())}, {"absolute": "least(2147483647, abs(a))", "negated": "least(2147483647, -a)"})
_simple(
    "m7_multiply",
    {"m16": lambda: X.mul16(C(), D()), "m16s": lambda: X.mul16_shl_sat(C(), D()), "m3216": lambda: X.mul32x16(A(), C()), "m3216s": lambda: X.mul32x16_shl_sat(A(), C()), "m32": lambda: X.mul32(A(), B()), "m32s": lambda: X.mul32_shl_sat(A(), B()), "m3216w": lambda: X.sat(A() * C())},
    {"m16": "c * d", "m16s": f"case when c * d = 1073741824 then 2147483647 else {_W('c * d * 2')} end", "m3216": "(a * c) >> 16", "m3216s": f"case when a = -2147483648 and c = -32768 then 2147483647 else {_W('((a * c) >> 16) * 2')} end", "m32": "(a * b) >> 32", "m32s": f"case when a = -2147483648 and b = -2147483648 then 2147483647 else {_W('((a * b) >> 32) * 2')} end", "m3216w": _S("a * c")},
)
_simple(
    "m8_multiply_accumulate",
    {"mac16": lambda: X.sat(A() + X.mul16(C(), D())), "mac16s": lambda: X.sat(A() + X.mul16_shl_sat(C(), D())), "msu16": lambda: X.wrap(A() - C() * D()), "mac3216": lambda: X.wrap(A() + X.mul32x16(B(), C())), "mac3216s": lambda: X.sat(A() + X.mul32x16_shl_sat(B(), C()))},
    {"mac16": _S("a + c * d"), "mac16s": _S(f"a + case when c * d = 1073741824 then 2147483647 else {_W('c * d * 2')} end"), "msu16": _W("a - c * d"), "mac3216": _W("a + ((b * c) >> 16)"), "mac3216s": _S(f"a + case when b = -2147483648 and c = -32768 then 2147483647 else {_W('((b * c) >> 16) * 2')} end")},
)
_simple("m9_accumulate64", {"product": lambda: A() * B(), "sum": lambda: X.add64_sat(A() * B(), A() * B()), "three": lambda: X.add64_sat(X.add64_sat(A() * B(), A() * B()), A() * A())}, {"product": "a * b", "sum": "least(9223372036854775807::hugeint, 2::hugeint * (a * b))", "three": "least(9223372036854775807::hugeint, least(9223372036854775807::hugeint, 2::hugeint * (a * b)) + a * a)"})
_simple("m10_saturate64", {"product": lambda: X.sat(A() * B()), "small": lambda: X.sat(C() * D() * 3)}, {"product": _S("a * b"), "small": _S("c * d * 3")})
_simple("m12_halves", {"high": lambda: X.high16(A()), "low": lambda: X.low16(A()), "up": lambda: C() * 65536}, {"high": "a >> 16", "low": "((a + 32768) & 65535) - 32768", "up": "c * 65536"})

_SAFE = "s as (select event_id, case when a = -2147483648 then -7 else a end as a, case when b = -2147483648 then 5 when event_id % 37 = 0 then 0 else b end as b from v)"
_LEN = lambda a: f"(case when abs({a}) = 0 then 31 else 31 - length(bin(abs({a}))) end)"


@plan(
    "m11_normalised_division",
    f"with {_V}, {_SAFE} select event_id, cast(case when b = 0 then a else (case when (a < 0) != (b < 0) then -1 else 1 end) * ((abs(a) * cast(pow(2, {_LEN('a')}) as bigint) * 1073741824) // (abs(b) * cast(pow(2, {_LEN('b')}) as bigint))) end as bigint) as quotient, cast(case when b = 0 then 0 else 30 + {_LEN('a')} - {_LEN('b')} end as bigint) as exponent from s".replace("// (abs(b)", "// (greatest(abs(b), 1)"),
)
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    v = v.select("event_id", F.when(F.col("a") == X.MIN32, F.lit(-7)).otherwise(F.col("a")).cast("bigint").alias("a"), F.when(F.col("b") == X.MIN32, F.lit(5)).when(F.col("event_id") % 37 == 0, F.lit(0)).otherwise(F.col("b")).cast("bigint").alias("b"))
    q, e = X.div(F.col("a"), F.col("b"))
    return v.select("event_id", q.cast("bigint").alias("quotient"), e.cast("bigint").alias("exponent"))
