"""Loudness and gain records, coding tables, and pair coding over synthetic fields."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.tables import GROUPING, RATE_BOUNDARIES, SHORT_48
from ..sources.signals import table
from .registry import plan

#: Methods whose value is a loudness in quarter steps.
_LOUDNESS = (0, 1, 2, 4, 5, 6)


@plan(
    "o18_method_value",
    "select event_id, round(case when m in (0, 1, 2, 4, 5, 6) then -57.75 + r * 0.25 when m = 3 then case when r = 0 then 0 when r <= 128 then r * 0.25 when r <= 204 then r * 0.5 - 32 else r - 134 end when m = 7 then r % 32 + 80 when m = 8 then r % 4 else -116 + r * 0.5 end, 6) as value from (select event_id, event_id % 10 as m, (event_id * 37) % 256 as r from events) t",
)
def o18(spark, sf_dir):
    """Methods 0 to 9 of a loudness record: quarter-step loudness, a three-piece range, mixing level, room, half steps."""
    e = F.col("event_id")
    m, r = e % 10, e * 37 % 256
    spread = F.when(r == 0, 0.0).when(r <= 128, r * 0.25).when(r <= 204, r * 0.5 - 32).otherwise(r - 134.0)
    value = F.when(m.isin(*_LOUDNESS), r * 0.25 - 57.75).when(m == 3, spread).when(m == 7, r % 32 + 80.0).when(m == 8, (r % 4).cast("double")).otherwise(r * 0.5 - 116)
    return table(spark, sf_dir, "events").select("event_id", F.round(value, 6).alias("value"))


@plan(
    "o22_offset_formula",
    "select event_id, round(case s when 0 then 0 when 1 then 0.5 * floor(0.5 + a) when 2 then 0.5 * floor(0.5 + 2 * a) else 0.5 * floor(0.5 + 2 * b) end, 6) + 0.0 as db from (select event_id, event_id % 4 as s, 20 * log10((1 + event_id % 7) / (1.0::double + event_id % 5)) as a, 10 * log10(pow(10, 0.1 * (-(event_id % 11))) + pow(10, 0.1 * (-(event_id % 13)))) as b from events) t",
)
def o22(spark, sf_dir):
    """Downmix offset in half dB: none, by channel counts in whole or half steps, or by the coefficients' power."""
    e = F.col("event_id")
    a = 20 * F.log10((1 + e % 7) / (1 + e % 5))
    power = lambda m: F.pow(F.lit(10.0), -(e % m) * 0.1)
    b = 10 * F.log10(power(11) + power(13))
    half = lambda x: F.floor(x + 0.5) * 0.5
    db = F.when(e % 4 == 0, 0.0).when(e % 4 == 1, half(a)).when(e % 4 == 2, half(a * 2)).otherwise(half(b * 2))
    return table(spark, sf_dir, "events").select("event_id", (F.round(db, 6) + 0.0).alias("db"))


#: Layout group of each sampling-rate index.
_GROUP = [0, 0, 1, 2, 2, 3, 4, 4, 5, 5, 5, 6]


@plan("p10_band_table", "select event_id, [0, 0, 1, 2, 2, 3, 4, 4, 5, 5, 5, 6][1 + case " + " ".join(f"when hz >= {b} then {i}" for i, b in enumerate(RATE_BOUNDARIES)) + " end] as layout from (select event_id, event_id * 53 % 100000 as hz from events) t")
def p10(spark, sf_dir):
    """Layout group of a rate: its index by the boundaries, then the group that shares the band table."""
    e = F.col("event_id")
    hz = e * 53 % 100000
    below = sum((F.when(hz < b, 1).otherwise(0) for b in RATE_BOUNDARIES), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, _GROUP)), below).alias("layout"))


@plan(
    "p12_coding_bands",
    "with g as (select case_id, unnest(range(4)) as g, unnest(gs) as len from (values " + ", ".join(f"({k}, {g})" for k, g in enumerate(GROUPING)) + ") t(case_id, gs)), b as (select unnest(range(14)) as sfb, unnest([4,4,4,4,4,8,8,8,12,12,12,16,16,16]) as w), c as (select case_id, g * 14 + sfb as band, w * len as width from g, b) select case_id, band, cast(sum(width) over (partition by case_id order by band) - width as bigint) as lo from c",
)
def p12(spark, sf_dir):
    """The short-window table once per group, each band widened by the group's length."""
    widths = F.array(*map(F.lit, SHORT_48))
    cases = spark.createDataFrame([(k, g) for k, g in enumerate(GROUPING)], "case_id int, gs array<int>")
    wide = F.flatten(F.transform("gs", lambda n: F.transform(widths, lambda w: w * n)))
    sums = F.aggregate(wide, F.array(F.lit(0).cast("bigint")), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    return cases.select("case_id", F.posexplode(F.slice(sums, F.lit(1), F.size(sums) - 1)).alias("band", "lo"))


@plan(
    "q10_principal_matrix",
    "with p as (select event_id, pow(10, (event_id % 31 - 15.5) / 20) as c, greatest(0.05, (event_id % 21) / 20.0) as rho from events), q as (select *, 0.5 * atan(2 * c * rho / (c * c - 1)) as a0, 1 + (4 * rho * rho - 4) / pow(c + 1 / c, 2) as mu from p), r as (select *, case when a0 < 0 then a0 + pi() / 2 else a0 end as alpha, atan(sqrt(greatest(0, 1 - sqrt(greatest(0, mu))) / (1 + sqrt(greatest(0, mu))))) as gamma from q) select event_id, round(sqrt(2) * cos(alpha) * cos(gamma), 7) as h11, round(sqrt(2) * sin(alpha) * cos(gamma), 7) as h12, round(-sqrt(2) * sin(alpha) * sin(gamma), 7) + 0.0 as h21, round(sqrt(2) * cos(alpha) * sin(gamma), 7) as h22 from r",
)
def q10(spark, sf_dir):
    """Mixing matrix by principal axes: the angle of the pair's covariance and its spread."""
    e = F.col("event_id")
    c = F.pow(F.lit(10.0), (e % 31 - 15.5) / 20)
    rho = F.greatest(F.lit(0.05), (e % 21) / 20)
    turn = F.atan(c * rho * 2 / (c * c - 1)) * 0.5
    alpha = F.when(turn < 0, turn + math.pi / 2).otherwise(turn)
    root = F.sqrt(F.greatest(F.lit(0.0), (rho * rho * 4 - 4) / ((c + 1 / c) * (c + 1 / c)) + 1))
    gamma = F.atan(F.sqrt(F.greatest(F.lit(0.0), 1 - root) / (1 + root)))
    s = math.sqrt(2)
    h = {"h11": F.cos(alpha) * F.cos(gamma) * s, "h12": F.sin(alpha) * F.cos(gamma) * s, "h21": F.sin(alpha) * F.sin(gamma) * -s, "h22": F.cos(alpha) * F.sin(gamma) * s}
    return table(spark, sf_dir, "events").select("event_id", *[(F.round(v, 7) + 0.0).alias(k) for k, v in h.items()])


@plan("o17_gain_record", "select event_id, '0' || '0' || '0' || '1' || lpad(bin(lvl), 7, '0') || '0' || case when g < 0 then '1' else '0' end || lpad(bin(abs(g)), 7, '0') as bits from (select event_id, event_id % 128 as lvl, event_id % 255 - 127 as g from events) t")
def o17(spark, sf_dir):
    """A one-band gain record with a reference level, as bits."""
    e = F.col("event_id")
    g = e % 255 - 127
    bits = F.concat(F.lit("0001"), F.lpad(F.bin(e % 128), 7, "0"), F.lit("0"), F.when(g < 0, "1").otherwise("0"), F.lpad(F.bin(F.abs(g)), 7, "0"))
    return table(spark, sf_dir, "events").select("event_id", bits.alias("bits"))


@plan("o4_gain_record_parse", "select event_id, event_id % 128 as level, event_id % 255 - 127 as gain from events")
def o4(spark, sf_dir):
    """Reads o17's records back (what the oracle states)."""
    b = o17(spark, sf_dir)
    number = lambda at, n: F.conv(F.substring("bits", at, n), 2, 10).cast("bigint")
    return b.select("event_id", number(5, 7).alias("level"), (number(14, 7) * F.when(F.substring("bits", 13, 1) == "1", -1).otherwise(1)).alias("gain"))
