"""Spectral reconstruction: dequantisation, stereo, noise, prediction filters, PCM output."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import quant as Q
from ..functions.tables import DOWNMIX, DOWNMIX_ORDER, RATE_BOUNDARIES, RATES, SHORT_48, offsets
from ..sources.signals import PCM_SQL, SPEC_SQL, frames, frames_sql, long_form, pcm, spectra, table
from .encoder import BAND_SQL, BANDS, OFF, STEREO_SQL, stereo
from .registry import plan

N = 128
FR = frames_sql(N)
#: Quantised lines stand in the samples' low bits; the scalefactor runs with the frame.
_Q = "cast(x as integer) % 97 * case when i % 2 = 0 then 1 else -1 end"
_SF = "(cast(f * 7 % 300 as integer) - 20)"


def _lines(spark, sf_dir):
    q = F.transform("x", lambda v, i: (v.cast("int") % 97) * F.when(i % 2 == 0, 1).otherwise(-1))
    return frames(pcm(spark, sf_dir), N).select("stream", "f", q.alias("q"), ((F.col("f") * 7 % 300).cast("int") - 20).alias("sf"))


@plan("d2_dequantise_band", f"with {FR}, q as (select *, {_Q} as q, least(255, greatest(0, {_SF})) as sf from fr) select stream, f, i, round(sign(q) * pow(abs(q), 4.0 / 3) * pow(2.0, (sf - 100) / 4.0), 4) as x from q")
def d2(spark, sf_dir):
    d = _lines(spark, sf_dir).select("stream", "f", F.transform("q", lambda q: F.round(Q.dequantise(q, F.col("sf")), 4) + 0.0).alias("x"))
    return long_form(d, "x", "i", "x")


def _at(sf: int):
    return lambda q: F.round(Q.dequantise(q, sf), 4) + 0.0


@plan("d1_dequantise_channel", f"with {FR}, {BAND_SQL}, q as (select *, {_Q} as q from fr) select stream, f, i, round(case when book = 0 or book >= 13 then 0 else sign(q) * pow(abs(q), 4.0 / 3) * pow(2.0, (90 + band - 100) / 4.0) end, 4) as x from (select *, (f + band) % 16 as book from q join bands on i >= lo and i < hi) t")
def d1(spark, sf_dir):
    parts = []
    for b, (a, w) in enumerate(zip(OFF, SHORT_48, strict=False)):
        book = (F.col("f") + b) % 16
        parts.append(F.when((book == 0) | (book >= 13), F.array_repeat(F.lit(0.0), w)).otherwise(F.transform(F.slice("q", a + 1, w), _at(90 + b))))
    return long_form(_lines(spark, sf_dir).select("stream", "f", F.concat(*parts).alias("x")), "x", "i", "x")


@plan("d5_noise_seed", "select event_id, cast((((event_id * 2654435769) & 4294967295) + 2147483648) & 4294967295 as bigint) - 2147483648 as seed from events")
def d5(spark, sf_dir):
    """The channel lies above the 32 bits that stay, so it does not count."""
    return table(spark, sf_dir, "events").select("event_id", X.wrap(F.col("event_id") * 0x9E3779B9).alias("seed"))


def _noise(seed, n: int):
    """n samples of the congruential generator, as 64-bit values."""

    def step(acc, _):
        last = X.wrap(F.get(acc, F.size(acc) - 1) * 1664525 + 1013904223)
        return F.concat(acc, F.array(last))

    run = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(seed.cast("bigint")), step)
    return F.transform(F.slice(run, 2, n), lambda s: X.asr(s, 3))


@plan(
    "d3_noise_substitution",
    "with recursive r as (select event_id, 0 as i, ((((event_id * 2654435769) & 4294967295) + 2147483648) & 4294967295) - 2147483648 as s, event_id % 40 as energy from events union all select event_id, i + 1, (((s * 1664525 + 1013904223) + 2147483648) & 4294967295) - 2147483648, energy from r where i < 8) select event_id, i - 1 as i, round((s >> 3) / sqrt(sum(pow(s >> 3, 2)) over (partition by event_id)) * pow(2.0, energy / 4.0), 6) as x from r where i > 0",
)
def d3(spark, sf_dir):
    """Bands of 8 lines, each frame's seed its own, scaled to the band's energy."""
    e = table(spark, sf_dir, "events").select("event_id", _noise(X.wrap(F.col("event_id") * 0x9E3779B9), 8).alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    gain = F.pow(F.lit(2.0), (F.col("event_id") % 40) / 4)
    return long_form(e.select("event_id", F.transform("s", lambda v: F.round(v / norm * gain, 6)).alias("x")), "x", "i", "x")


@plan("d4_noise_fill", f"with {SPEC_SQL} select vec_id, k, round(x / sqrt(sum(x * x) over (partition by vec_id)) * pow(2.0, (vec_id % 60) / 4.0), 5) as x from sp")
def d4(spark, sf_dir):
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    gain = F.pow(F.lit(2.0), (F.col("vec_id") % 60) / 4)
    return long_form(spectra(spark, sf_dir).select("vec_id", F.transform("x", lambda v: F.round(v / norm * gain, 5)).alias("x")), "x", "k", "x")


def _rotated(on):
    return lambda l, r: F.struct(F.when(on, l + r).otherwise(l).alias("left_x"), F.when(on, l - r).otherwise(r).alias("right_x"))


@plan("d6_mid_side", f"with {STEREO_SQL}, {BAND_SQL} select f, i, case when (f + band) % 3 > 0 and (f * band) % 5 < 3 then l + r else l end as left_x, case when (f + band) % 3 > 0 and (f * band) % 5 < 3 then l - r else r end as right_x from st join bands on i >= lo and i < hi")
def d6(spark, sf_dir):
    """Sum and difference where the mask is set and the right band is not coded as intensity."""
    parts = []
    for b, (a, w) in enumerate(zip(OFF, SHORT_48, strict=False)):
        on = ((F.col("f") + b) % 3 > 0) & ((F.col("f") * b) % 5 < 3)
        parts.append(F.zip_with(F.slice("l", a + 1, w), F.slice("r", a + 1, w), _rotated(on)))
    return stereo(spark, sf_dir).select("f", F.posexplode(F.concat(*parts)).alias("i", "p")).select("f", "i", "p.*")


def _scaled(gain):
    return lambda v: F.round(v * gain, 6) + 0.0


@plan("d7_intensity_stereo", f"with {STEREO_SQL}, {BAND_SQL} select f, i, round(l * case when (f + band) % 2 = 0 then 1 else -1 end * case when band % 3 = 0 then -1 else 1 end * pow(2.0, -0.25 * (band - 5)), 6) as right_x from st join bands on i >= lo and i < hi")
def d7(spark, sf_dir):
    parts = []
    for b, (a, w) in enumerate(zip(OFF, SHORT_48, strict=False)):
        gain = F.when((F.col("f") + b) % 2 == 0, 1.0).otherwise(-1.0) * (-1.0 if b % 3 == 0 else 1.0) * F.pow(F.lit(2.0), F.lit(-0.25 * (b - 5)))
        parts.append(F.transform(F.slice("l", a + 1, w), _scaled(gain)))
    return long_form(stereo(spark, sf_dir).select("f", F.concat(*parts).alias("x")), "x", "i", "right_x")


#: A fixed third-order filter for the prediction operators.
LPC = [0.7, -0.25, 0.125]


@plan("d10_all_zero_filter", f"with {SPEC_SQL} select vec_id, k, round(x + 0.7 * coalesce(lag(x, 1) over w, 0) - 0.25 * coalesce(lag(x, 2) over w, 0) + 0.125 * coalesce(lag(x, 3) over w, 0), 6) as y from sp window w as (partition by vec_id order by k)")
def d10(spark, sf_dir):
    y = F.transform("x", lambda v, k: F.round(v + sum((c * F.coalesce(F.get("x", F.when(k > j, k - j - 1)), F.lit(0.0)) for j, c in enumerate(LPC)), F.lit(0.0)), 6) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


def all_pole(x, coefficients):
    """y[n] = x[n] - sum a_j y[n - j]: one array in, one out."""

    def step(acc, v):
        n = F.size(acc)
        back = sum((c * F.coalesce(F.get(acc, F.when(n > j, n - j - 1)), F.lit(0.0)) for j, c in enumerate(coefficients)), F.lit(0.0))
        return F.concat(acc, F.array(v - back))

    return F.aggregate(x, F.array().cast("array<double>"), step)


@plan("d9_all_pole_filter", f"with recursive {SPEC_SQL}, y as (select vec_id, k, x as y, 0.0::double as y1, 0.0::double as y2 from sp where k = 0 union all select y.vec_id, s.k, s.x - 0.7 * y.y + 0.25 * y.y1 - 0.125 * y.y2, y.y, y.y1 from y join sp s on s.vec_id = y.vec_id and s.k = y.k + 1) select vec_id, k, round(y, 6) as y from y")
def d9(spark, sf_dir):
    y = F.transform(all_pole(F.col("x"), LPC), lambda v: F.round(v, 6) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


@plan("d13_coupling_mix", f"with {PCM_SQL}, t(tag, target, gain) as (values (0, 'click', 0.5), (0, 'view', 0.25), (1, 'view', -1.0)), c as (select n, case stream when 'purchase' then 0 when 'search' then 1 end as tag, s from pcm where stream in ('purchase', 'search')), m as (select target as stream, n, sum(gain * s) as add from c join t using (tag) group by all) select pcm.stream, n, round(s + coalesce(add, 0), 6) as x from pcm left join m using (stream, n) where pcm.stream in ('click', 'view')")
def d13(spark, sf_dir):
    """Coupling channels found by tag, added to their targets under a gain."""
    p = pcm(spark, sf_dir)
    targets = spark.createDataFrame([(0, "click", 0.5), (0, "view", 0.25), (1, "view", -1.0)], "tag int, target string, gain double")
    c = p.where(F.col("stream").isin("purchase", "search")).select("n", F.when(F.col("stream") == "purchase", 0).otherwise(1).alias("tag"), "s")
    # a fixed table of three rows
    mix = c.join(F.broadcast(targets), "tag").groupBy(F.col("target").alias("stream"), "n").agg(F.sum(F.col("gain") * F.col("s")).alias("more"))
    return p.where(F.col("stream").isin("click", "view")).join(mix, ["stream", "n"], "left").select("stream", "n", F.round(F.col("s") + F.coalesce("more", F.lit(0.0)), 6).alias("x"))


@plan("d15_pcm_output", "select event_id, cast(least(32767.0, greatest(-32768.0, round_even(value * 100.5 - 9000, 0))) as integer) as s from events")
def d15(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.rint(F.col("value") * 100.5 - 9000))).cast("int").alias("s"))


@plan("s28_float_to_pcm", "select event_id, cast(least(32767, greatest(-32768, round((value / 250 - 0.9) * 32768))) as integer) as s from events")
def s28(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.round((F.col("value") / 250 - 0.9) * 32768))).cast("int").alias("s"))


@plan("s26_interleave", f"with {STEREO_SQL} select f, 2 * i as k, l as x from st union all select f, 2 * i + 1, r from st")
def s26(spark, sf_dir):
    return long_form(stereo(spark, sf_dir).select("f", F.flatten(F.zip_with("l", "r", lambda a, b: F.array(a, b))).alias("x")), "x", "k", "x")


@plan("s27_deinterleave", f"with {FR} select stream, f, i % 2 as channel, i // 2 as k, x from fr")
def s27(spark, sf_dir):
    x = frames(pcm(spark, sf_dir), N)
    both = F.array(F.filter("x", lambda v, i: i % 2 == 0), F.filter("x", lambda v, i: i % 2 == 1))
    return x.select("stream", "f", F.posexplode(both).alias("channel", "p")).select("stream", "f", "channel", F.posexplode("p").alias("k", "x"))


@plan("p9_band_offsets", "with w as (select unnest(range(14)) as band, unnest([4,4,4,4,4,8,8,8,12,12,12,16,16,16]) as w) select band, cast(coalesce(sum(w) over (order by band rows between unbounded preceding and 1 preceding), 0) as bigint) as lo, cast(sum(w) over (order by band) as bigint) as hi from w")
def p9(spark, sf_dir):
    o = offsets(SHORT_48)
    return spark.createDataFrame([(b, o[b], o[b + 1]) for b in range(BANDS)], "band int, lo bigint, hi bigint")


@plan("p11_rate_index", "select event_id, case " + " ".join(f"when hz >= {b} then {i}" for i, b in enumerate(RATE_BOUNDARIES)) + " end as idx from (select event_id, event_id * 37 % 100000 as hz from events) t")
def p11(spark, sf_dir):
    hz = F.col("event_id") * 37 % 100000
    idx = F.array_min(F.filter(F.array(*[F.when(hz >= b, F.lit(i)) for i, b in enumerate(RATE_BOUNDARIES)]), lambda v: v.isNotNull()))
    return table(spark, sf_dir, "events").select("event_id", idx.alias("idx"))


@plan("p2_group_derivation", "with w as (select event_id, unnest(range(8)) as w, event_id % 128 as g from events) select event_id, w, cast(sum(case when w > 0 and (g >> (7 - w)) % 2 = 1 then 0 else 1 end) over (partition by event_id order by w) as bigint) - 1 as grp from w".replace("(7 - w)) % 2", "cast(7 - w as integer)) % 2"))
def p2(spark, sf_dir):
    """Window w goes on with the group before it if bit 7 - w is set (the first window never does)."""
    g = (F.col("event_id") % 128).cast("int")

    def step(acc, w):
        goes_on = F.call_function("shiftright", g, 7 - w).bitwiseAND(F.lit(1)) == 1
        last = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(F.when(goes_on, last).otherwise(last + 1)))

    groups = F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.array(F.lit(0).cast("bigint")), step)
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(groups).alias("w", "grp"))


_GROUPS = [1, 3, 3, 1]
_PLACE: list[int] = []
for _g, _n in enumerate(_GROUPS):
    for _b in range(4):
        for _w in range(_n):
            for _l in range(4):
                _PLACE.append((sum(_GROUPS[:_g]) + _w) * 16 + _b * 4 + _l)


@plan("p7_deinterleave_groups", f"with {FR} select stream, f, ({'case i ' + ' '.join(f'when {k} then {p}' for k, p in enumerate(_PLACE)) + ' end'}) as i, x from fr")
def p7(spark, sf_dir):
    """Eight windows of four bands of four lines, grouped 1, 3, 3, 1: from group, band, window order to window order."""
    place = F.array(*map(F.lit, _PLACE))
    return frames(pcm(spark, sf_dir), N).select("stream", "f", F.explode(F.arrays_zip(place.alias("i"), F.col("x"))).alias("p")).select("stream", "f", "p.*")


@plan("p8_group_spectra", f"with {FR} select stream, f, ({'case i ' + ' '.join(f'when {p} then {k}' for k, p in enumerate(_PLACE)) + ' end'}) as i, x from fr")
def p8(spark, sf_dir):
    back = [0] * N
    for k, p in enumerate(_PLACE):
        back[p] = k
    return frames(pcm(spark, sf_dir), N).select("stream", "f", F.explode(F.arrays_zip(F.array(*map(F.lit, back)).alias("i"), F.col("x"))).alias("p")).select("stream", "f", "p.*")


_CH = ["click", "view", "purchase", "search", "login", "logout"]


@plan("o1_downmix", f"with {PCM_SQL}, nums as (select stream, n, s, dense_rank() over (order by stream) - 1 as ch from pcm), g(ch, gl, gr) as (values " + ", ".join(f"({DOWNMIX_ORDER['5.0'][c]}, {a}, {b})" for c, (a, b) in enumerate(DOWNMIX["5.0"])) + ") select n, round(sum(gl * s), 6) as left_x, round(sum(gr * s), 6) as right_x from nums join g using (ch) group by n having count(*) = 5")
def o1(spark, sf_dir):
    """The five streams, in name order, as the channels of a 5.0 frame in decoding order (centre first)."""
    p = pcm(spark, sf_dir)
    # a row per stream, numbered by name; the gains are a fixed table of five rows
    numbers = p.select("stream").distinct().withColumn("ch", F.dense_rank().over(Window.orderBy("stream")) - 1)
    gains = spark.createDataFrame([(DOWNMIX_ORDER["5.0"][c], a, b) for c, (a, b) in enumerate(DOWNMIX["5.0"])], "ch int, gl double, gr double")
    mix = p.join(numbers.join(F.broadcast(gains), "ch"), "stream").groupBy("n").agg(F.sum(F.col("gl") * F.col("s")).alias("l"), F.sum(F.col("gr") * F.col("s")).alias("r"), F.count("*").alias("c"))
    return mix.where(F.col("c") == 5).select("n", F.round("l", 6).alias("left_x"), F.round("r", 6).alias("right_x"))


@plan("o2_downmix_order", "select * from (values " + ", ".join(f"('{k}', {c}, {ch})" for k, v in DOWNMIX_ORDER.items() for c, ch in enumerate(v)) + ") t(layout, col, channel)")
def o2(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(k).alias("layout"), F.array(*map(F.lit, v)).alias("o")) for k, v in DOWNMIX_ORDER.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.layout", F.posexplode("r.o").alias("col", "channel"))


@plan("s4_payload_size", "select event_id, greatest(0, event_id % 40 - case when event_id % 2 = 0 then 7 else 9 end) as size from events")
def s4(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0).cast("bigint"), i % 40 - F.when(i % 2 == 0, 7).otherwise(9)).alias("size"))


del RATES
