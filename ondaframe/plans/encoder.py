"""Encoder analysis: masking, scalefactors, quantisation, stereo and window decisions.

Frames of 128 samples stand for spectra of a 48 kHz short window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import psycho as P
from ..functions import quant as Q
from ..functions.tables import GROUPING, SHORT_48, offsets
from ..sources.signals import frames, frames_sql, long_form, pcm, with_previous
from .registry import plan

N, RATE = 128, 48000
OFF = offsets(SHORT_48)
BANDS = len(SHORT_48)
UP, DOWN = P.slopes(SHORT_48, RATE)
QUIET = P.quiet(SHORT_48, RATE)
FR = frames_sql(N)
BAND_SQL = "bands as (select * from (values " + ", ".join(f"({b}, {OFF[b]}, {OFF[b + 1]})" for b in range(BANDS)) + ") t(band, lo, hi))"
EN = f"{FR}, {BAND_SQL}, en as (select stream, f, band, hi - lo as w, sum(x * x) as e, max(abs(x)) as peak, sum(sqrt(abs(x))) as roots from fr join bands on i >= lo and i < hi group by all)"


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(pcm(spark, sf_dir), N)


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum(spark, sf_dir).select("stream", "f", P.band_sums(F.col("x"), SHORT_48).alias("e"))


def by_band(df: DataFrame, column: str, name: str) -> DataFrame:
    return long_form(df, column, "band", name)


@plan("a6_band_energy", f"with {EN} select stream, f, band, e as energy from en")
def a6(spark, sf_dir):
    return by_band(energies(spark, sf_dir), "e", "energy")


@plan("a7_self_mask", f"with {EN} select stream, f, band, round(least(e * 0.001258925, 1.0e9), 6) as mask from en")
def a7(spark, sf_dir):
    return by_band(energies(spark, sf_dir).select("stream", "f", F.transform(P.self_mask(F.col("e")), lambda v: F.round(v, 6)).alias("m")), "m", "mask")


def _chain_sql() -> str:
    """Wide frame rows: e0.., then masks m0.., rising u0.., falling t0.., as columns by lateral aliases."""
    wide = ", ".join(f"max(case when band = {b} then e end) as e{b}" for b in range(BANDS))
    mask = ", ".join(f"least(e{b} * 0.001258925, 1.0e9) as m{b}" for b in range(BANDS))
    up = ", ".join(["m0 as u0", *[f"greatest(m{b}, u{b - 1} * cast('{UP[b]!r}' as double)) as u{b}" for b in range(1, BANDS)]])
    down = ", ".join([f"u{BANDS - 1} as t{BANDS - 1}", *[f"greatest(u{b}, t{b + 1} * cast('{DOWN[b]!r}' as double)) as t{b}" for b in range(BANDS - 2, -1, -1)]])
    ts = ", ".join(f"t{b}" for b in range(BANDS))
    return f"wide as (select stream, f, {wide} from en group by all), spr as (select stream, f, {mask}, {up}, {down} from wide), lng as (select stream, f, unnest(range({BANDS})) as band, unnest([{ts}]) as t from spr)"


CHAIN = f"{EN}, {_chain_sql()}"
QUIET_SQL = "quiet as (select * from (values " + ", ".join(f"({b}, cast('{q!r}' as double))" for b, q in enumerate(QUIET)) + ") t(band, q))"
THR = f"{CHAIN}, {QUIET_SQL}, thr as (select stream, f, band, greatest(t, q) as t from lng join quiet using (band)), held as (select a.stream, a.f, a.band, greatest(least(a.t, coalesce(b.t, 1.0e20) * 2.0), a.t * 0.01) as t from thr a left join thr b on a.stream = b.stream and a.band = b.band and a.f = b.f + 1)"


@plan("a8_spreading", f"with {CHAIN} select stream, f, band, round(t, 4) as mask from lng")
def a8(spark, sf_dir):
    m = energies(spark, sf_dir).select("stream", "f", P.spread(P.self_mask(F.col("e")), UP, DOWN).alias("m"))
    return by_band(m.withColumn("m", F.transform("m", lambda v: F.round(v, 4))), "m", "mask")


_BARK = "(13.3 * atan(0.00076 * {h}) + 3.5 * pow(atan(0.00013333333 * {h}), 2))"
BARK_SQL = f"{BAND_SQL}, bk as (select band, lo, hi, (case when lo = 0 then 0 else {_BARK.format(h=f'(lo * {RATE} * 0.5 / {N})')} end + {_BARK.format(h=f'(hi * {RATE} * 0.5 / {N})')}) * 0.5 as bark from bands)"


def bands(spark: SparkSession) -> DataFrame:
    rows = [(b, OFF[b], OFF[b + 1]) for b in range(BANDS)]
    return spark.createDataFrame(rows, "band int, lo int, hi int")


def barks(spark: SparkSession) -> DataFrame:
    def of(line):
        hz = line * (RATE * 0.5 / N)
        return 13.3 * F.atan(0.00076 * hz) + 3.5 * F.pow(F.atan(1.3333333e-4 * hz), F.lit(2.0))

    return bands(spark).withColumn("bark", (F.when(F.col("lo") == 0, 0.0).otherwise(of(F.col("lo"))) + of(F.col("hi"))) * 0.5)


@plan("a10_bark", f"with {BARK_SQL} select band, round(bark, 8) as bark from bk")
def a10(spark, sf_dir):
    return barks(spark).select("band", F.round("bark", 8).alias("bark"))


@plan("a9_spreading_gains", f"with {BARK_SQL} select band, round(coalesce(pow(10, -1.5 * (bark - lag(bark) over (order by band))), 0), 8) as up, round(coalesce(pow(10, -3.0 * (lead(bark) over (order by band) - bark)), 0), 8) as down from bk")
def a9(spark, sf_dir):
    both = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(u).alias("up"), F.lit(d).alias("down")) for b, (u, d) in enumerate(zip(UP, DOWN, strict=True))])
    return spark.range(1).select(F.explode(both).alias("r")).select("r.band", F.round("r.up", 8).alias("up"), F.round("r.down", 8).alias("down"))


_DB = "(case least(24, cast(floor({x}) as integer)) " + " ".join(f"when {k} then {v}" for k, v in enumerate([15, 10, 7, 2] + [0] * 16 + [3, 5, 10, 20, 30])) + " end)"


@plan(
    "a11_quiet_threshold",
    f"with {BARK_SQL}, edge as (select *, coalesce(0.5 * (bark + lag(bark) over (order by band)), 0.5 * bark) as low, coalesce(0.5 * (bark + lead(bark) over (order by band)), bark) as high from bk) select band, round(pow(32768.0 * {N}, 2) * pow(10, -9.6) * pow(10, least({_DB.format(x='low')}, {_DB.format(x='high')}) / 10.0) * (hi - lo), 4) as quiet from edge",
)
def a11(spark, sf_dir):
    return spark.range(1).select(F.posexplode(P.doubles(QUIET)).alias("band", "q")).select("band", F.round("q", 4).alias("quiet"))


@plan("a12_pre_echo", f"with {THR} select stream, f, band, round(t, 4) as threshold from held")
def a12(spark, sf_dir):
    return by_band(thresholds(spark, sf_dir).select("stream", "f", F.transform("t", lambda v: F.round(v, 4)).alias("t")), "t", "threshold")


def thresholds(spark, sf_dir) -> DataFrame:
    """stream, f, e, t: band energies and thresholds after the quiet floor and pre-echo control."""
    e = energies(spark, sf_dir)
    raw = P.spread(P.self_mask(F.col("e")), UP, DOWN)
    now = e.withColumn("x", F.zip_with(raw, P.doubles(QUIET), lambda t, q: F.greatest(t, q)))
    both = with_previous(now.select("stream", "f", "x"), BANDS)
    held = F.transform(F.arrays_zip("x", "p"), lambda z: P.pre_echo(z["x"], F.when(z["p"] > 0, z["p"])))
    return both.select("stream", "f", held.alias("t")).join(e, ["stream", "f"])


@plan("a13_perceptual_entropy", f"with {THR} select stream, f, round(sum(w * 0.5 * log2(greatest(e / t, 1.0))), 6) as entropy from held join en using (stream, f, band) group by all")
def a13(spark, sf_dir):
    return thresholds(spark, sf_dir).select("stream", "f", F.round(P.entropy(F.col("e"), F.col("t"), SHORT_48), 6).alias("entropy"))


@plan(
    "a14_least_snr",
    f"with {BARK_SQL}, top as (select 1.0 / least(max_by(bark, band) / 24.0, 1.0) as scale from bk), edge as (select band, hi - lo as w, {_BARK.format(h=f'(hi * {RATE} * 0.5 / {N})')} - case when lo = 0 then 0 else {_BARK.format(h=f'(lo * {RATE} * 0.5 / {N})')} end as bw from bands) select band, round(least(0.8, greatest(0.003, 1.0 / greatest(1.0, pow(2, 1.18 * 64000 / {RATE}.0 * {N} * 0.024 * scale * bw / w) - 1.5))), 7) as snr from edge, top",
)
def a14(spark, sf_dir):
    return spark.range(1).select(F.posexplode(P.doubles(P.least_snr(SHORT_48, RATE, 64000))).alias("band", "s")).select("band", F.round("s", 7).alias("snr"))


_QSQL = "cast(sign(x) * least(floor(sqrt(abs(x) * sqrt(abs(x))) * pow(2.0, -0.1875 * ({sf} - 100)) + 0.4054), 8191) as integer)"


@plan("a15_quantise", f"with {FR} select stream, f, i, {_QSQL.format(sf='(100 + f % 40)')} as q from fr")
def a15(spark, sf_dir):
    q = F.transform("x", lambda v: Q.quantise(v, 100 + F.col("f") % 40))
    return long_form(spectrum(spark, sf_dir).select("stream", "f", q.alias("q")), "q", "i", "q")


def _peaks(spark, sf_dir) -> DataFrame:
    x = F.col("x")
    peak = F.array(*[F.array_max(F.transform(F.slice(x, a + 1, w), F.abs)) for a, w in zip(OFF, SHORT_48, strict=False)])
    return spectrum(spark, sf_dir).select("stream", "f", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(BANDS - 1)).alias("band"), peak.alias("peak"), P.band_sums(x, SHORT_48).alias("e"), P.band_sums(x, SHORT_48, lambda v: F.sqrt(F.abs(v))).alias("roots"))).alias("b")).select("stream", "f", "b.*")


@plan("a16_peak_scalefactor", f"with {EN} select stream, f, band, cast(case when peak > 0 then least(255, greatest(0, round(100 + log2(sqrt(peak * sqrt(peak)) / 1000.0) / 0.1875))) else 100 end as integer) as sf from en")
def a16(spark, sf_dir):
    return _peaks(spark, sf_dir).select("stream", "f", "band", Q.peak_scalefactor(F.col("peak"), 1000.0).alias("sf"))


@plan("a17_form_scalefactor", f"with {EN} select stream, f, band, case when roots > 0 then 100 + cast(floor(8.0 / 3 * log2(6.75 * (e * 0.001258925) / roots)) as integer) end as sf from en")
def a17(spark, sf_dir):
    return _peaks(spark, sf_dir).select("stream", "f", "band", Q.form_scalefactor(F.col("roots"), F.col("e") * 0.001258925).alias("sf"))


@plan("a18_least_scalefactor", f"with {EN} select stream, f, band, cast(case when peak > 0 then 100 + ceil(16.0 / 3 * (0.75 * log2(peak) - log2(8190.5))) else 0 end as integer) as sf from en")
def a18(spark, sf_dir):
    return _peaks(spark, sf_dir).select("stream", "f", "band", Q.least_scalefactor(F.col("peak")).alias("sf"))


_INV = "(pow(abs({q}), 4.0 / 3) * pow(2.0, ({sf} - 100) / 4.0))"


def _errors(sf) -> callable:
    """Squared error of quantising a line at a scalefactor."""
    return lambda v: F.pow(F.abs(v) - F.abs(Q.dequantise(Q.quantise(v, sf), sf)), F.lit(2.0))


@plan("a19_distortion", f"with {FR}, {BAND_SQL}, q as (select *, {_QSQL.format(sf='(100 + f % 40)')} as q from fr) select stream, f, band, round(sum(pow(abs(x) - {_INV.format(q='q', sf='(100 + f % 40)')}, 2)), 4) as error from q join bands on i >= lo and i < hi group by all")
def a19(spark, sf_dir):
    d = P.band_sums(F.col("x"), SHORT_48, _errors(100 + F.col("f") % 40))
    return by_band(spectrum(spark, sf_dir).select("stream", "f", F.transform(d, lambda v: F.round(v, 4)).alias("d")), "d", "error")


@plan(
    "a20_refine",
    f"with {FR}, {BAND_SQL}, c as (select *, unnest([-1, 0, 1]) as step from fr), g as (select stream, f, band, step, sum(pow(abs(x) - {_INV.format(q='q', sf='(120 + f % 20 + step)')}, 2)) as d from (select *, {_QSQL.format(sf='(120 + f % 20 + step)')} as q from c) t join bands on i >= lo and i < hi group by all), t as (select stream, f, band, sum(x * x) * 0.01 as thr from fr join bands on i >= lo and i < hi group by all) select stream, f, band, cast(120 + f % 20 + case when max(case when step = 0 then d end) > 1.25 * max(thr) then case when max(case when step = -1 then d end) < max(case when step = 0 then d end) then -1 else 0 end when max(case when step = 1 then d end) <= max(thr) then 1 else 0 end as integer) as sf from g join t using (stream, f, band) group by stream, f, band",
)
def a20(spark, sf_dir):
    """One step finer where the error passes 1.25 x the threshold and finer is better; one coarser where that still fits."""
    sf, x = 120 + F.col("f") % 20, F.col("x")
    d = {k: P.band_sums(x, SHORT_48, _errors(sf + k)) for k in (-1, 0, 1)}
    z = F.arrays_zip(d[-1].alias("fine"), d[0].alias("here"), d[1].alias("coarse"), P.band_sums(x, SHORT_48).alias("e"))

    def step(b):
        t = b["e"] * 0.01
        return F.when(b["here"] > t * 1.25, F.when(b["fine"] < b["here"], -1).otherwise(0)).when(b["coarse"] <= t, 1).otherwise(0)

    out = F.transform(z, lambda b: (sf + step(b)).cast("int"))
    return by_band(spectrum(spark, sf_dir).select("stream", "f", out.alias("s")), "s", "sf")


STEREO_SQL = f"{FR}, st as (select l.f, l.i, l.x as l, r.x as r from fr l join fr r using (f, i) where l.stream = 'click' and r.stream = 'view')"


def stereo(spark, sf_dir, size: int = N, scale: float = 1.0) -> DataFrame:
    """f, l, r: frames of the click and view streams side by side."""
    x = frames(pcm(spark, sf_dir), size, scale)
    return x.where(F.col("stream") == "click").select("f", F.col("x").alias("l")).join(x.where(F.col("stream") == "view").select("f", F.col("x").alias("r")), "f")


@plan("a23_mid_side_decision", f"with {STEREO_SQL}, {BAND_SQL} select f, band, sum(pow(0.5 * (l + r), 2) + pow(0.5 * (l - r), 2)) < 0.98 * sum(l * l + r * r) as mid_side from st join bands on i >= lo and i < hi group by all")
def a23(spark, sf_dir):
    l, r = P.band_sums(F.col("l"), SHORT_48), P.band_sums(F.col("r"), SHORT_48)
    s = stereo(spark, sf_dir)
    m = P.band_sums(F.zip_with("l", "r", lambda a, b: (a + b) * 0.5), SHORT_48)
    d = P.band_sums(F.zip_with("l", "r", lambda a, b: (a - b) * 0.5), SHORT_48)
    z = F.arrays_zip(l.alias("l"), r.alias("r"), m.alias("m"), d.alias("d"))
    return by_band(s.select("f", F.transform(z, lambda b: b["m"] + b["d"] < (b["l"] + b["r"]) * 0.98).alias("ms")), "ms", "mid_side")


@plan("a5_channel_mean", f"with {FR} select f, i, round(avg(x), 6) as mean from fr group by all")
def a5(spark, sf_dir):
    x = long_form(spectrum(spark, sf_dir), "x", "i", "v")
    return x.groupBy("f", "i").agg(F.round(F.avg("v"), 6).alias("mean"))


def _grouping_bits(lengths: list[int]) -> int:
    bits, at = 0, 0
    for n in lengths:
        for w in range(n):
            if w:
                bits |= 1 << (7 - at)
            at += 1
    return bits


@plan("a4_grouping_bits", "select event_id, case event_id % 9 " + " ".join(f"when {k} then {sum((1 << (7 - at)) for at in range(1, 8) if at not in [sum(g[:j]) for j in range(5)])}" for k, g in enumerate(GROUPING)) + " else 0 end as bits from events")
def a4(spark, sf_dir):
    """Bit 7 - w is set where window w goes on with its group; frames of other sequences have none."""
    from ..sources.signals import table

    bits = F.array(*[F.lit(_grouping_bits(g)) for g in GROUPING])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get(bits, (F.col("event_id") % 9).cast("int")), F.lit(0)).alias("bits"))


@plan("a25_payload_budget", "select event_id, greatest(0, event_id % 900 - (59 + case when ch >= 2 then 10 + info + mask else 0 end + ch * case when ch >= 2 then 8 else 15 + info end)) as bits from (select event_id, 1 + event_id % 2 as ch, case when event_id % 3 = 0 then 15 else 11 end as info, case when event_id % 5 = 0 then 14 else 0 end as mask from events) t")
def a25(spark, sf_dir):
    from ..sources.signals import table

    i = F.col("event_id")
    ch, info, mask = 1 + i % 2, F.when(i % 3 == 0, 15).otherwise(11), F.when(i % 5 == 0, 14).otherwise(0)
    head = 56 + 3 + F.when(ch >= 2, 3 + 4 + 1 + info + 2 + mask).otherwise(0) + ch * F.when(ch >= 2, 8).otherwise(3 + 4 + 8 + info)
    return table(spark, sf_dir, "events").select(i, F.greatest(F.lit(0).cast("bigint"), i % 900 - head).alias("bits"))


@plan("a28_nearest_entry", "with t as (select unnest(range(16)) as k), c as (select vec_id, k, abs(embedding[1] - sin((k - 7.5) * 0.2)) as d from embeddings, t) select vec_id, min_by(k, (d, k)) as entry from c group by all".replace("min_by(k, (d, k))", "arg_min(k, d)"))
def a28(spark, sf_dir):
    import math

    from ..sources.signals import spectra

    entries = P.doubles([math.sin((k - 7.5) * 0.2) for k in range(16)])
    x = F.get("x", F.lit(0))
    near = F.array_min(F.transform(entries, lambda t, k: F.struct(F.abs(t - x).alias("d"), k.cast("bigint").alias("k"))))
    return spectra(spark, sf_dir).select("vec_id", near["k"].alias("entry"))


@plan("h9_least_codebook", f"with {FR}, {BAND_SQL}, q as (select *, {_QSQL.format(sf='(130 + f % 60)')} as q from fr), m as (select stream, f, band, max(abs(q)) as top from q join bands on i >= lo and i < hi group by all) select stream, f, band, case when top = 0 then null when top <= 1 then 1 when top <= 2 then 3 when top <= 4 then 5 when top <= 7 then 7 when top <= 12 then 9 else 11 end as book from m")
def h9(spark, sf_dir):
    sf = 130 + F.col("f") % 60
    tops = F.array(*[Q.least_codebook(F.array_max(F.transform(F.slice("x", a + 1, w), lambda v: F.abs(Q.quantise(v, sf))))) for a, w in zip(OFF, SHORT_48, strict=False)])
    return by_band(spectrum(spark, sf_dir).select("stream", "f", tops.alias("b")), "b", "book")
