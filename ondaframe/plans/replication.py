"""Band replication and parametric stereo: closed forms and short folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.signals import SPEC_SQL, long_form, spectra, table
from .registry import plan

i = F.col


@plan("b12_resolution_remap", "select event_id, case when event_id % 3 = 0 then j when event_id % 3 = 1 then (j + odd) >> 1 when j = 0 then 0 else 2 * j - odd end as band from (select event_id, event_id % 20 as j, (event_id // 20) % 2 as odd from events) t".replace("(j + odd) >> 1", "(j + odd) // 2"))
def b12(spark, sf_dir):
    """Same, lower to higher, higher to lower resolution, by thirds."""
    e, j = i("event_id"), i("event_id") % 20
    odd = F.floor(e / 20) % 2
    return table(spark, sf_dir, "events").select(e, F.when(e % 3 == 0, j).when(e % 3 == 1, F.floor((j + odd) / 2)).when(j == 0, 0).otherwise(j * 2 - odd).cast("bigint").alias("band"))


@plan("b13_dequantise", "select event_id, round(pow(2.0, (event_id % 60) * case when event_id % 2 = 0 then 0.5 else 1 end + 6), 6) as envelope, round(pow(2.0, 6 - event_id % 30), 9) as noise from events")
def b13(spark, sf_dir):
    q = i("event_id")
    return table(spark, sf_dir, "events").select(q, F.round(F.pow(F.lit(2.0), q % 60 * F.when(q % 2 == 0, 0.5).otherwise(1.0) + 6), 6).alias("envelope"), F.round(F.pow(F.lit(2.0), 6 - q % 30), 9).alias("noise"))


@plan("b14_dequantise_coupled", "select event_id, round(pow(2.0, l + 7) / (1 + pow(2.0, 12 - b)), 7) as left_e, round(pow(2.0, l + 7) / (1 + pow(2.0, b - 12)), 7) as right_e from (select event_id, event_id % 20 as l, event_id % 25 as b from events) t")
def b14(spark, sf_dir):
    """A pair's total split by its balance; 12 is the middle."""
    total, tilt = F.pow(F.lit(2.0), i("event_id") % 20 + 7), 12 - i("event_id") % 25
    return table(spark, sf_dir, "events").select("event_id", F.round(total / (1 + F.pow(F.lit(2.0), tilt)), 7).alias("left_e"), F.round(total / (1 + F.pow(F.lit(2.0), -tilt)), 7).alias("right_e"))


@plan("b28_effective_resolution", "select event_id, case when event_id % 4 = 0 and event_id % 3 = 1 then 'fine' when event_id % 2 = 0 then 'fine' else 'coarse' end as resolution from events")
def b28(spark, sf_dir):
    """One fixed envelope forces the fine step."""
    e = i("event_id")
    header = F.when(e % 2 == 0, "fine").otherwise("coarse")
    return table(spark, sf_dir, "events").select(e, F.when((e % 4 == 0) & (e % 3 == 1), "fine").otherwise(header).alias("resolution"))


@plan("b5_resolution_split", "with m as (select vec_id, 5 + vec_id % 4 as n, unnest(range(5 + vec_id % 4 + 1)) as p from embeddings) select vec_id, p from m where case when n % 2 = 0 then p % 2 = 0 else p = 0 or p % 2 = 1 end")
def b5(spark, sf_dir):
    """Every second edge of a high-resolution table; with an odd number of bands the first stays whole."""
    n = (5 + i("vec_id") % 4).cast("int")
    edges = F.sequence(F.lit(0), n)
    return spectra(spark, sf_dir).select("vec_id", F.explode(F.filter(edges, lambda p: F.when(n % 2 == 0, p % 2 == 0).otherwise((p == 0) | (p % 2 == 1)))).alias("p"))


_L = "sum({}) filter (where k >= 2)"


@plan(
    "b16_predictor_fit",
    f"with {SPEC_SQL}, z as (select vec_id, k // 2 as k, sum(case when k % 2 = 0 then x end) as re, sum(case when k % 2 = 1 then x end) as im from sp group by all), g as (select *, lag(re, 1) over w as r1, lag(im, 1) over w as i1, lag(re, 2) over w as r2, lag(im, 2) over w as i2 from z window w as (partition by vec_id order by k)), p as (select vec_id, {_L.format('re * r1 + im * i1')} as a, {_L.format('im * r1 - re * i1')} as b, {_L.format('re * r2 + im * i2')} as c, {_L.format('im * r2 - re * i2')} as d, {_L.format('r1 * r1 + i1 * i1')} as e, {_L.format('r1 * r2 + i1 * i2')} as f, {_L.format('i1 * r2 - r1 * i2')} as g, {_L.format('r2 * r2 + i2 * i2')} as h from g group by 1), q as (select *, h * e - (f * f + g * g) / 1.000001 as det from p), r as (select *, (a * f - b * g - c * e) / det as a1r, (a * g + b * f - d * e) / det as a1i from q), s as (select *, -(a + a1r * f + a1i * g) / e as a0r, -(b + a1i * f - a1r * g) / e as a0i from r) select vec_id, round(case when ok then a0r else 0 end, 5) as a0_re, round(case when ok then a0i else 0 end, 5) as a0_im, round(case when ok then a1r else 0 end, 5) as a1_re, round(case when ok then a1i else 0 end, 5) as a1_im from (select *, a0r * a0r + a0i * a0i < 16 and a1r * a1r + a1i * a1i < 16 as ok from s) t",
)
def b16(spark, sf_dir):
    """Second-order covariance fit over 32 complex slots; an unstable one is dropped."""
    z = spectra(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("x", k * 2).alias("re"), F.get("x", k * 2 + 1).alias("im"))).alias("z"))

    def total(f):
        """Sum over the slots from 2 on of f(slot, one back, two back)."""
        at = lambda k: F.get("z", k)
        return F.aggregate(F.sequence(F.lit(2), F.lit(31)), F.lit(0.0), lambda s, k: s + f(at(k), at(k - 1), at(k - 2)))

    dot = lambda p, q: p["re"] * q["re"] + p["im"] * q["im"]
    cross = lambda p, q: p["im"] * q["re"] - p["re"] * q["im"]
    sums = {"a": lambda x, y, w: dot(x, y), "b": lambda x, y, w: cross(x, y), "c": lambda x, y, w: dot(x, w), "d": lambda x, y, w: cross(x, w), "e": lambda x, y, w: dot(y, y), "f": lambda x, y, w: dot(y, w), "g": lambda x, y, w: cross(y, w), "h": lambda x, y, w: dot(w, w)}
    p = z.select("vec_id", *[total(f).alias(n) for n, f in sums.items()])
    det = i("h") * i("e") - (i("f") * i("f") + i("g") * i("g")) / 1.000001
    p = p.withColumn("u", F.when(det != 0, (i("a") * i("f") - i("b") * i("g") - i("c") * i("e")) / det).otherwise(0.0)).withColumn("v", F.when(det != 0, (i("a") * i("g") + i("b") * i("f") - i("d") * i("e")) / det).otherwise(0.0))
    p = p.withColumn("s", F.when(i("e") != 0, -(i("a") + i("u") * i("f") + i("v") * i("g")) / i("e")).otherwise(0.0)).withColumn("t", F.when(i("e") != 0, -(i("b") + i("v") * i("f") - i("u") * i("g")) / i("e")).otherwise(0.0))
    ok = (i("s") * i("s") + i("t") * i("t") < 16) & (i("u") * i("u") + i("v") * i("v") < 16)
    return p.select("vec_id", *[F.round(F.when(ok, i(c)).otherwise(0.0), 5).alias(n) for c, n in (("s", "a0_re"), ("t", "a0_im"), ("u", "a1_re"), ("v", "a1_im"))])


@plan(
    "b17_chirp_update",
    f"with recursive {SPEC_SQL}, m as (select vec_id, k, case when x < -0.1 then 0.0 when x < 0 then 0.6 when x < 0.1 then 0.9 else 0.98 end as target from sp), r as (select vec_id, -1::bigint as k, 0.0::double as c from sp where k = 0 union all select r.vec_id, m.k, least(0.99609375, case when v < 0.015625 then 0 else v end) from (select r.vec_id, r.k, r.c, m.k as mk, case when target < r.c then 0.75 * target + 0.25 * r.c else 0.90625 * target + 0.09375 * r.c end as v from r join m on m.vec_id = r.vec_id and m.k = r.k + 1) r join m on m.vec_id = r.vec_id and m.k = r.mk) select vec_id, k, round(c, 10) as chirp from r where k >= 0",
)
def b17(spark, sf_dir):
    """Falls by 3/4, rises by 29/32 of the way; 0 under 1/64, at most 255/256."""
    target = F.transform("x", lambda x: F.when(x < -0.1, 0.0).when(x < 0, 0.6).when(x < 0.1, 0.9).otherwise(0.98))

    def step(acc, t):
        c = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
        v = F.when(t < c, t * 0.75 + c * 0.25).otherwise(t * 0.90625 + c * 0.09375)
        return F.concat(acc, F.array(F.least(F.lit(0.99609375), F.when(v < 0.015625, 0.0).otherwise(v))))

    run = F.aggregate(target, F.array().cast("array<double>"), step)
    return long_form(spectra(spark, sf_dir).select("vec_id", F.transform(run, lambda c: F.round(c, 10)).alias("c")), "c", "k", "chirp")


@plan("b21_gain_limiter", f"with {SPEC_SQL}, e as (select vec_id, k, k // 8 as band, x * x + 1e-6 as cur, pow(x - 0.05, 2) as ref from sp), l as (select *, least(sqrt(ref / cur), 1.41254 * sqrt(sum(ref) over b / sum(cur) over b)) as g from e window b as (partition by vec_id, band)) select vec_id, k, round(g * least(1.5848932, sqrt(sum(ref) over b / sum(g * g * cur) over b)), 6) as gain from l window b as (partition by vec_id, band)")
def b21(spark, sf_dir):
    """Gains capped at a limiter band's average times a ceiling, then lifted together by at most 2 dB of energy."""
    x = long_form(spectra(spark, sf_dir), "x", "k", "x").select("vec_id", "k", F.floor(i("k") / 8).alias("band"), (i("x") * i("x") + 1e-6).alias("cur"), F.pow(i("x") - 0.05, F.lit(2.0)).alias("ref"))
    sums = x.groupBy("vec_id", "band").agg(F.sum("ref").alias("ref_sum"), F.sum("cur").alias("cur_sum"))
    g = x.join(sums, ["vec_id", "band"]).withColumn("g", F.least(F.sqrt(i("ref") / i("cur")), F.sqrt(i("ref_sum") / i("cur_sum")) * 1.41254))
    lift = g.groupBy("vec_id", "band").agg(F.least(F.lit(1.5848932), F.sqrt(F.first("ref_sum") / F.sum(i("g") * i("g") * i("cur")))).alias("lift"))
    return g.join(lift, ["vec_id", "band"]).select("vec_id", "k", F.round(i("g") * i("lift"), 6).alias("gain"))


@plan("q4_borders", "select event_id, k, k * 32 // n as border from (select event_id, case event_id % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end as n, unnest(range(1, 5)) as k from events) t where k <= n")
def q4(spark, sf_dir):
    n = i("event_id") % 4 + 1
    return table(spark, sf_dir, "events").select("event_id", n.alias("n"), F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("k")).select("event_id", "k", F.floor(i("k") * 32 / i("n")).alias("border"))


@plan("q2_resolve_deltas", f"with recursive {SPEC_SQL}, d as (select vec_id, k, cast(round_even(x * 20, 0) as integer) as d from sp), r as (select vec_id, k, least(7, greatest(-7, d)) as v from d where k = 0 union all select r.vec_id, d.k, least(7, greatest(-7, r.v + d.d)) from r join d on d.vec_id = r.vec_id and d.k = r.k + 1) select vec_id, k, v from r")
def q2(spark, sf_dir):
    """Accumulated level differences, held to -7 to 7 at each step."""
    d = F.transform("x", lambda x: F.rint(x * 20).cast("int"))
    run = F.aggregate(d, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(F.least(F.lit(7), F.greatest(F.lit(-7), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v)))))
    return long_form(spectra(spark, sf_dir).select("vec_id", run.alias("v")), "v", "k", "v")


@plan("q13_matrix_ramp", f"with {SPEC_SQL}, g as (select vec_id, k, x, coalesce(lag(x) over (partition by vec_id order by k), 0) as p from sp where k < 8), s as (select unnest(range(1, 5)) as s) select vec_id, k, s, round(p + (x - p) / 4 * s, 8) as h from g, s")
def q13(spark, sf_dir):
    """From the matrix before to this one over four slots."""
    ramp = F.transform(F.slice("x", 1, 8), lambda x, k: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda s: F.struct(s.alias("s"), F.round(F.coalesce(F.get("x", F.when(k > 0, k - 1)), F.lit(0.0)) + (x - F.coalesce(F.get("x", F.when(k > 0, k - 1)), F.lit(0.0))) / 4 * s, 8).alias("h"))))
    return spectra(spark, sf_dir).select("vec_id", F.posexplode(ramp).alias("k", "r")).select("vec_id", "k", F.explode("r").alias("z")).select("vec_id", "k", "z.s", "z.h")


@plan("q6_transient_gain", f"with recursive {SPEC_SQL}, p as (select vec_id, k, x * x as p from sp), r as (select vec_id, -1::bigint as k, 0.0::double as peak, 0.0::double as d, 0.0::double as s, 1.0::double as g from p where k = 0 union all select q.vec_id, q.k, q.peak, q.d, q.s, case when q.d * 1.5 > q.s and q.d > 0 then q.s / (q.d * 1.5) else 1 end from (select r.vec_id, p.k, greatest(r.peak * 0.7659283, p.p) as peak, r.d + 0.25 * (greatest(r.peak * 0.7659283, p.p) - p.p - r.d) as d, r.s + 0.25 * (p.p - r.s) as s from r join p on p.vec_id = r.vec_id and p.k = r.k + 1) q) select vec_id, k, round(g, 7) as gain from r where k >= 0")
def q6(spark, sf_dir):
    """Decaying peak, smoothed power and smoothed gap between them; the gain drops where the gap outweighs the power."""

    def step(acc, x):
        p, last = x * x, F.try_element_at(acc, F.lit(-1))
        old = lambda n: F.coalesce(last[n], F.lit(0.0))
        peak = F.greatest(old("peak") * 0.7659283, p)
        d, s = old("d") + (peak - p - old("d")) * 0.25, old("s") + (p - old("s")) * 0.25
        g = F.when((d * 1.5 > s) & (d > 0), s / (d * 1.5)).otherwise(1.0)
        return F.concat(acc, F.array(F.struct(peak.alias("peak"), d.alias("d"), s.alias("s"), g.alias("g"))))

    run = F.aggregate("x", F.array().cast("array<struct<peak:double,d:double,s:double,g:double>>"), step)
    return long_form(spectra(spark, sf_dir).select("vec_id", F.transform(run, lambda r: F.round(r["g"], 7)).alias("g")), "g", "k", "gain")


@plan("h5_scalefactor_dpcm", f"with {SPEC_SQL} select vec_id, k, 100 + cast(sum(cast(round_even(x * 10, 0) as integer)) over (partition by vec_id order by k) as bigint) as sf from sp")
def h5(spark, sf_dir):
    d = F.transform("x", lambda x: F.rint(x * 10).cast("bigint"))
    run = F.aggregate(d, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(100).cast("bigint")) + v)))
    return long_form(spectra(spark, sf_dir).select("vec_id", run.alias("v")), "v", "k", "sf")


@plan("p16_global_gain", f"with {SPEC_SQL} select vec_id, coalesce(cast(arg_min(120 + k, k) filter (where x > 0.25) as bigint), 100) as gain from sp group by 1")
def p16(spark, sf_dir):
    """The first coded band's scalefactor, or 100."""
    first = F.array_min(F.transform("x", lambda x, k: F.when(x > 0.25, k)))
    return spectra(spark, sf_dir).select("vec_id", F.coalesce(120 + first, F.lit(100)).cast("bigint").alias("gain"))


@plan("h4_section_runs", f"with {SPEC_SQL}, b as (select vec_id, k, case when x < -0.1 then 0 when x < 0.1 then 1 else 5 end as book from sp), s as (select *, k - row_number() over (partition by vec_id, book order by k) as run from b) select vec_id, book, min(k) as lo, max(k) + 1 as hi from s group by vec_id, book, run")
def h4(spark, sf_dir):
    """Runs of equal codebooks."""
    book = F.transform("x", lambda x: F.when(x < -0.1, 0).when(x < 0.1, 1).otherwise(5))
    b = spectra(spark, sf_dir).select("vec_id", book.alias("b"))
    starts = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: (k == 0) | (F.get("b", k) != F.get("b", F.greatest(k - 1, F.lit(0)))))
    runs = F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.lit(64))), lambda a, z: F.struct(a.alias("lo"), z.alias("hi")))
    return b.select("vec_id", "b", F.explode(runs).alias("r")).select("vec_id", F.get("b", i("r.lo")).alias("book"), i("r.lo").cast("bigint").alias("lo"), i("r.hi").cast("bigint").alias("hi"))
