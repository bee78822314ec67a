"""Shaping of lines, vector kernels, the synthesis chain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import coder as C
from ..operators import lpc as L
from ..operators import shaping as H
from ..operators import streams as S
from ..operators.streams import by_row
from ..operators.transforms import sine_window
from ..sources.signals import PCM_SQL, SPEC_SQL, pcm, spectra, table, with_previous
from .filterbanks import _Z, _complex, _vectors
from .registry import plan

WIDTHS = [4, 4, 8, 16, 32]
_EDGES = "(values (0, 0, 4), (1, 4, 8), (2, 8, 16), (3, 16, 32), (4, 32, 64)) as b(band, lo, hi)"


@plan("u11_whitened_lines", f"with {SPEC_SQL}, e as (select vec_id, band, 1 / sqrt(sum(x * x) + 1e-30) as w from sp join {_EDGES} on k >= lo and k < hi group by all), w as (select sp.vec_id, k, x, e.w from sp join {_EDGES} on k >= lo and k < hi join e on e.vec_id = sp.vec_id and e.band = least(b.band, 3)), back as (select a.vec_id, a.k, any_value(a.x) as x, sum(o.w * case when o.k = 63 then pow(2.0, a.k - 63) else pow(2.0, a.k - o.k - 1) end) as w from w a join w o on o.vec_id = a.vec_id and o.k >= a.k group by all), fore as (select a.vec_id, a.k, any_value(a.x) as x, sum(o.w * case when o.k = 0 then pow(2.0, -a.k) else pow(2.0, o.k - a.k - 1) end) as w from back a join back o on o.vec_id = a.vec_id and o.k <= a.k group by all) select vec_id, k, round(x * w, 6) + 0.0 as y from fore")
def u11(spark, sf_dir):
    """Lines evened out by their bands' smoothed weights, in closed form on the other side."""
    got = _vectors(spark, sf_dir, lambda x: [{"k": k, "y": float(v)} for k, v in enumerate(H.whitened(x[None], WIDTHS)[0])], "k int, y double")
    return got.select("vec_id", "k", (F.round("y", 6) + 0.0).alias("y"))


@plan("u36_noise_shaping", f"with recursive {SPEC_SQL}, g as (select vec_id, k // 16 as blk, 0.5 + abs(x) as g1, 0.75 + abs(x) / 2 as g2 from sp where k % 16 = 0), c as (select sp.vec_id, sp.k, x, 2 * g1 * g2 / (g1 + g2) as a, (g2 - g1) / (g1 + g2) as b from sp join g on g.vec_id = sp.vec_id and g.blk = sp.k // 16), r as (select vec_id, -1 as k, 0.0::double as y from (select distinct vec_id from sp) union all select c.vec_id, c.k::integer, a * x + b * y from r join c on c.vec_id = r.vec_id and c.k = r.k + 1) select vec_id, case when k % 2 = 0 then k // 2 else 63 - k // 2 end as k, round(y, 7) + 0.0 as y from r where k >= 0")
def u36(spark, sf_dir):
    """Four blocks of 16 lines; gains from each block's first line."""

    def f(x):
        first = np.abs(x[::16])[None]
        return [{"k": k, "y": float(v)} for k, v in enumerate(H.noise_shaped(x[None], 0.5 + first, 0.75 + first / 2)[0])]

    return _vectors(spark, sf_dir, f, "k int, y double").select("vec_id", "k", (F.round("y", 7) + 0.0).alias("y"))


@plan("q14_all_pass", f"with {_Z}, p as (select a.vec_id, a.slot, any_value(a.re) as xr, any_value(a.im) as xi, sum(case when o.slot is null then 0 else 0.75 * pow(0.5, a.slot - 1 - o.slot) * (o.re * cos(0.3 * (a.slot - o.slot)) - o.im * sin(0.3 * (a.slot - o.slot))) end) as zr, sum(case when o.slot is null then 0 else 0.75 * pow(0.5, a.slot - 1 - o.slot) * (o.re * sin(0.3 * (a.slot - o.slot)) + o.im * cos(0.3 * (a.slot - o.slot))) end) as zi from z a left join z o on o.vec_id = a.vec_id and o.slot < a.slot group by all) select vec_id, slot, round(zr - 0.5 * xr, 7) + 0.0 as re, round(zi - 0.5 * xi, 7) + 0.0 as im from p")
def q14(spark, sf_dir):
    """One section with a decay of 0.5 and a turn of 0.3, against the sum of its echoes."""

    def f(z):
        y = H.all_pass(z[None], np.exp(0.3j), 0.5)[0]
        return [{"slot": s, "re": float(v.real), "im": float(v.imag)} for s, v in enumerate(y)]

    return _complex(spark, sf_dir, f, "slot int, re double, im double").select("vec_id", "slot", *[(F.round(c, 7) + 0.0).alias(c) for c in ("re", "im")])


@plan("u33_arrangement", "with p as (select row_number() over (order by i, j) - 1 as rank, i, j from (select unnest(range(8)) as i), (select unnest(range(8)) as j) where i < j) select event_id, rank, 2 * (128 >> i) + 2 * (128 >> j) as ones from events join p on rank = event_id % 28".replace("2 * (128 >> i) + 2 * (128 >> j)", "(128 >> i) + (128 >> j)"))
def u33(spark, sf_dir):
    """Orders of two ones and six zeros, as bits."""

    def rows(r):
        e = r["event_id"]
        return [{"event_id": e, "rank": e % 28, "ones": int("".join(map(str, H.arrangement(e % 28, [1, 1, 0, 0, 0, 0, 0, 0]))), 2)}]

    return by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, rank bigint, ones bigint")


@plan("u27_lines_of_code", "with l as (select event_id, unnest(range(1, 17)) as i from events), c as (select event_id, i, cast(i * (event_id % 256 * 2 - 60) as double) as f from l), u as (select event_id, i, greatest(max(f - 50 * i) over (partition by event_id order by i), 0) + 50 * i as f from c), d as (select event_id, i, least(min(f - (6400 - 50 * (17 - i))) over (partition by event_id order by i desc), 0) + 6400 - 50 * (17 - i) as f from u) select event_id, i, f from d")
def u27(spark, sf_dir):
    """Line spectra of a code, here evenly spaced ones, some of them too close or beyond the end: brought into order."""

    def rows(r):
        e = r["event_id"]
        got = L.spaced(np.arange(1, 17) * (e % 256 * 2.0 - 60))
        return [{"event_id": e, "i": k + 1, "f": float(v)} for k, v in enumerate(got)]

    return by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, i int, f double")


@plan("t23_vector_kernels", f"with {_Z}, t as (select *, cos(slot * 0.1) as c, sin(slot * 0.1) as s from z) select vec_id, round(sum(re * c - im * s), 7) as re, round(sum(re * s + im * c), 7) as im, round(sum(re * im), 7) as product from t group by 1")
def t23(spark, sf_dir):
    """Complex products with a turning factor, summed, and a multiply-accumulate."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("x", k * 2).alias("re"), F.get("x", k * 2 + 1).alias("im"), F.cos(k * 0.1).alias("c"), F.sin(k * 0.1).alias("s")))
    total = lambda f: F.round(F.aggregate("z", F.lit(0.0), lambda a, z: a + f(z)), 7)
    z = spectra(spark, sf_dir).select("vec_id", slots.alias("z"))
    return z.select("vec_id", total(lambda z: z["re"] * z["c"] - z["im"] * z["s"]).alias("re"), total(lambda z: z["re"] * z["s"] + z["im"] * z["c"]).alias("im"), total(lambda z: z["re"] * z["im"]).alias("product"))


@plan("d14_synthesis", f"with {PCM_SQL} select stream, n, s from pcm")
def d14(spark, sf_dir):
    """Spectra of whole frames through the decoder's chain (no filter, inverse transform, overlap): the samples again."""
    window = sine_window(2 * S.N)

    def f(r):
        spec = C.transform(np.concatenate([r["p"], r["x"]]) * window)[None]
        C.unshape(spec, {"window": {"sequence": 0, "max_band": 49}, "filters": None}, 48000)
        head, _, tail = C.halves(spec, 0, 0)
        return [{"stream": r["stream"], "f": r["f"], "head": head.tolist(), "x": tail.tolist()}]

    met = with_previous(S.framed(pcm(spark, sf_dir)), S.N)
    back = by_row(met, f, "stream string, f bigint, head array<double>, x array<double>")
    tails = with_previous(back.select("stream", "f", "x"), S.N).select("stream", "f", "p")
    y = tails.join(back.select("stream", "f", "head"), ["stream", "f"]).select("stream", "f", S.to_pcm(F.zip_with("head", "p", lambda a, b: a + b)).alias("s"))
    flat = y.select("stream", F.posexplode("s").alias("i", "s"), "f").select("stream", ((F.col("f") - 1) * S.N + F.col("i")).alias("n"), "s")
    return flat.join(pcm(spark, sf_dir).select("stream", "n"), ["stream", "n"])
