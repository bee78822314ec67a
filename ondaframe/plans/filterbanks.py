"""Complex filterbanks, line spectra, bands of the replicated range, stereo matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import bands as R
from ..operators import lpc as L
from ..operators import qmf as Q
from ..operators import streams as S
from ..operators.streams import by_row
from ..sources.signals import FULL_SCALE, PCM_SQL, SPEC_SQL, pcm, spectra, table, with_previous
from .registry import plan

M = 32
TAPS = Q.SLOTS * M


def _framed(spark, sf_dir):
    """stream, f, p, x: frames of 1,024 samples over full scale, each with the frame before."""
    x = S.framed(pcm(spark, sf_dir)).select("stream", "f", F.transform("x", lambda v: v / FULL_SCALE).alias("x"))
    return with_previous(x, S.N)


_PROTO = "proto(t, p) as (values " + ", ".join(f"({k}, {v!r}::double)" for k, v in enumerate(Q.designed(M))) + ")"
_SLOTS = f"{PCM_SQL}, last as (select stream, (max(n) // 1024 + 2) * 32 as slots from pcm group by 1), {_PROTO}, sl as (select stream, unnest(range(slots)) as slot from last), w as (select sl.stream, slot, t, s / 32768.0 * p as v from sl, proto join pcm on pcm.stream = sl.stream and pcm.n = slot * 32 + 31 - t), bk as (select unnest(range(32)) as band)"


def _slots(spark, sf_dir):
    def f(r):
        z = Q.analyse(np.concatenate([r["p"][-(TAPS - M) :], r["x"]]), M)
        return [{"stream": r["stream"], "f": r["f"], "re": z.real.reshape(-1).tolist(), "im": z.imag.reshape(-1).tolist()}]

    return by_row(_framed(spark, sf_dir), f, "stream string, f bigint, re array<double>, im array<double>")


@plan("t16_qmf_frame", f"with {_SLOTS} select sl.stream, sl.slot, band, round(coalesce(sum(v * cos(pi() / 32 * (band + 0.5) * (t - 159.5))), 0), 6) + 0.0 as re, round(coalesce(sum(v * sin(pi() / 32 * (band + 0.5) * (t - 159.5))), 0), 6) + 0.0 as im from sl cross join bk left join w on w.stream = sl.stream and w.slot = sl.slot group by all")
def t16(spark, sf_dir):
    """32 slots of 32 bands a frame; a frame sees 288 samples of the one before."""
    z = _slots(spark, sf_dir).select("stream", "f", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    return z.select("stream", (F.col("f") * 32 + F.floor(F.col("i") / 32)).alias("slot"), (F.col("i") % 32).alias("band"), (F.round("z.re", 6) + 0.0).alias("re"), (F.round("z.im", 6) + 0.0).alias("im"))


@plan("t14_qmf_energy", f"with {_SLOTS}, z as (select stream, slot, band, sum(v * cos(pi() / 32 * (band + 0.5) * (t - 159.5))) as re, sum(v * sin(pi() / 32 * (band + 0.5) * (t - 159.5))) as im from w, bk group by all) select stream, band, round(sum(re * re + im * im), 5) as power from z group by all")
def t14(spark, sf_dir):
    """Power by band."""
    z = _slots(spark, sf_dir).select("stream", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    return z.groupBy("stream", (F.col("i") % 32).alias("band")).agg(F.round(F.sum(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")), 5).alias("power"))


@plan("t15_qmf_synthesis", f"with {PCM_SQL} select stream, true as like_input from pcm group by 1")
def t15(spark, sf_dir):
    """Back from the slots: within 45 dB of the input, 288 samples late.

    A frame's slots give its samples and what reaches into the next frame.
    """

    def f(r):
        z = (np.array(r["re"]) + 1j * np.array(r["im"])).reshape(-1, M)
        y = Q.synthesise(z)
        return [{"stream": r["stream"], "f": r["f"], "head": y[: S.N].tolist(), "x": np.append(y[S.N :], np.zeros(2 * S.N - len(y))).tolist()}]

    back = by_row(_slots(spark, sf_dir), f, "stream string, f bigint, head array<double>, x array<double>")
    met = with_previous(back.select("stream", "f", "x"), S.N).select("stream", "f", "p").join(back.select("stream", "f", "head"), ["stream", "f"])
    y = met.select("stream", "f", F.posexplode(F.zip_with("head", "p", lambda a, b: a + b)).alias("i", "y")).select("stream", (F.col("f") * S.N + F.col("i") - (TAPS - M)).alias("n"), "y")
    x = pcm(spark, sf_dir).select("stream", "n", (F.col("s") / FULL_SCALE).alias("x"))
    d = F.col("x") - F.col("y")
    return x.join(y, ["stream", "n"]).groupBy("stream").agg((F.sum(d * d) * 10**4.5 <= F.sum(F.col("x") * F.col("x"))).alias("like_input"))


_Z = f"{SPEC_SQL}, z as (select a.vec_id, a.k // 2 as slot, a.x as re, b.x as im from sp a join sp b on a.vec_id = b.vec_id and b.k = a.k + 1 where a.k % 2 = 0)"


def _complex(spark, sf_dir, f, schema: str):
    def run(r):
        x = np.array(r["x"])
        return [{"vec_id": r["vec_id"], **o} for o in f(x[::2] + 1j * x[1::2])]

    return by_row(spectra(spark, sf_dir), run, f"vec_id bigint, {schema}")


_G = "g(t, g) as (values " + ", ".join(f"({t}, {v}::double)" for t, v in enumerate([*Q.EIGHT, *Q.EIGHT[-2::-1]])) + ")"


@plan("t17_hybrid_analysis", f"with {_Z}, {_G}, q as (select unnest(range(8)) as part) select a.vec_id, a.slot, part, round(sum(g * (z.re * cos(pi() / 4 * (part + 0.5) * (t - 6)) - z.im * sin(pi() / 4 * (part + 0.5) * (t - 6)))), 7) + 0.0 as re, round(sum(g * (z.re * sin(pi() / 4 * (part + 0.5) * (t - 6)) + z.im * cos(pi() / 4 * (part + 0.5) * (t - 6)))), 7) + 0.0 as im from z a, q, g join z on z.vec_id = a.vec_id and z.slot = a.slot - t group by all")
def t17(spark, sf_dir):
    """A band's 32 slots split in eight."""
    got = _complex(spark, sf_dir, lambda z: [{"slot": s, "part": q, "re": float(v.real), "im": float(v.imag)} for s, row in enumerate(Q.split(z, 8)) for q, v in enumerate(row)], "slot int, part int, re double, im double")
    return got.select("vec_id", "slot", "part", *[(F.round(c, 7) + 0.0).alias(c) for c in ("re", "im")])


@plan("t18_hybrid_synthesis", f"with {_Z}, n as (select unnest([2, 8]) as parts) select z.vec_id, z.slot, parts, round(coalesce(d.re, 0), 7) + 0.0 as re, round(coalesce(d.im, 0), 7) + 0.0 as im from z cross join n left join z d on d.vec_id = z.vec_id and d.slot = z.slot - 6")
def t18(spark, sf_dir):
    """Sub-bands added up: the band, six slots late."""
    got = _complex(spark, sf_dir, lambda z: [{"slot": s, "parts": n, "re": float(v.real), "im": float(v.imag)} for n in (2, 8) for s, v in enumerate(Q.split(z, n).sum(axis=1))], "slot int, parts int, re double, im double")
    return got.select("vec_id", "slot", "parts", *[(F.round(c, 7) + 0.0).alias(c) for c in ("re", "im")])


# --- prediction and line spectra ----------------------------------------------------------------


def _vectors(spark, sf_dir, f, schema: str):
    return by_row(spectra(spark, sf_dir), lambda r: [{"vec_id": r["vec_id"], **o} for o in f(np.array(r["x"]))], f"vec_id bigint, {schema}")


_AUTO = f"{SPEC_SQL}, r as (select vec_id, sum(x * x) as r0, sum(x * p1) as r1, sum(x * p2) as r2 from (select *, lag(x, 1, 0) over w as p1, lag(x, 2, 0) over w as p2 from {{}} window w as (partition by vec_id order by k)) group by 1)"


@plan("t20_levinson", f"with {_AUTO.format('sp')}, a as (select *, -r1 / r0 as k1 from r), b as (select *, r0 * (1 - k1 * k1) as e1 from a), c as (select *, -(r2 + k1 * r1) / e1 as k2 from b) select vec_id, round(k1, 7) as first, round(k2, 7) as second, round(k1 + k2 * k1, 7) as a1, round(greatest(e1 * (1 - k2 * k2), 1e-12), 7) as error from c")
def t20(spark, sf_dir):
    """Order 2 here, so that it can be written out; a batch of vectors at a time."""

    def f(x):
        r = np.array([[x @ x, x[1:] @ x[:-1], x[2:] @ x[:-2]]])
        a, k, e = L.levinson(r, 2)
        return [{"first": float(k[0, 0]), "second": float(k[0, 1]), "a1": float(a[0, 1]), "error": float(e[0])}]

    got = _vectors(spark, sf_dir, f, "first double, second double, a1 double, error double")
    return got.select("vec_id", *[F.round(c, 7).alias(c) for c in ("first", "second", "a1", "error")])


@plan("u29_lpc_analysis", f"with {_AUTO.format('(select vec_id, k, x * (0.54 - 0.46 * cos(2 * pi() * k / 63)) as x from sp) h')}, s as (select vec_id, r0 * 1.000001 + 1e-9 as r0, r1, r2 from r), a as (select *, -r1 / r0 as k1 from s), b as (select *, r0 * (1 - k1 * k1) as e1 from a), c as (select *, -(r2 + k1 * r1) / e1 as k2 from b) select vec_id, round(k1 + k2 * k1, 7) as a1, round(k2, 7) as a2 from c")
def u29(spark, sf_dir):
    def f(x):
        a = L.analyse(x[None], 2)[0]
        return [{"a1": float(a[1]), "a2": float(a[2])}]

    return _vectors(spark, sf_dir, f, "a1 double, a2 double").select("vec_id", F.round("a1", 7).alias("a1"), F.round("a2", 7).alias("a2"))


@plan("u30_line_spectra", f"with {SPEC_SQL} select distinct vec_id, 16 as lines, true as rising, true as back from sp")
def u30(spark, sf_dir):
    """Line spectra of order 16: as many, rising between 0 and half the rate, and the coefficients come back from them."""

    def f(x):
        a = L.analyse(x[None], 16)[0]
        lines = L.to_lines(a)
        return [{"lines": len(lines), "rising": bool((np.diff(np.concatenate([[0.0], lines, [L.HALF_RATE]])) > 0).all()), "back": bool(np.allclose(L.from_lines(lines), a, atol=1e-6))}]

    return _vectors(spark, sf_dir, f, "lines int, rising boolean, back boolean")


_LINES = "e as (select event_id, unnest(range(1, 5)) as i from events), l as (select event_id, i, cast(event_id * 131 * i % 6400 as double) as f from e)"


def _four(e: int) -> np.ndarray:
    return np.array([e * 131 * i % 6400 for i in range(1, 5)], dtype=float)


@plan("u31_line_spacing", f"with {_LINES}, u as (select event_id, i, greatest(max(f - 50 * i) over (partition by event_id order by i), 0) + 50 * i as f from l), d as (select event_id, i, least(min(f - (6400 - 50 * (5 - i))) over (partition by event_id order by i desc), 0) + 6400 - 50 * (5 - i) as f from u) select event_id, i, f from d")
def u31(spark, sf_dir):
    rows = lambda r: [{"event_id": r["event_id"], "i": i + 1, "f": float(v)} for i, v in enumerate(L.spaced(_four(r["event_id"])))]
    return by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, i int, f double")


@plan("u15_line_blend", f"with {_LINES}, q as (select unnest(range(4)) as quarter) select l.event_id, quarter, l.i, round((1 - (quarter * 2 + 1) / 8.0) * f + (quarter * 2 + 1) / 8.0 * (event_id * 17 % 6400), 6) as f from l, q")
def u15(spark, sf_dir):
    def rows(r):
        e = r["event_id"]
        got = L.blended(_four(e), np.full(4, e * 17 % 6400))
        return [{"event_id": e, "quarter": k, "i": i + 1, "f": float(got[k, i])} for k in range(4) for i in range(4)]

    got = by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, quarter int, i int, f double")
    return got.select("event_id", "quarter", "i", F.round("f", 6).alias("f"))


@plan("u39_lines_to_filter", "with e as (select event_id, 1000 + event_id % 500 as f1, 3000 + event_id % 700 as f2 from events), c as (select event_id, -2 * cos(f1 / 6400.0 * pi()) as a, -2 * cos(f2 / 6400.0 * pi()) as b from e) select event_id, round(((a + 1) + (b - 1)) / 2, 8) as a1, round(((1 + a) + (1 - b)) / 2, 8) as a2 from c")
def u39(spark, sf_dir):
    """Two lines, so that the polynomials can be written out."""

    def rows(r):
        e = r["event_id"]
        a = L.from_lines(np.array([1000 + e % 500, 3000 + e % 700], dtype=float))
        return [{"event_id": e, "a1": float(a[1]), "a2": float(a[2])}]

    return by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, a1 double, a2 double").select("event_id", F.round("a1", 8).alias("a1"), F.round("a2", 8).alias("a2"))


# --- bands of the replicated range --------------------------------------------------------------

_RATES = [16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000]
_BY_RATE = " ".join(f"when {k} then {r}" for k, r in enumerate(_RATES))
_START = "st(rate, i, off) as (values " + ", ".join(f"({r}, {i}, {v})" for r in _RATES for i, v in enumerate(R.START[r])) + ")"
_ENDS = f"e as (select event_id, case event_id % 9 {_BY_RATE} end as rate, event_id // 9 % 16 as start, event_id // 144 % 16 as stop from events), {_START}, k as (select e.*, cast(floor(case when e.rate < 32000 then 3000 when e.rate < 64000 then 4000 else 5000 end * 128.0 / e.rate + 0.5) as integer) + off as k0, cast(floor(case when e.rate < 32000 then 6000 when e.rate < 64000 then 8000 else 10000 end * 128.0 / e.rate + 0.5) as integer) as low from e join st on st.rate = e.rate and st.i = e.start), w as (select *, list_sort(list_transform(range(1, 14), lambda j: floor(low * pow(64.0 / low, j / 13.0) + 0.5) - floor(low * pow(64.0 / low, (j - 1) / 13.0) + 0.5))) as w from k), z as (select event_id, greatest(0, least(64, k0)) as k0, greatest(0, least(64, cast(case when stop = 15 then 3 * k0 when stop = 14 then 2 * k0 when stop = 0 then low else low + list_sum(w[1:stop]) end as integer))) as k2 from w)"


def _range(e: int) -> tuple[int, int] | None:
    try:
        return R.ends(e // 9 % 16, e // 144 % 16, _RATES[e % 9])
    except ValueError:
        return None


@plan("b3_range_ends", f"with {_ENDS} select event_id, case when k2 > k0 and k2 - k0 <= 49 then k0 end as k0, case when k2 > k0 and k2 - k0 <= 49 then k2 end as k2 from z")
def b3(spark, sf_dir):
    """Null where there is no valid range."""

    def rows(r):
        got = _range(r["event_id"])
        return [{"event_id": r["event_id"], "k0": got and got[0], "k2": got and got[1]}]

    return by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, k0 int, k2 int")


@plan("b4_master_bands", f"with {_ENDS}, v as (select event_id, k0, k2 from z where k2 > k0 and k2 - k0 <= 49 and k2 - k0 >= 2) select event_id, k0, k2, (k2 - k0) // 2 * 2 as bands, case when (k2 - k0) % 2 = 1 then 2 else 1 end as widest from v")
def b4(spark, sf_dir):
    """The linear bands (the geometric ones are held against their definition in the tests)."""

    def rows(r):
        got = _range(r["event_id"])
        if not got or got[1] - got[0] < 2:
            return []
        m = R.master(*got, 0, False)
        return [{"event_id": r["event_id"], "k0": int(m[0]), "k2": int(m[-1]), "bands": len(m) - 1, "widest": int(np.diff(m).max())}]

    return by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, k0 int, k2 int, bands int, widest int")


@plan("b6_noise_bands", "with e as (select event_id, 4 + event_id % 20 as n, event_id % 4 as index from events), c as (select *, case when index = 0 then 1 else greatest(1, cast(floor(index * log2((10 + 2 * n) / 10.0) + 0.5) as integer)) end as count from e) select event_id, count, n // count as first from c where count <= 5")
def b6(spark, sf_dir):
    """Over 4 to 23 coarse bands of two lines each: how many noise bands, and how many coarse ones the first takes."""

    def rows(r):
        e = r["event_id"]
        try:
            got = R.noise_bands(10 + 2 * np.arange(5 + e % 20), e % 4)
        except ValueError:
            return []
        return [{"event_id": e, "count": len(got) - 1, "first": int(got[1] - got[0]) // 2}]

    return by_row(table(spark, sf_dir, "events").select("event_id"), rows, "event_id bigint, count int, first int")


# --- stereo matrices ----------------------------------------------------------------------------


@plan("q7_transient_power", f"with {_Z} select vec_id, case when slot < 8 then slot // 2 else 4 + (slot - 8) // 8 end as bin, round(sum(re * re + im * im), 7) as power from z group by all")
def q7(spark, sf_dir):
    """Power of complex bands by parameter bin: two bands a bin below the eighth, eight above."""
    z = spectra(spark, sf_dir).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.pow(F.get("x", k * 2), F.lit(2.0)) + F.pow(F.get("x", k * 2 + 1), F.lit(2.0)))).alias("slot", "p"))
    to = F.when(F.col("slot") < 8, F.floor(F.col("slot") / 2)).otherwise(F.floor((F.col("slot") - 8) / 8) + 4)
    return z.groupBy("vec_id", to.alias("bin")).agg(F.round(F.sum("p"), 7).alias("power"))


_MATRIX = "m as (select event_id, pow(10, (event_id % 31 - 15) / 20.0) as c, (event_id % 21) / 20.0 as rho from events), h as (select event_id, sqrt(2) / sqrt(1 + c * c) as c1, sqrt(2) * c / sqrt(1 + c * c) as c2, 0.5 * acos(rho) as alpha from m), t as (select *, alpha * (c1 - c2) / sqrt(2) as beta from h), x as (select event_id, c2 * cos(beta + alpha) as h11, c1 * cos(beta - alpha) as h12, c2 * sin(beta + alpha) as h21, c1 * sin(beta - alpha) as h22 from t)"


def _matrix():
    e = F.col("event_id")
    c, rho = F.pow(F.lit(10.0), (e % 31 - 15) / 20), (e % 21) / 20
    norm = F.sqrt(F.lit(2.0)) / F.sqrt(c * c + 1)
    c1, c2, alpha = norm, norm * c, F.acos(rho) * 0.5
    beta = alpha * (c1 - c2) / F.sqrt(F.lit(2.0))
    return {"h11": c2 * F.cos(beta + alpha), "h12": c1 * F.cos(beta - alpha), "h21": c2 * F.sin(beta + alpha), "h22": c1 * F.sin(beta - alpha)}


@plan("q9_level_matrix", f"with {_MATRIX} select event_id, round(h11, 7) + 0.0 as h11, round(h12, 7) + 0.0 as h12, round(h21, 7) + 0.0 as h21, round(h22, 7) + 0.0 as h22 from x")
def q9(spark, sf_dir):
    """Mixing matrix of a level difference in dB and a coherence."""
    return table(spark, sf_dir, "events").select("event_id", *[(F.round(v, 7) + 0.0).alias(k) for k, v in _matrix().items()])


@plan("q8_remix", f"with {_MATRIX}, s as (select unnest(range(4)) as slot) select event_id, slot, round((h11 * (slot + 1) / 4 + 1 - (slot + 1) / 4.0) * 0.5 + h21 * (slot + 1) / 4 * 0.25, 7) + 0.0 as left_x, round(h12 * (slot + 1) / 4 * 0.5 + (h22 * (slot + 1) / 4 + 1 - (slot + 1) / 4.0) * 0.25, 7) + 0.0 as right_x from x, s")
def q8(spark, sf_dir):
    """Over four slots the matrix goes in equal steps from the identity to q9's; mid 0.5 and side 0.25 are mixed."""
    h = _matrix()
    got = table(spark, sf_dir, "events").select("event_id", *[v.alias(k) for k, v in h.items()])
    slots = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot")
    w = (F.col("slot") + 1) / 4
    left = (F.col("h11") * w + 1 - w) * 0.5 + F.col("h21") * w * 0.25
    right = F.col("h12") * w * 0.5 + (F.col("h22") * w + 1 - w) * 0.25
    return got.select("*", slots).select("event_id", "slot", (F.round(left, 7) + 0.0).alias("left_x"), (F.round(right, 7) + 0.0).alias("right_x"))
