"""Transforms, windows and filterbanks over framed streams and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transforms as T
from ..sources.signals import FULL_SCALE, SPEC_SQL, frames, frames_sql, long_form, pcm, spectra, with_previous
from .registry import plan

N = 64
FR = frames_sql(N, FULL_SCALE)
_COS = f"cos(pi() / {N} * (i + 0.5 + {N // 2}) * (k + 0.5))"
_SINE = f"sin(pi() * (i + 0.5) / {2 * N})"
BLOCKS = f"{FR}, bl as (select stream, f, i + {N} as i, x from fr union all select a.stream, a.f, a.i, coalesce(b.x, 0) as x from fr a left join fr b on a.stream = b.stream and a.i = b.i and a.f = b.f + 1)"
KS = f"ks as (select unnest(range({N})) as k)"


def blocks(spark, sf_dir):
    """stream, f, b: each frame behind the frame before it."""
    x = frames(pcm(spark, sf_dir), N, FULL_SCALE)
    return with_previous(x, N).select("stream", "f", F.concat("p", "x").alias("b"))


def _round(column: str, to: str, at: str = "k", digits: int = 6):
    return lambda df: long_form(df.withColumn(column, F.transform(column, lambda v: F.round(v, digits) + 0.0)), column, at, to)


@plan("t1_fft", f"with {SPEC_SQL}, ks as (select unnest(range(64)) as j) select vec_id, j as k, round(sum(x * cos(2 * pi() * j * k / 64)), 6) as re, round(sum(-x * sin(2 * pi() * j * k / 64)), 6) as im from sp, ks group by all")
def t1(spark, sf_dir):
    y = spectra(spark, sf_dir).select("vec_id", T.fft(F.col("x"), F.transform("x", lambda v: v * 0.0)).alias("y"))
    return y.select("vec_id", F.posexplode(F.arrays_zip("y.re", "y.im")).alias("k", "z")).select("vec_id", "k", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


@plan("t2_inverse_fft", f"with {SPEC_SQL}, c as (select a.vec_id, a.k, a.x as re, b.x as im from sp a join sp b on a.vec_id = b.vec_id and b.k = 63 - a.k), ks as (select unnest(range(64)) as j) select vec_id, j as k, round(sum(re * cos(2 * pi() * j * k / 64) - im * sin(2 * pi() * j * k / 64)) / 64, 6) as re, round(sum(re * sin(2 * pi() * j * k / 64) + im * cos(2 * pi() * j * k / 64)) / 64, 6) as im from c, ks group by all")
def t2(spark, sf_dir):
    y = spectra(spark, sf_dir).select("vec_id", T.fft(F.col("x"), F.reverse("x"), inverse=True).alias("y"))
    return y.select("vec_id", F.posexplode(F.arrays_zip("y.re", "y.im")).alias("k", "z")).select("vec_id", "k", F.round("z.re", 6).alias("re"), F.round("z.im", 6).alias("im"))


@plan("t3_mdct", f"with {BLOCKS}, {KS} select stream, f, k, round(2 * sum(x * {_COS}), 6) as y from bl, ks group by all")
def t3(spark, sf_dir):
    return _round("y", "y")(blocks(spark, sf_dir).select("stream", "f", T.mdct(F.col("b"), N).alias("y")))


@plan("t4_inverse_mdct", f"with {SPEC_SQL}, ts as (select unnest(range({2 * N})) as i) select vec_id, i, round(sum(x * {_COS}) / {N}, 8) as y from sp, ts group by all")
def t4(spark, sf_dir):
    return _round("y", "y", "i", 8)(spectra(spark, sf_dir).select("vec_id", T.imdct(F.col("x"), N).alias("y")))


@plan("t5_reference_mdct", f"with {SPEC_SQL}, h as (select vec_id, k as i, x from sp union all select vec_id, k + 64, -x from sp), {KS} select vec_id, k, round(2 * sum(x * {_COS}), 6) as y from h, ks group by all")
def t5(spark, sf_dir):
    """The definition as a join of samples to cosines, for comparison with t3."""
    both = F.concat("x", F.transform("x", lambda v: -v))
    x = long_form(spectra(spark, sf_dir).select("vec_id", both.alias("x")), "x", "i", "v")
    k = spark.range(N).withColumnRenamed("id", "k")
    # N rows
    c = F.cos(F.lit(3.141592653589793 / N) * (F.col("i") + 0.5 + N / 2) * (F.col("k") + 0.5))
    return x.crossJoin(F.broadcast(k)).groupBy("vec_id", "k").agg(F.round(F.sum(F.col("v") * c) * 2, 6).alias("y"))


def _window(spark, w):
    return spark.range(1).select(F.posexplode(T.doubles(w)).alias("n", "w")).select("n", F.round("w", 7).alias("w"))


@plan("t6_sine_window", "select n, round(sin(pi() * (n + 0.5) / 256), 7) as w from (select unnest(range(256)) as n)")
def t6(spark, sf_dir):
    return _window(spark, T.sine_window(256))


_I0 = "(1 + " + " + ".join(f"pow({{x}} * 0.5, {2 * k}) / pow({__import__('math').factorial(k)}.0, 2)" for k in range(1, 25)) + ")"


@plan("t7_kbd_window", f"with h as (select unnest(range(129)) as n), k as (select n, {_I0.format(x='(4 * pi() * sqrt(greatest(0.0, 1 - pow(2.0 * n / 128 - 1, 2))))')} as v from h), c as (select n, sum(v) over (order by n) as up, sum(v) over () as total from k), u as (select n, sqrt(up / total) as w from c where n < 128) select n, round(w, 7) as w from u union all select 255 - n, round(w, 7) from u")
def t7(spark, sf_dir):
    return _window(spark, T.kbd_window(256, 4.0))


@plan("t8_low_delay_window", "select n, round(sin(pi() * 0.5 * (n + 0.5) / 256) * (1 - 0.1 * cos(2 * pi() * (n + 0.5) / 256)), 7) as w from (select unnest(range(256)) as n)")
def t8(spark, sf_dir):
    return _window(spark, T.low_delay_window(256))


@plan(
    "t9_frame_window",
    "with n as (select unnest(range(256)) as n), s as (select unnest(['long', 'start', 'stop']) as sequence) select sequence, n, round(case when n < 128 then case when sequence <> 'stop' then sin(pi() * (n + 0.5) / 256) when n < 56 then 0 when n < 72 then sin(pi() * (n - 56 + 0.5) / 32) else 1 end else case when sequence <> 'start' then sin(pi() * (n + 0.5) / 256) when n < 184 then 1 when n < 200 then sin(pi() * (n - 184 + 16 + 0.5) / 32) else 0 end end, 7) as w from n, s",
)
def t9(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(s).alias("sequence"), T.doubles(T.frame_window(128, s)).alias("w")) for s in ("long", "start", "stop")])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.sequence", F.posexplode("r.w").alias("n", "w")).select("sequence", "n", F.round("w", 7).alias("w"))


@plan("t10_short_window", "with n as (select unnest(range(32)) as n), j as (select unnest(range(8)) as idx) select idx, 56 + idx * 16 + n as n, round(sin(pi() * (n + 0.5) / 32), 7) as w from n, j")
def t10(spark, sf_dir):
    """Eight windows of 2 x 16 samples inside a block of 256, each at its place."""
    rows = F.array(*[F.struct(F.lit(j).alias("idx"), T.doubles(T.short_window(128, j)).alias("w")) for j in range(8)])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.idx", F.posexplode("r.w").alias("p", "w")).select("idx", (56 + F.col("idx") * 16 + F.col("p")).alias("n"), F.round("w", 7).alias("w"))


@plan("t13_encoder_transform", f"with {BLOCKS}, {KS} select stream, f, k, round(2 * sum(x * {_SINE} * {_COS}), 6) as y from bl, ks group by all")
def t13(spark, sf_dir):
    return _round("y", "y")(coded(spark, sf_dir))


def coded(spark, sf_dir):
    return blocks(spark, sf_dir).select("stream", "f", T.mdct(T.windowed(F.col("b"), T.sine_window(2 * N)), N).alias("y"))


@plan("t11_synthesis", f"with {FR} select a.stream, a.f, a.i, round(coalesce(b.x, 0) * 32768, 6) + 0.0 as x from fr a left join fr b on a.stream = b.stream and a.i = b.i and a.f = b.f + 1")
def t11(spark, sf_dir):
    """Inverse transform, window and overlap-add of t13's spectra: the input, a frame late (what the oracle states).

    In units of samples: those are integers, so no rounding meets a tie.
    """
    back = coded(spark, sf_dir).select("stream", "f", T.windowed(T.imdct(F.col("y"), N), T.sine_window(2 * N)).alias("b"))
    halves = back.select("stream", "f", F.slice("b", 1, N).alias("head"), F.slice("b", N + 1, N).alias("x"))
    met = with_previous(halves.select("stream", "f", "x"), N).select("stream", "f", "p").join(halves.select("stream", "f", "head"), ["stream", "f"])
    return long_form(met.select("stream", "f", F.zip_with("head", "p", lambda a, b: F.round((a + b) * FULL_SCALE, 6) + 0.0).alias("x")), "x", "i", "x")


@plan("t12_eight_short", "with e as (select vec_id, cast(unnest(embedding) as double) as x, unnest(range(64)) as p from embeddings), s as (select vec_id, p // 8 as w, p % 8 as k, x from e), n as (select unnest(range(16)) as i), y as (select vec_id, w, i, sum(x * cos(pi() / 8 * (i + 4.5) * (k + 0.5))) / 8 * sin(pi() * (i + 0.5) / 16) as y from s, n group by vec_id, w, i) select vec_id, j as i, round(sum(y), 8) as y from (select vec_id, 28 + w * 8 + i as j, y from y) z group by vec_id, j")
def t12(spark, sf_dir):
    """Eight spectra of 8 lines, transformed back, windowed and overlapped inside a block of 128."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.slice("x", w * 8 + 1, 8))
    short = spectra(spark, sf_dir).select("vec_id", F.posexplode(parts).alias("w", "s"))
    y = short.select("vec_id", "w", T.windowed(T.imdct(F.col("s"), 8), T.sine_window(16)).alias("y"))
    return y.select("vec_id", "w", F.posexplode("y").alias("p", "y")).groupBy("vec_id", (28 + F.col("w") * 8 + F.col("p")).alias("i")).agg(F.round(F.sum("y"), 8).alias("y"))


@plan(
    "t19_resample",
    f"with {SPEC_SQL}, o as (select unnest(range(69)) as i), p as (select i, i * 44100.0::double / 48000 as pos from o), w as (select i, cast(floor(pos) as integer) + t as j, t - (pos - floor(pos)) as tap from p, (select unnest(range(-8, 8)) as t)), ww as (select i, j, case when abs(tap) < 1e-12 then 1 else sin(pi() * tap * 0.9) / (pi() * tap * 0.9) end * sqrt(greatest(0, 1 - pow(tap / 8, 2))) as w from w where j between 0 and 63) select vec_id, i, round(sum(x * w) / sum(w), 7) as y from ww join sp on sp.k = ww.j group by all",
)
def t19(spark, sf_dir):
    return _round("y", "y", "i", 7)(spectra(spark, sf_dir).select("vec_id", T.resample(F.col("x"), 64, 44100, 48000).alias("y")))


@plan("t22_lpc_analysis", f"with {SPEC_SQL} select vec_id, k, round(x - 0.7 * coalesce(lag(x, 1) over w, 0) + 0.25 * coalesce(lag(x, 2) over w, 0) - 0.125 * coalesce(lag(x, 3) over w, 0), 7) as y from sp window w as (partition by vec_id order by k)".replace("x - 0.7", "x + 0.7").replace("+ 0.25", "- 0.25").replace("- 0.125", "+ 0.125"))
def t22(spark, sf_dir):
    from .decoder import LPC

    y = F.transform("x", lambda v, k: F.round(v + sum((c * F.coalesce(F.get("x", F.when(k > j, k - j - 1)), F.lit(0.0)) for j, c in enumerate(LPC)), F.lit(0.0)), 7) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")
