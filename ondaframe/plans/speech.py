"""Speech and unified coding: scalar steps, filters and searches over events and embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import transforms as T
from ..sources.signals import FULL_SCALE, PCM_SQL, SPEC_SQL, frames, frames_sql, long_form, pcm, spectra, table
from .decoder import all_pole
from .registry import plan


@plan("u13_frame_class", f"with {PCM_SQL}, fr as (select stream, n // 1024 as f, n, s - 5000 as x from pcm), c as (select stream, f, case when (x >= 0) <> (lag(x >= 0) over (partition by stream, f order by n)) then 1 else 0 end as turn from fr) select stream, f, sum(turn)::bigint as crossings, case when sum(turn) < 80 then 'speech' else 'music' end as mode from c group by all")
def u13(spark, sf_dir):
    """Zero crossings in 1,024 samples, fewer than 80 being speech.  The streams are all positive, so 5,000 is taken off them first; the last frame is as long as there are samples."""
    cut = pcm(spark, sf_dir).groupBy("stream", F.floor(F.col("n") / 1024).alias("f")).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    up = F.transform("r", lambda r: r["s"] >= 5000)
    turns = F.aggregate(F.zip_with(F.slice(up, 1, F.size("r") - 1), F.slice(up, 2, F.size("r")), lambda a, b: (a != b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return cut.select("stream", "f", turns.alias("crossings")).withColumn("mode", F.when(F.col("crossings") < 80, "speech").otherwise("music"))


@plan("u14_mode_unpack", "select event_id, case when m = 25 then '3333' when m = 24 then '2222' when m >= 20 then (m & 1) || '' || ((m >> 1) & 1) || '22' when m >= 16 then '22' || (m & 1) || '' || ((m >> 1) & 1) else (m & 1) || '' || ((m >> 1) & 1) || '' || ((m >> 2) & 1) || '' || ((m >> 3) & 1) end as modes from (select event_id, event_id % 26 as m from events) t")
def u14(spark, sf_dir):
    m = (F.col("event_id") % 26).cast("int")
    bit = lambda k: F.call_function("shiftright", m, F.lit(k)).bitwiseAND(F.lit(1)).cast("string")
    modes = F.when(m == 25, "3333").when(m == 24, "2222").when(m >= 20, F.concat(bit(0), bit(1), F.lit("22"))).when(m >= 16, F.concat(F.lit("22"), bit(0), bit(1))).otherwise(F.concat(*map(bit, range(4))))
    return table(spark, sf_dir, "events").select("event_id", modes.alias("modes"))


@plan("u23_pre_emphasis", f"with {SPEC_SQL} select vec_id, k, round(x - 0.68 * coalesce(lag(x) over (partition by vec_id order by k), 0), 7) as y from sp")
def u23(spark, sf_dir):
    y = F.transform("x", lambda v, k: F.round(v - F.coalesce(F.get("x", F.when(k > 0, k - 1)), F.lit(0.0)) * 0.68, 7) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


@plan("u24_de_emphasis", f"with recursive {SPEC_SQL}, y as (select vec_id, k, x as y from sp where k = 0 union all select y.vec_id, s.k, s.x + 0.68 * y.y from y join sp s on s.vec_id = y.vec_id and s.k = y.k + 1) select vec_id, k, round(y, 7) as y from y")
def u24(spark, sf_dir):
    y = F.transform(all_pole(F.col("x"), [-0.68]), lambda v: F.round(v, 7) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


@plan("u25_pitch_sharpening", f"with recursive {SPEC_SQL}, y as (select vec_id, k, x as y from sp where k < 40 union all select y.vec_id, s.k, s.x + 0.85 * y.y from y join sp s on s.vec_id = y.vec_id and s.k = y.k + 40) select vec_id, k, round(y, 7) as y from y")
def u25(spark, sf_dir):
    """Adds 0.85 of what stands 40 samples back, once it is sharpened itself."""

    def step(acc, v):
        n = F.size(acc)
        return F.concat(acc, F.array(v + F.coalesce(F.get(acc, F.when(n >= 40, n - 40)), F.lit(0.0)) * 0.85))

    y = F.transform(F.aggregate("x", F.array().cast("array<double>"), step), lambda v: F.round(v, 7) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


@plan("t21_lpc_synthesis", f"with recursive {SPEC_SQL}, y as (select vec_id, k, x as y, 0.0::double as y1 from sp where k = 0 union all select y.vec_id, s.k, s.x - 0.9 * y.y + 0.2 * y.y1, y.y from y join sp s on s.vec_id = y.vec_id and s.k = y.k + 1) select vec_id, k, round(y, 6) as y from y")
def t21(spark, sf_dir):
    y = F.transform(all_pole(F.col("x"), [0.9, -0.2]), lambda v: F.round(v, 6) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


@plan("u26_residual", f"with {SPEC_SQL} select vec_id, k, round(x + 0.9 * coalesce(lag(x, 1) over w, 0) - 0.2 * coalesce(lag(x, 2) over w, 0), 7) as y from sp window w as (partition by vec_id order by k)")
def u26(spark, sf_dir):
    back = lambda k, n: F.coalesce(F.get("x", F.when(k >= n, k - n)), F.lit(0.0))
    y = F.transform("x", lambda v, k: F.round(v + back(k, 1) * 0.9 - back(k, 2) * 0.2, 7) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


@plan("u34_lpc_weighting", f"with {SPEC_SQL} select vec_id, k, round(x * pow(0.92, k), 9) as y from sp where k < 17")
def u34(spark, sf_dir):
    y = F.transform(F.slice("x", 1, 17), lambda v, k: F.round(v * F.pow(F.lit(0.92), k.cast("double")), 9) + 0.0)
    return long_form(spectra(spark, sf_dir).select("vec_id", y.alias("y")), "y", "k", "y")


@plan("u35_envelope_gains", f"with {SPEC_SQL}, a as (select vec_id, k, case when k = 0 then 1 else x * pow(0.92, k) end as x from sp where k < 17), j as (select unnest(range(64)) as j) select vec_id, j as k, round(1 / sqrt(pow(sum(x * cos(2 * pi() * j * k / 64)), 2) + pow(sum(x * sin(2 * pi() * j * k / 64)), 2)), 6) as gain from a, j group by vec_id, j")
def u35(spark, sf_dir):
    """Reciprocal magnitude response of a weighted filter of order 16, zero-padded to 64."""
    a = F.transform(F.slice("x", 1, 17), lambda v, k: F.when(k == 0, 1.0).otherwise(v * F.pow(F.lit(0.92), k.cast("double"))))
    padded = F.concat(a, F.array_repeat(F.lit(0.0), 47))
    y = spectra(spark, sf_dir).select("vec_id", padded.alias("a")).select("vec_id", T.fft(F.col("a"), F.transform("a", lambda v: v * 0.0)).alias("y"))
    return y.select("vec_id", F.posexplode(F.arrays_zip("y.re", "y.im")).alias("k", "z")).select("vec_id", "k", F.round(1 / F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")), 6).alias("gain"))


@plan("u37_low_frequency_limit", f"with {SPEC_SQL}, b as (select vec_id, k // 4 as b, 0.01 + sum(x * x) as e from sp where k < 32 group by all), r as (select vec_id, b, sqrt(e / max(e) over (partition by vec_id)) as r from b) select vec_id, b, round(greatest(0.1, max(r) over (partition by vec_id order by b)), 8) as gain from r")
def u37(spark, sf_dir):
    """Running maximum of the blocks' relative level, from 0.1; blocks of 4 lines over the lower half."""
    e = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.aggregate(F.slice("x", b * 4 + 1, F.lit(4)), F.lit(0.01), lambda s, v: s + v * v))
    ratio = F.transform(e, lambda v: F.sqrt(v / F.array_max(e)))
    gain = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.round(F.greatest(F.lit(0.1), F.array_max(F.slice(ratio, F.lit(1), n))), 8))
    return long_form(spectra(spark, sf_dir).select("vec_id", gain.alias("g")), "g", "b", "gain")


@plan("u38_absolute_lag", "select event_id, case when i < 376 then 34 + i // 4 when i < 376 + 128 * 2 then 128 + (i - 376) // 2 else i + 256 - 376 - 256 end as lag, case when i < 376 then i % 4 when i < 632 then ((i - 376) % 2) * 2 else 0 end as frac from (select event_id, event_id % 700 as i from events) t")
def u38(spark, sf_dir):
    """Quarter samples from 34 to 128, half samples to 256, then whole ones."""
    i = (F.col("event_id") % 700).cast("bigint")
    fine, half = i < (128 - 34) * 4, i < (128 - 34) * 4 + (256 - 128) * 2
    j = i - (128 - 34) * 4
    lag = F.when(fine, 34 + F.floor(i / 4)).when(half, 128 + F.floor(j / 2)).otherwise(256 + j - (256 - 128) * 2)
    return table(spark, sf_dir, "events").select("event_id", lag.cast("bigint").alias("lag"), F.when(fine, i % 4).when(half, j % 2 * 2).otherwise(0).cast("bigint").alias("frac"))


@plan("u5_random_sign", "with recursive r as (select event_id, 0 as i, (event_id * 48271) & 4294967295 as s from events union all select event_id, i + 1, (s * 69069 + 5) & 4294967295 from r where i < 4) select event_id, i, case when (s >> 16) & 1 = 1 then -1 else 1 end as sign from r where i > 0".replace("(s >> 16) & 1 = 1", "((s >> 16) & 1) = 1"))
def u5(spark, sf_dir):
    low = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.array(low(F.col("event_id") * 48271)), lambda acc, _: F.concat(acc, F.array(low(F.get(acc, F.size(acc) - 1) * 69069 + 5))))
    signs = F.transform(run, lambda s: F.when(F.call_function("shiftright", s, F.lit(16)).bitwiseAND(F.lit(1).cast("bigint")) == 1, -1).otherwise(1))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(signs).alias("i", "sign")).where(F.col("i") > 0)


_RISING = "q as (select vec_id, k, sum(0.2 + abs(x)) over (partition by vec_id order by k) as f from sp where k < 16), w as (select *, 1 / (f - lag(f, 1, 0) over o) + 1 / (lead(f, 1, 10) over o - f) as w from q window o as (partition by vec_id order by k)), c as (select unnest(range(256)) as code)"


@plan("u28_nearest_vector", f"with {SPEC_SQL}, {_RISING}, d as (select vec_id, code, round(sum(w * pow(f - (k + 1) * (0.2 + code / 1024.0), 2)), 9) as d from w, c group by all) select vec_id, m.code as code from (select vec_id, min(struct_pack(d := d, code := code)) as m from d group by 1)")
def u28(spark, sf_dir):
    """Nearest of 256 evenly spaced spectra of 16 rising lines; a line weighs the more, the closer its neighbours are.  Ties go to the smaller code."""
    step = F.transform(F.slice("x", 1, 16), lambda v: F.abs(v) + 0.2)
    lines = F.transform(step, lambda _, k: F.aggregate(F.slice(step, 1, k + 1), F.lit(0.0), lambda a, v: a + v))
    x = spectra(spark, sf_dir).select("vec_id", lines.alias("f"))
    at = lambda k: F.when(k < 0, 0.0).when(k > 15, 10.0).otherwise(F.get("f", F.least(F.greatest(k, F.lit(0)), F.lit(15))))
    weight = F.transform("f", lambda v, k: 1 / (v - at(k - 1)) + 1 / (at(k + 1) - v))
    pairs = x.select("vec_id", F.arrays_zip(F.col("f"), weight.alias("w")).alias("p"))
    far = lambda code: F.round(F.aggregate(F.transform("p", lambda p, k: p["w"] * F.pow(p["f"] - (k + 1) * (F.lit(0.2) + code / 1024), F.lit(2.0))), F.lit(0.0), lambda a, v: a + v), 9)
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda c: F.struct(far(c).alias("d"), c.cast("bigint").alias("code"))))
    return pairs.select("vec_id", best["code"].alias("code"))


@plan("u12_frequency_to_band", "with b as (select unnest(range(15)) as j, unnest([0, 4, 8, 12, 16, 20, 28, 36, 44, 56, 68, 80, 96, 112, 128]) as lo), c as (select event_id, j, abs(lo - event_id % 128) as d from events, b) select event_id, cast((min(struct_pack(d := d, j := j))).j as integer) as edge from c group by 1")
def u12(spark, sf_dir):
    """Nearest band edge to a line, ties to the lower."""
    from ..functions.tables import SHORT_48, offsets

    line = F.col("event_id") % 128
    edges = F.array(*map(F.lit, offsets(SHORT_48)))
    near = F.array_min(F.transform(edges, lambda e, j: F.struct(F.abs(e - line).alias("d"), j.alias("j"))))
    return table(spark, sf_dir, "events").select("event_id", near["j"].alias("edge"))


@plan("u8_noise_level", f"with {SPEC_SQL}, l as (select unnest(range(8)) as n), c as (select vec_id, n, sum(pow(abs(x) - pow(2.0, (n - 14) / 3.0), 2)) as e from sp, l group by all) select vec_id, arg_min(n, e) as level from c group by 1")
def u8(spark, sf_dir):
    """Of eight levels, that of least squared error to the lines' magnitudes."""
    errors = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")), lambda n: F.struct(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(F.abs(v) - F.pow(F.lit(2.0), (n - 14) / 3), F.lit(2.0))).alias("e"), n.alias("n")))
    return spectra(spark, sf_dir).select("vec_id", F.array_min(errors)["n"].alias("level"))
