"""Loudness, dynamics, limiting, window decisions and fidelity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds
from ..operators.streams import by_row
from ..sources.signals import FULL_SCALE, PCM_SQL, frames, pcm, table
from .registry import plan

RATE = 8000
STEP = 20  # samples of a quarter block in the queries
_LEVEL = "(-0.691 + 10 * log10({x}))"


def level(power):
    return F.when(power > 0, F.lit(-0.691) + 10 * F.log10(power))


def blocks(x, step: int):
    """stream, b, power: mean square of blocks of four quarters, each block a quarter after the last.

    Quarter sums first, then sums over four of them: a stream's quarters are
    1/step of its samples.
    """
    quarter = x.groupBy("stream", F.floor(F.col("n") / step).alias("q")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("c")).where(F.col("c") == step)
    # a quarter is sent to the four blocks that hold it
    sent = quarter.select("stream", F.explode(F.sequence(F.col("q"), F.col("q") + 3)).alias("b"), "e")
    return sent.groupBy("stream", "b").agg(F.sum("e").alias("e"), F.count("*").alias("c")).where(F.col("c") == 4).select("stream", "b", (F.col("e") / (4 * step)).alias("power"))


BLOCK_SQL = f"{PCM_SQL}, q as (select stream, n // {STEP} as q, sum(pow(s / 32768.0::double, 2)) as e from pcm group by all having count(*) = {STEP}), bl as (select stream, q as b, sum(e) over w / {4 * STEP} as power, row_number() over (partition by stream order by q) as r from q window w as (partition by stream order by q rows 3 preceding)), blocks as (select stream, b, power from bl where r >= 4)"


def _scaled(spark, sf_dir):
    return pcm(spark, sf_dir).select("stream", "n", (F.col("s") / FULL_SCALE).alias("x"))


@plan("o11_loudness_blocks", f"with {BLOCK_SQL} select stream, b, round(power, 12) as power from blocks")
def o11(spark, sf_dir):
    return blocks(_scaled(spark, sf_dir), STEP).select("stream", "b", F.round("power", 12).alias("power"))


@plan("o13_integrated_loudness", f"with {BLOCK_SQL}, a as (select stream, power from blocks where {_LEVEL.format(x='power')} > -70), g as (select stream, avg(power) as m from a group by 1), r as (select stream, avg(power) as p from a join g using (stream) where {_LEVEL.format(x='power')} > {_LEVEL.format(x='m')} - 10 group by 1) select s.stream, round(case when r.p is null then -70 else {_LEVEL.format(x='r.p')} end, 6) as lkfs from (select distinct stream from blocks) s left join r using (stream)")
def o13(spark, sf_dir):
    return integrated(blocks(_scaled(spark, sf_dir), STEP))


def integrated(b):
    """Two gates: absolute at -70, then 10 below the mean of what passed; -70 where nothing did."""
    loud = b.withColumn("on", level(F.col("power")) > -70)
    first = loud.groupBy("stream").agg(F.avg(F.when(F.col("on"), F.col("power"))).alias("m"))
    kept = loud.join(first, "stream").groupBy("stream").agg(F.avg(F.when(F.col("on") & (level(F.col("power")) > level(F.col("m")) - 10), F.col("power"))).alias("p"))
    return kept.select("stream", F.round(F.coalesce(level(F.col("p")), F.lit(-70.0)), 6).alias("lkfs"))


@plan("o14_mean_square_loudness", f"with {PCM_SQL} select stream, round({_LEVEL.format(x='avg(pow(s / 32768.0::double, 2))')}, 6) as lkfs from pcm group by 1")
def o14(spark, sf_dir):
    return _scaled(spark, sf_dir).groupBy("stream").agg(F.round(level(F.avg(F.col("x") * F.col("x"))), 6).alias("lkfs"))


@plan("o12_channel_weight", "select c as channels, i as channel, cast(case when c in (6, 8) and i = 3 then 0 when c = 6 and i in (4, 5) or c = 8 and i between 4 and 7 then 1.41 else 1 end as double) as weight from (select unnest(range(1, 9)) as c) a, (select unnest(range(8)) as i) b where i < c")
def o12(spark, sf_dir):
    c = spark.range(1, 9).select(F.col("id").alias("channels")).withColumn("channel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("channels") - 1)))
    return c.withColumn("weight", channel_weight(F.col("channel"), F.col("channels")))


def channel_weight(channel, channels):
    surround = channels.isin(6, 8)
    return F.when(surround & (channel == 3), 0.0).when(surround & (channel > 3), 1.41).otherwise(1.0)


_GAIN = "least(6.0, greatest(-12.0, least(-23 - l, 0) - 0.5 * greatest(l + 24, 0)))"


@plan("o15_gain_choice", f"select event_id, cast(round({_GAIN} / 0.25) as integer) as steps from (select event_id, value / 7 - 70 as l from events) t")
def o15(spark, sf_dir):
    l = F.col("value") / 7 - 70
    gain = F.least(F.lit(6.0), F.greatest(F.lit(-12.0), F.least(F.lit(-23.0) - l, F.lit(0.0)) - F.greatest(l + 24, F.lit(0.0)) * 0.5))
    return table(spark, sf_dir, "events").select("event_id", F.round(gain / 0.25).cast("int").alias("steps"))


@plan("o16_reference_level", "select event_id, case when event_id % 9 = 0 then 27 else cast(trunc(least(127.0, greatest(0.0, -4 * (value / 7 - 70)))) as integer) end as level from events")
def o16(spark, sf_dir):
    l = F.when(F.col("event_id") % 9 != 0, F.col("value") / 7 - 70)
    return table(spark, sf_dir, "events").select("event_id", F.when(l.isNull(), 27).otherwise(F.floor(F.least(F.lit(127.0), F.greatest(F.lit(0.0), l * -4)))).cast("int").alias("level"))


@plan("o5_metadata_hold", "select event_id, last_value(case when event_id % 7 = 3 then value end ignore nulls) over (partition by event_type order by event_id rows between unbounded preceding and current row) as held from events")
def o5(spark, sf_dir):
    """Held within runs of event numbers; one row a run carries the last value on."""
    run = F.floor(F.col("event_id") / 65536)
    e = table(spark, sf_dir, "events").select("event_type", "event_id", run.alias("run"), F.when(F.col("event_id") % 7 == 3, F.col("value")).alias("v"))
    near = e.withColumn("near", F.last("v", ignorenulls=True).over(Window.partitionBy("event_type", "run").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)))
    ends = e.groupBy("event_type", "run").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("event_id"))).alias("v"))
    carried = ends.select("event_type", "run", F.last("v", ignorenulls=True).over(Window.partitionBy("event_type").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return near.join(carried, ["event_type", "run"]).select("event_id", F.coalesce("near", "carried").alias("held"))


@plan("o6_band_gain", "select event_id, round(pow(10, g / 4.0 * case when g < 0 then 0.75 else 0.5 end / 20), 9) as gain from (select event_id, event_id % 255 - 127 as g from events) t")
def o6(spark, sf_dir):
    g = F.col("event_id") % 255 - 127
    return table(spark, sf_dir, "events").select("event_id", F.round(F.pow(F.lit(10.0), g / 4 * F.when(g < 0, 0.75).otherwise(0.5) / 20), 9).alias("gain"))


@plan("o7_level_normalisation", "select event_id, round(pow(10, (92 - event_id % 128) / 80.0), 9) as gain from events")
def o7(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.pow(F.lit(10.0), (92 - F.col("event_id") % 128) / 80), 9).alias("gain"))


@plan("o8_gain_on_lines", "with l as (select vec_id, unnest(range(64)) as k, cast(unnest(embedding) as double) as x from embeddings) select vec_id, k, round(x * case when k < 16 then 0.5 when k < 40 then 1.25 else 2 end, 7) as x from l")
def o8(spark, sf_dir):
    from ..sources.signals import long_form, spectra

    x = F.transform("x", lambda v, k: F.round(v * F.when(k < 16, 0.5).when(k < 40, 1.25).otherwise(2.0), 7))
    return long_form(spectra(spark, sf_dir).select("vec_id", x.alias("x")), "x", "k", "x")


@plan("o9_gain_on_samples", f"with {PCM_SQL} select stream, n, round(s * 1.25, 4) as x from pcm")
def o9(spark, sf_dir):
    return pcm(spark, sf_dir).select("stream", "n", F.round(F.col("s") * 1.25, 4).alias("x"))


def _sections_sql() -> str:
    """A recursive CTE: both sections, a sample at a time."""
    (b, a), (d, c) = folds.k_weighting(RATE)
    return f"with recursive {PCM_SQL}, x as (select stream, n, s / 32768.0::double as x from pcm), r as (select stream, -1::bigint as n, 0.0::double as x1, 0.0::double as x2, 0.0::double as y1, 0.0::double as y2, 0.0::double as z1, 0.0::double as z2 from (select distinct stream from x) union all select t.stream, t.n, t.x, t.x1, t.y, t.y1, {d[0]!r}::double * t.y + {d[1]!r}::double * t.y1 + {d[2]!r}::double * t.y2 - {c[0]!r}::double * t.z1 - {c[1]!r}::double * t.z2, t.z1 from (select x.stream, x.n, x.x, r.x1, r.y1, r.y2, r.z1, r.z2, {b[0]!r}::double * x.x + {b[1]!r}::double * r.x1 + {b[2]!r}::double * r.x2 - {a[0]!r}::double * r.y1 - {a[1]!r}::double * r.y2 as y from r join x on x.stream = r.stream and x.n = r.n + 1) t) select stream, n, round(z1, 7) + 0.0 as y from r where n >= 0"


def _in_frames(samples, size: int):
    """stream, f, x: frames of `size` values x of (stream, n, x), the last filled up with zeros."""
    cut = samples.groupBy("stream", F.floor(F.col("n") / size).alias("f")).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("r"))
    x = F.transform("r", lambda r: r["x"].cast("double"))
    return cut.select("stream", "f", F.concat(x, F.array_repeat(F.lit(0.0), F.lit(size) - F.size("r"))).alias("x"))


@plan("o10_k_weighting", _sections_sql())
def o10(spark, sf_dir):
    """Two recursive sections, frame by frame."""
    x = _scaled(spark, sf_dir).select("stream", "n", "x")
    y = folds.filtered(_in_frames(x, 256), folds.cascade(folds.k_weighting(RATE), 256))
    flat = y.select("stream", "f", F.posexplode("y").alias("i", "y")).select("stream", (F.col("f") * 256 + F.col("i")).alias("n"), "y")
    ends = x.groupBy("stream").agg(F.max("n").alias("last"))
    return flat.join(F.broadcast(ends), "stream").where(F.col("n") <= F.col("last")).select("stream", "n", (F.round("y", 7) + 0.0).alias("y"))


_LIMIT = max(1, int(folds.ATTACK_MS * RATE / 1000))
_UP, _DOWN = 0.1 ** (1 / (_LIMIT + 1)), 0.1 ** (1 / (folds.RELEASE_MS * RATE / 1000 + 1))


@plan(
    "o3_peak_limiter",
    f"with recursive {PCM_SQL}, w as (select stream, n, s * 4.0::double as s, max(abs(s * 4.0::double)) over (partition by stream order by n rows between {_LIMIT - 1} preceding and current row) as top, lag(s * 4.0::double, {_LIMIT}, 0.0::double) over (partition by stream order by n) as late from pcm), g as (select *, case when top > {folds.THRESHOLD} then {folds.THRESHOLD}::double / top else 1.0::double end as g from w), r as (select stream, -1::bigint as n, 1.0::double as gain, 1.0::double as target, 0.0::double as y from (select distinct stream from pcm) union all select t.stream, t.n, t.gain, t.target, greatest(-{folds.THRESHOLD}, least({folds.THRESHOLD}, t.late * t.gain)) from (select u.stream, u.n, u.late, u.target, case when u.target < u.gain then greatest({_UP!r}::double * (u.gain - u.target) + u.target, u.g) else {_DOWN!r}::double * (u.gain - u.target) + u.target end as gain from (select g.stream, g.n, g.late, g.g, r.gain, case when g.g < r.gain then least(r.target, (g.g - 0.1::double * r.gain) / 0.9::double) else g.g end as target from r join g on g.stream = r.stream and g.n = r.n + 1) u) t) select stream, n, round(gain, 7) as gain, round(y, 3) + 0.0 as y from r where n >= 0",
)
def o3(spark, sf_dir):
    """Samples four times as loud, late by the attack time, within the threshold."""

    def step(c, state):
        y, gain, state = folds.limit(c["s"].astype(float)[:, None] * 4.0, RATE, state)
        return {"stream": c["stream"], "n": c["n"], "gain": gain, "y": y[:, 0]}, state

    got = folds.in_order(pcm(spark, sf_dir), "n", step, "stream string, n bigint, gain double, y double")
    return got.select("stream", "n", F.round("gain", 7).alias("gain"), (F.round("y", 3) + 0.0).alias("y"))


def _energies(spark, sf_dir):
    """stream, f, e: energies of eight sub-blocks of each complete frame of 64 samples, high-passed."""
    x = pcm(spark, sf_dir)
    y = folds.filtered(frames(x, 64), folds.highpass(64))
    return y.select("stream", "f", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.aggregate(F.slice("y", w * 8 + 1, 8), F.lit(0.0), lambda a, v: a + v * v)).alias("e"))


_ENERGY = f"with recursive {PCM_SQL}, fr as (select stream, n, n // 64 as f, cast(s as double) as x from pcm qualify count(*) over (partition by stream, n // 64) = 64), h as (select stream, -1::bigint as n, 0.0::double as x, 0.0::double as y from (select distinct stream from fr) union all select fr.stream, fr.n, fr.x, {folds.HIGHPASS_GAIN} * (fr.x - h.x) + {folds.HIGHPASS_POLE} * h.y from h join fr on fr.stream = h.stream and fr.n = h.n + 1), en as (select stream, n // 8 as b, sum(y * y) as e from h where n >= 0 group by all)"


@plan("a1_transient_energy", f"{_ENERGY} select stream, b // 8 as f, b % 8 as sub_block, round(e, 2) as e from en")
def a1(spark, sf_dir):
    return _energies(spark, sf_dir).select("stream", "f", F.posexplode("e").alias("sub_block", "e")).select("stream", "f", "sub_block", F.round("e", 2).alias("e"))


@plan(
    "a2_attack_decision",
    f"{_ENERGY}, av as (select stream, -1::bigint as b, 0.0::double as a, 0.0::double as e from (select distinct stream from en) union all select en.stream, en.b, av.a + {folds.AVERAGE} * (av.e - av.a), en.e from av join en on en.stream = av.stream and en.b = av.b + 1), raw as (select stream, b // 8 as f, max(case when e * {folds.RATIO} > a then b % 8 else -1 end) as last, max(e) as top from av where b >= 0 group by all), l as (select stream, f, case when top >= {folds.FLOOR} then last else -1 end as last from raw), p as (select *, lag(last, 1, -1) over (partition by stream order by f) as before from l) select stream, f, last >= 0 or before = 7 as attack, case when last >= 0 then last when before = 7 then 0 end as sub_block from p",
)
def a2(spark, sf_dir):
    """By runs of 1,024 frames; each run also sees the frames before it that still have weight in the average."""
    run, back = 1024, -(-folds.MEMORY // 8) + 1
    e = _energies(spark, sf_dir)
    own = F.floor(F.col("f") / run)
    met = e.withColumn("run", F.explode(F.array_distinct(F.array(own, F.floor((F.col("f") + back) / run)))))

    def decide(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("f", kind="stable")
        attack, place = folds.attacks(np.stack(g["e"].to_numpy()))
        g = g.assign(attack=attack, sub_block=pd.array(np.where(attack, place, 0), dtype="Int32"))
        g.loc[~g["attack"], "sub_block"] = pd.NA
        return g[g["f"] // run == g["run"]][["stream", "f", "attack", "sub_block"]]

    return met.groupBy("stream", "run").applyInPandas(decide, "stream string, f bigint, attack boolean, sub_block int")


@plan(
    "a3_window_sequence",
    "with recursive e as (select event_type as stream, row_number() over (partition by event_type order by event_id) as n, value > 300 as here, coalesce(lead(value > 300) over (partition by event_type order by event_id), false) as ahead from events), r as (select stream, n, case when ahead then 'start' else 'long' end as sequence from e where n = 1 union all select e.stream, e.n, case when r.sequence = 'start' then 'short' when r.sequence = 'short' then case when e.here then 'short' else 'stop' end when e.ahead then 'start' else 'long' end from r join e on e.stream = r.stream and e.n = r.n + 1) select stream, n - 1 as n, sequence from r",
)
def a3(spark, sf_dir):
    """A state machine as a scan: maps of states are composed within runs of frames, and a row a run is carried on."""
    from ..sources.signals import numbered

    size = 4096
    e = numbered(table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), "event_id", (F.col("value") > 300).alias("here")), "stream", "event_id").select("stream", "n", "here")
    # a frame meets the next one's attack by both being sent to one number
    met = e.select("stream", "n", "here", F.lit(None).cast("boolean").alias("ahead")).unionByName(e.select("stream", (F.col("n") - 1).alias("n"), F.lit(None).cast("boolean").alias("here"), F.col("here").alias("ahead")))
    pairs = met.groupBy("stream", "n").agg(F.first("here", ignorenulls=True).alias("here"), F.coalesce(F.first("ahead", ignorenulls=True), F.lit(False)).alias("ahead")).where(F.col("here").isNotNull())
    runs = pairs.groupBy("stream", F.floor(F.col("n") / size).alias("run")).agg(F.array_sort(F.collect_list(F.struct("n", "here", "ahead"))).alias("r"))

    def maps(r):
        m = folds.composed(np.array([x["here"] for x in r["r"]]), np.array([x["ahead"] for x in r["r"]]))
        return [{"stream": r["stream"], "run": r["run"], "first": r["r"][0]["n"], "states": m.reshape(-1).tolist(), "leaves": m[-1].tolist()}]

    done = by_row(runs, maps, "stream string, run bigint, first bigint, states array<int>, leaves array<int>")

    def enter(c, state):
        at, out = folds.LONG if state is None else state, []
        for leaves in c["leaves"]:
            out.append(at)
            at = int(leaves[at])
        return {"stream": c["stream"], "run": c["run"], "enters": out}, at

    entered = folds.in_order(done.select("stream", "run", "leaves"), "run", enter, "stream string, run bigint, enters int")
    name = F.array(*map(F.lit, folds.SEQUENCE_NAMES.tolist()))
    state = F.posexplode(F.filter("states", lambda _, k: k % 4 == F.col("enters"))).alias("i", "state")
    return done.join(entered, ["stream", "run"]).select("stream", "first", state).select("stream", (F.col("first") + F.col("i")).alias("n"), F.get(name, F.col("state")).alias("sequence"))


#: A test signal against its reference: the samples off by a little at every third place, and shifted by 3.
_PAIR = "pr as (select a.stream, a.n, cast(a.s as double) as r, cast(b.s as double) + case when b.n % 3 = 0 then 2 else 0 end as t from pcm a join pcm b on a.stream = b.stream and a.n = b.n)"
_STATS = "max(abs(r - t)) as max_abs, round(sqrt(avg(pow(r - t, 2))), 8) as rms, round(case when sum(pow(r - t, 2)) = 0 then null else 10 * log10(sum(r * r) / sum(pow(r - t, 2))) end, 8) as snr, count(*) filter (where r = t) as exact, count(*) as samples"


def stats(pairs, *keys):
    d = F.col("r") - F.col("t")
    e = F.sum(d * d)
    return pairs.groupBy(*keys).agg(F.max(F.abs(d)).alias("max_abs"), F.round(F.sqrt(F.avg(d * d)), 8).alias("rms"), F.round(F.when(e > 0, 10 * F.log10(F.sum(F.col("r") * F.col("r")) / e)), 8).alias("snr"), F.sum((d == 0).cast("bigint")).alias("exact"), F.count("*").alias("samples"))


def _test_signal(p):
    return p.select("stream", "n", F.col("s").cast("double").alias("r"), (F.col("s") + F.when(F.col("n") % 3 == 0, 2).otherwise(0)).cast("double").alias("t"))


@plan("f1_compare", f"with {PCM_SQL}, {_PAIR} select stream, {_STATS} from pr group by stream")
def f1(spark, sf_dir):
    return stats(_test_signal(pcm(spark, sf_dir)), "stream")


@plan("f2_best_alignment", f"with {PCM_SQL}, t as (select stream, n + 3 as n, s + case when n % 3 = 0 then 2 else 0 end as t from pcm), o as (select unnest(range(-8, 9)) as o), c as (select a.stream, o, sqrt(avg(pow(a.s - t.t, 2))) as rms from pcm a, o, t where t.stream = a.stream and t.n = a.n + o group by all) select stream, arg_min(o, rms) as shift, round(min(rms), 8) as rms from c group by 1")
def f2(spark, sf_dir):
    p = pcm(spark, sf_dir)
    test = p.select("stream", (F.col("n") + 3).alias("n"), (F.col("s") + F.when(F.col("n") % 3 == 0, 2).otherwise(0)).alias("s"))
    return best_alignment(p, test)


def best_alignment(reference, test, reach: int = 4096, least: int = 1024, block: int = 16384):
    """stream, shift, rms: the shift of least RMS within +-reach, where test sample n + shift stands against reference sample n.

    Both frames: stream, n, s (16-bit samples, integral).  Shifts at which
    fewer than `least` samples meet don't count; streams that are shorter are
    held to half of the shorter signal.  Ties go to the smaller shift.
    Each block of the reference meets all test samples within reach of it, and
    its sums for all shifts come from one correlation: work grows with the
    samples, not with samples times reach.  Sums are exact.
    """
    lengths = reference.groupBy("stream").agg(F.count("*").alias("a")).join(test.groupBy("stream").agg(F.count("*").alias("b")), "stream")
    short = F.least("a", "b")
    enough = lengths.select("stream", F.when(short >= least, least).otherwise(F.ceil(short / 2)).alias("enough"))
    mine = reference.select("stream", F.floor(F.col("n") / block).alias("b"), F.lit(0).alias("side"), "n", F.col("s").cast("bigint").alias("s"))
    near = F.sequence(F.floor((F.col("n") - reach) / block), F.floor((F.col("n") + reach) / block))
    theirs = test.select("stream", F.explode(near).alias("b"), F.lit(1).alias("side"), "n", F.col("s").cast("bigint").alias("s"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        stream, lo = g["stream"].iloc[0], int(g["b"].iloc[0]) * block
        on = np.zeros((2, block + 2 * reach), dtype=np.int64)
        x = np.zeros_like(on)
        for k, first in ((0, lo), (1, lo - reach)):
            rows = g[g["side"] == k]
            at = rows["n"].to_numpy() - first
            on[k, at], x[k, at] = 1, rows["s"].to_numpy()
        size = 1 << (2 * block + 2 * reach - 1).bit_length()
        # at most 2^30 * block: rounding gives back the whole number
        tr = [np.fft.rfft(v, size) for v in (on[0], x[0], x[0] ** 2, on[1], x[1], x[1] ** 2)]
        meet = lambda a, b: np.rint(np.fft.irfft(np.conj(tr[a]) * tr[b], size)[: 2 * reach + 1]).astype(np.int64)
        c = meet(0, 3)
        e = meet(2, 3) + meet(0, 5) - 2 * meet(1, 4)
        o = np.flatnonzero(c)
        return pd.DataFrame({"stream": stream, "o": o - reach, "e": e[o], "c": c[o]})

    sums = mine.unionByName(theirs).groupBy("stream", "b").applyInPandas(run, "stream string, o bigint, e bigint, c bigint")
    total = sums.groupBy("stream", "o").agg(F.sum("e").alias("e"), F.sum("c").alias("c")).join(enough, "stream").where(F.col("c") >= F.col("enough"))
    best = total.groupBy("stream").agg(F.min(F.struct(F.sqrt(F.col("e") / F.col("c")).alias("rms"), "o")).alias("b"))
    return best.select("stream", F.col("b.o").alias("shift"), F.round("b.rms", 8).alias("rms"))


@plan("f3_compare_files", f"with {PCM_SQL}, {_PAIR} select stream, count(*) as samples, max(abs(r - t)) as max_abs, round(avg(pow(r - t, 2)), 8) as mse, bool_and(r = t) as bit_exact from pr group by stream")
def f3(spark, sf_dir):
    d = F.col("r") - F.col("t")
    return _test_signal(pcm(spark, sf_dir)).groupBy("stream").agg(F.count("*").alias("samples"), F.max(F.abs(d)).alias("max_abs"), F.round(F.avg(d * d), 8).alias("mse"), F.bool_and(d == 0).alias("bit_exact"))


@plan("f4_pcm_hash", f"with recursive {PCM_SQL}, w as (select stream, n, (s + 65536) % 65536 as u from pcm), byt as (select stream, 2 * n as k, u % 256 as v from w union all select stream, 2 * n + 1, u // 256 from w), h as (select stream, -1::bigint as k, 14695981039346656037::hugeint as h from (select distinct stream from pcm) union all select byt.stream, byt.k, ((h.h - h.h % 256 + xor((h.h % 256)::bigint, byt.v::bigint)) * 1099511628211) % 18446744073709551616::hugeint from h join byt on byt.stream = h.stream and byt.k = h.k + 1) select stream, lpad(lower(to_hex(h::ubigint)), 16, '0') as hash from h qualify row_number() over (partition by stream order by k desc) = 1")
def f4(spark, sf_dir):
    """Read in order, with the hash as the state."""
    end = lambda stream, h: {"stream": [stream], "hash": [f"{h:016x}"]}
    return folds.in_order(pcm(spark, sf_dir), "n", lambda c, h: (None, folds.fnv1a(c["s"], *([] if h is None else [h]))), "stream string, hash string", end)


@plan("f5_pcm_summary", f"with {PCM_SQL} select stream, count(*) as samples, count(*) / {RATE}.0::double as seconds from pcm group by 1")
def f5(spark, sf_dir):
    return pcm(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("samples"), (F.count("*") / RATE).alias("seconds"))


@plan("o25_trace_summary", "select user_id, event_type, count(*) as n, round(sum(case when event_id % 16 = 13 then value * value else 0 end) / sum(value * value), 9) as noise_share from events group by all")
def o25(spark, sf_dir):
    e = F.col("value") * F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("event_id") % 16 == 13, e).otherwise(0.0)) / F.sum(e), 9).alias("noise_share"))
