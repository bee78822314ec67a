"""Band replication's headers, grids and flags: written from known fields and read back; band layouts."""

from __future__ import annotations

import numpy as np

from ..functions import books as K
from ..operators import bands as R
from ..operators import replication_syntax as Y
from ..operators.bitio import Reader, Writer, written
from ..sources.containers import parse_wav, write_wav
from ..sources.signals import PCM_SQL, pcm
from .filterbanks import _RATES
from .registry import plan
from .syntax import _event_rows


@plan("b1_header_parse", "select event_id, event_id % 2 = 0 as fine_steps, event_id % 16 as start, event_id // 3 % 16 as stop, event_id % 8 as crossover, case when event_id % 5 = 0 then event_id % 4 else 2 end as scale, case when event_id % 5 = 0 then event_id % 3 = 0 else true end as warp, case when event_id % 7 = 0 then event_id % 4 else 2 end as limiter_gains, case when event_id % 7 = 0 then event_id % 2 = 0 else true end as interpolate from events")
def b1(spark, sf_dir):
    """Groups of fields that are left out have their defaults."""

    def f(e):
        h = {"fine_steps": e % 2 == 0, "start": e % 16, "stop": e // 3 % 16, "crossover": e % 8}
        h |= {"scale": e % 4, "warp": e % 3 == 0} if e % 5 == 0 else {}
        h |= {"limiter_gains": e % 4, "interpolate": e % 2 == 0} if e % 7 == 0 else {}
        return [Y.header(Reader(written(Y.header, h).data), {})]

    return _event_rows(spark, sf_dir, f, "fine_steps boolean, start int, stop int, crossover int, scale int, warp boolean, limiter_gains int, interpolate boolean")


@plan(
    "b9_time_grid",
    "select event_id, kind, n as envelopes, lead as first, 16 + trail as last, case when n = 1 then null when kind = 0 then 8 when kind = 1 then 16 + trail - 2 * (n - 1) + 2 * (case when pointer > 1 then n + 1 - pointer else n - 1 end - 1) when kind = 2 then lead + 2 * (case when pointer = 0 then 1 when pointer = 1 then n - 1 else pointer - 1 end) else case when (case when pointer > 1 then n + 1 - pointer else n - 1 end) <= a then lead + 2 * (case when pointer > 1 then n + 1 - pointer else n - 1 end) else 16 + trail - 2 * (n - (case when pointer > 1 then n + 1 - pointer else n - 1 end)) end end as middle from (select *, case when kind = 0 then n0 when kind = 3 then a + b + 1 when kind = 1 then b + 1 else a + 1 end as n, case when kind = 0 then 0 else event_id % (1 + case when kind = 3 then a + b + 1 when kind = 1 then b + 1 else a + 1 end) end as pointer from (select event_id, event_id % 4 as kind, cast(pow(2, event_id // 4 % 4) as bigint) as n0, event_id // 4 % 3 as a, event_id // 12 % 3 as b, case when event_id % 4 >= 2 then event_id // 5 % 4 else 0 end as lead, case when event_id % 4 % 2 = 1 then event_id // 7 % 4 else 0 end as trail from events))",
)
def b9(spark, sf_dir):
    """Four kinds of frame; inner widths are 2 slots here, so that the middle border can be written out."""

    def f(e):
        kind, a, b = e % 4, e // 4 % 3, e // 12 % 3
        n = {0: 1 << e // 4 % 4, 1: b + 1, 2: a + 1, 3: a + b + 1}[kind]
        g = {"kind": kind, "lead": e // 5 % 4 if kind >= 2 else 0, "trail": e // 7 % 4 if kind % 2 else 0, "from_lead": [2] * a if kind >= 2 else [], "from_trail": [2] * b if kind % 2 else [], "pointer": e % (n + 1) if kind else 0, "fine": [e % 3 == 0] * n}
        r = Y.grid(Reader(written(Y.grid, dict(g)).data), {})
        assert r["fine"] == g["fine"] and r["pointer"] == g["pointer"]
        return [{"kind": kind, "envelopes": len(r["fine"]), "first": r["borders"][0], "last": r["borders"][-1], "middle": r["noise_borders"][1] if n > 1 else None}]

    return _event_rows(spark, sf_dir, f, "kind int, envelopes int, first int, last int, middle int")


@plan("b15_flags", "select event_id, bit_count((event_id % 32)::int) as envelope_time, event_id % 2 as noise_time, (event_id % 4) + (event_id // 4 % 4) + (event_id // 16 % 4) as modes, case when event_id % 3 = 0 then bit_count((event_id % 2048)::int) end as sinusoids from events")
def b15(spark, sf_dir):
    def f(e):
        r = {"envelope_time": [e >> k & 1 for k in range(5)], "noise_time": [e % 2, 0], "modes": [e % 4, e // 4 % 4, e // 16 % 4], "sinusoids": [e >> k & 1 for k in range(11)] if e % 3 == 0 else None}
        got = Y.flags(Reader(written(Y.flags, r, 5, 2, 3, 11).data), {}, 5, 2, 3, 11)
        return [{"envelope_time": sum(got["envelope_time"]), "noise_time": sum(got["noise_time"]), "modes": sum(got["modes"]), "sinusoids": None if got["sinusoids"] is None else sum(got["sinusoids"])}]

    return _event_rows(spark, sf_dir, f, "envelope_time int, noise_time int, modes int, sinusoids int")


def _delta_rows(e: int, bits: int, step: int):
    """Three envelopes of 5, 5 and 10 bands; the second and, for odd events, the third go over time."""
    rows = [[(e * (b + 3) + 7 * k) % 30 * step for b in range(n)] for k, n in enumerate((5, 5, 10))]
    over, sizes = [False, True, e % 2 == 1], [5, 5, 10]
    io = Writer()
    Y.deltas(io, rows, over, sizes, bits, K.by_rule()[K.STEPS], None, step)
    got = Y.deltas(Reader(io.data), [], over, sizes, bits, K.by_rule()[K.STEPS], None, step)
    return [{"envelope": k, "band": b, "value": v} for k, row in enumerate(got) for b, v in enumerate(row)]


def _delta_sql(step: int) -> str:
    return f"select event_id, k as envelope, b as band, (event_id * (b + 3) + 7 * k) % 30 * {step} as value from events, (select unnest([0, 1, 2]) as k), (select unnest(range(10)) as b) where b < case when k = 2 then 10 else 5 end"


@plan("b10_envelope_scalefactors", _delta_sql(1))
def b10(spark, sf_dir):
    """Steps over frequency and time, the third envelope at twice the resolution."""
    return _event_rows(spark, sf_dir, lambda e: _delta_rows(e, 7, 1), "envelope int, band int, value int")


@plan("b11_noise_floors", _delta_sql(2))
def b11(spark, sf_dir):
    """With a start value of 5 bits and steps of two, as in a pair's second channel."""
    return _event_rows(spark, sf_dir, lambda e: _delta_rows(e, 5, 2), "envelope int, band int, value int")


@plan("b2_band_layout", "select event_id, true as whole from events")
def b2(spark, sf_dir):
    """What must hold of a layout that can be derived: fine edges rise from the first band to the last, coarse and noise edges are some of them, and all begin and end alike."""

    def f(e):
        try:
            k0, k2 = R.ends(e // 9 % 16, e // 144 % 16, _RATES[e % 9])
            m = R.master(k0, k2, e % 4, e % 2 == 1)
            low, high = R.resolutions(m, e % 3)
            noise = R.noise_bands(low, e % 4)
        except ValueError:
            return [{"whole": True}]
        ends = {(int(x[0]), int(x[-1])) for x in (low, high, noise)}
        return [{"whole": bool((np.diff(m) > 0).all() or e % 4 > 0 and (np.diff(m) >= 0).all()) and m[0] == k0 and m[-1] == k2 and ends == {(int(high[0]), k2)} and set(low) <= set(high) and set(noise) <= set(low) and len(low) - 1 == (len(high) - 1 + 1) // 2}]

    return _event_rows(spark, sf_dir, f, "whole boolean")


@plan("s17_wav", f"with {PCM_SQL} select stream, 0 as channel, n, s as sample from pcm union all select stream, 1, n, -s // 1 - 1 from pcm")
def s17(spark, sf_dir):
    """A stream's samples as a file of two channels (the second with all bits turned), and read back from its bytes."""
    from pyspark.sql import functions as F

    from ..operators.streams import by_row

    x = pcm(spark, sf_dir).groupBy("stream", F.floor(F.col("n") / 65536).alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))

    def f(r):
        s = np.array([v["s"] for v in r["r"]])
        rate, back = parse_wav(write_wav(np.stack([s, ~s], axis=1), 44100))
        assert rate == 44100
        return [{"stream": r["stream"], "channel": c, "n": r["r"][0]["n"] + k, "sample": int(v)} for c in (0, 1) for k, v in enumerate(back[:, c])]

    return by_row(x, f, "stream string, channel int, n bigint, sample int")
