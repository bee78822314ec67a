"""Records of dynamic range control: written from known fields and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drc_records as D
from ..operators.bitio import Reader, Writer, written
from .registry import plan
from .syntax import _event_rows


def _loudness(e: int) -> dict:
    return {"drc_set": e % 64, "eq_set": e % 60, "downmix": e % 128, "sample_peak": e % 4096 if e % 2 else None, "true_peak": e * 3 % 4096 if e % 3 == 0 else None, "peak_system": e % 7, "peak_reliability": e % 4, "measures": [{"method": (e + k) % 10, "raw": (e * (k + 1)) % 4, "system": (e + k) % 7, "reliability": k % 4} for k in range(e % 16)]}


@plan("o19_loudness_record", "with e as (select event_id, event_id % 2 as version, event_id % 16 as n from events) select event_id, event_id % 64 as drc_set, event_id % 128 as downmix, case when event_id % 2 = 1 and event_id % 4096 <> 0 then 20 - (event_id % 4096) / 32.0 end as sample_peak, case when event_id % 3 = 0 and event_id * 3 % 4096 <> 0 then 20 - (event_id * 3 % 4096) / 32.0 end as true_peak, n as measures, len(list_filter(range(0, n), lambda k: (event_id + k) % 10 = 2)) > 0 as anchor, len(list_filter(range(0, n), lambda k: (event_id + k) % 7 = 5)) > 0 as expert, coalesce(list_sum(list_transform(range(0, n), lambda k: case (event_id + k) % 10 when 6 then (event_id * (k + 1) % 4) / 4.0 when 7 then event_id * (k + 1) % 4 + 80 when 8 then event_id * (k + 1) % 4 when 9 then (event_id * (k + 1) % 4) / 2.0 - 116 else (event_id * (k + 1) % 4) / 4.0 - 57.75 end)), 0)::double as total from e")
def o19(spark, sf_dir):
    """total: the sum of the measures' values."""

    def f(e):
        r = D.loudness(Reader(written(D.loudness, _loudness(e), e % 2).data), {}, e % 2)
        return [{"drc_set": r["drc_set"], "downmix": r["downmix"], "sample_peak": D.peak_db(r["sample_peak"]), "true_peak": D.peak_db(r["true_peak"]), "measures": len(r["measures"]), "anchor": r["anchor"], "expert": r["expert"], "total": float(sum(m["value"] for m in r["measures"]))}]

    return _event_rows(spark, sf_dir, f, "drc_set int, downmix int, sample_peak double, true_peak double, measures int, anchor boolean, expert boolean, total double")


@plan("o20_layout_record", "with e as (select event_id, event_id % 8 + 1 as channels, case when event_id % 3 > 0 then case when event_id % 3 = 1 then 0 else event_id % 256 end end as defined from events) select event_id, channels, defined, case when defined = 0 then channels else 0 end as positions, case when defined = 0 then len(list_filter(range(0, channels), lambda k: (event_id + k) % 128 in (3, 26))) else 0 end as low from e")
def o20(spark, sf_dir):
    def f(e):
        n = e % 8 + 1
        old = {"channels": n, "defined": [None, 0, e % 256][e % 3], "positions": [(e + k) % 128 for k in range(n)]}
        r = D.layout(Reader(written(D.layout, old).data), {}, n)
        return [{"channels": r["channels"], "defined": r["defined"], "positions": len(r["positions"]), "low": sum(r["low"])}]

    return _event_rows(spark, sf_dir, f, "channels int, defined int, positions int, low int")


def _values(rows: list[float]) -> str:
    return "(values " + ", ".join(f"({k}, {v})" for k, v in enumerate(rows)) + ")"


@plan(
    "o21_downmix_record",
    f"with v0(c, db) as {_values(D.DOWNMIX_V0)}, lo(c, db) as {_values(D.DOWNMIX_LOW)}, v1(c, db) as {_values(D.DOWNMIX_V1[:31])}, e as (select event_id, event_id % 2 as version, event_id // 2 % 4 as kind, 1 + event_id % 3 as target, 1 + event_id % 5 as base, unnest(range((1 + event_id % 3) * (1 + event_id % 5))) as k from events), c as (select e.*, case when version = 1 then v1.db when k % base = 2 then lo.db else v0.db end as db from e join v1 on v1.c = (event_id + k) % 31 join v0 on v0.c = (event_id + k) % 16 join lo on lo.c = (event_id + k) % 16), o as (select event_id, case when any_value(version) = 0 or any_value(kind) = 0 then 0 when any_value(kind) = 1 then 0.5 * floor(0.5 + 20 * log10(any_value(target) / any_value(base)::double)) when any_value(kind) = 2 then 0.5 * floor(0.5 + 40 * log10(any_value(target) / any_value(base)::double)) else 0.5 * floor(0.5 + 20 * log10(sum(pow(10, db / 10.0)))) end as plus from c group by 1) select event_id, k, round(pow(10, (db + plus) / 20.0), 7) as gain from c join o using (event_id)",
)
def o21(spark, sf_dir):
    """Gains of both versions, the third base channel being a low-frequency one."""

    def f(e):
        version, target, base = e % 2, 1 + e % 3, 1 + e % 5
        n = target * base
        low = [k == 2 for k in range(base)]
        old = {"id": e % 128, "target_channels": target, "target_layout": 7, "offset": e // 2 % 4, "codes": [(e + k) % (31 if version else 16) for k in range(n)]}
        r = D.downmix(Reader(written(D.downmix, old, version, base, low).data), {}, version, base, low)
        return [{"k": k, "gain": g} for k, g in enumerate(r["gains"])]

    return _event_rows(spark, sf_dir, f, "k int, gain double").select("event_id", "k", F.round("gain", 7).alias("gain"))


@plan("o23_gain_modifiers", "select event_id, k as band, case when version = 1 and event_id % 5 = 0 then (event_id + k) % 9 end as target, case when s then ((event_id + case when version = 1 then k else 0 end) % 256 // 16) / 8.0 end as attenuation, case when s then ((event_id + case when version = 1 then k else 0 end) % 16) / 8.0 end as amplification, case when event_id % 4 = 0 then case when (event_id + case when version = 1 then k else 0 end) % 64 >= 32 then -1 else 1 end * (1 + (event_id + case when version = 1 then k else 0 end) % 32) / 4.0 end as offset_db, case when version = 1 and event_id % 7 = 0 then event_id % 9 end as shape from (select event_id, event_id // 2 % 2 as version, event_id % 3 = 0 as s, unnest(range(case when event_id % 7 = 0 then 1 else 1 + event_id % 6 end)) as k from events)")
def o23(spark, sf_dir):
    """Version 0 has one modifier for all bands; only a single band has a shape filter."""

    def f(e):
        version, n = e // 2 % 2, 1 if e % 7 == 0 else 1 + e % 6
        old = {"bands": [{"left": (e + k) % 9 if e % 5 == 0 else None, "right": None, "scaling": (e + k) % 256 if e % 3 == 0 else None, "offset": (e + k) % 64 if e % 4 == 0 else None} for k in range(n)], "shape": e % 9 if e % 7 == 0 else None}
        r = D.modifiers(Reader(written(D.modifiers, old, version, n).data), {}, version, n)
        out = []
        for k, b in enumerate(r["bands"]):
            a, m = D.scaling_factors(b["scaling"]) or (None, None)
            out.append({"band": k, "target": b.get("left"), "attenuation": a, "amplification": m, "offset_db": D.offset_db(b["offset"]), "shape": r.get("shape")})
        return out

    return _event_rows(spark, sf_dir, f, "band int, target int, attenuation double, amplification double, offset_db double, shape int")


@plan("o24_gain_set", "with e as (select event_id, event_id // 3 % 2 as version, case when event_id % 4 = 3 then 1 else 1 + event_id % 8 end as n from events) select event_id, event_id % 4 as profile, event_id % 5 = 0 as full_frame, case when event_id % 7 = 0 then event_id % 2048 + 1 end as time_step, k as band, case when version = 1 then case when k >= 2 then 10 + k - 2 else event_id % 3 + 1 + k end else event_id % 3 + 1 + k end as sequence, case when n > 1 and k > 0 then case when event_id % 2 = 1 then (event_id + k) % 16 else (event_id + k) % 1024 end end as split from (select *, unnest(range(n)) as k from e)")
def o24(spark, sf_dir):
    """The counter goes on from event_id % 3; in version 1 the third band sets it to 10."""

    def f(e):
        version, n = e // 3 % 2, 1 if e % 4 == 3 else 1 + e % 8
        bands = [{"sequence": 10} if version and k == 2 else {} for k in range(n)]
        old = {"profile": e % 4, "full_frame": e % 5 == 0, "time_step": e % 2048 + 1 if e % 7 == 0 else None, "bands": bands, "crossover": e % 2 == 1, "split": [(e + k) % (16 if e % 2 else 1024) for k in range(1, n)]}
        io = Writer()
        D.gain_set(io, old, version, e % 3)
        r, _ = D.gain_set(Reader(io.data), {}, version, e % 3)
        return [{"profile": r["profile"], "full_frame": r["full_frame"], "time_step": r["time_step"], "band": k, "sequence": b["sequence"], "split": r["split"][k - 1] if k else None} for k, b in enumerate(r["bands"])]

    return _event_rows(spark, sf_dir, f, "profile int, full_frame boolean, time_step int, band int, sequence int, split int")
