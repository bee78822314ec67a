"""Coding choices, budgets, filters over lines, and whole encoders and decoders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import books as K
from ..functions.tables import SHORT_48, band_widths
from ..operators import coder as C
from ..operators import payload as P
from ..operators import streams as S
from ..operators.bitio import Reader, written
from ..operators.streams import by_row
from ..sources.signals import PCM_SQL, SPEC_SQL, pcm, spectra, table
from .registry import plan
from .syntax import _vector_rows, words_sql

RATE, BITRATE = 44100, 320_000
#: 16 bands of 4 lines over a vector.
BANDS = [4] * 16
_LENGTHS = C.word_lengths(K.by_rule())

# --- books and costs ----------------------------------------------------------------------------

_SHAPE = "(values " + ", ".join(f"({b}, {n}, {int(s)}, {m})" for b, (n, s, m) in K.SHAPES.items()) + ") as shape(book, dims, signed, most)"
#: Bits of each band (4 lines) in each book: tuples, signs, escapes.
_COST = f"""{words_sql(list(K.SHAPES))}, {SPEC_SQL}, q as (select vec_id, k, k // 4 as band, cast(round_even(x * {{scale}}, 0) as bigint) as q from sp),
top as (select vec_id, band, max(abs(q)) as m from q group by all),
sym as (select vec_id, band, book, k // dims as t, sum((case when signed = 1 then q + most else least(abs(q), most) end) * cast(pow(case when signed = 1 then 2 * most + 1 else most + 1 end, dims - 1 - k % dims) as bigint)) as symbol,
  sum(case when signed = 0 and q <> 0 then 1 else 0 end) + sum(case when book = 11 and abs(q) >= 16 then 2 * cast(floor(log2(abs(q))) as bigint) - 3 else 0 end) as more from q, {_SHAPE} group by all),
cost as (select vec_id, band, s.book, sum(n + more) as bits from sym s join words w on w.book = s.book and w.symbol = s.symbol group by all),
base as (select vec_id, band, case when m = 0 then 0 when m <= 1 then 1 when m <= 2 then 3 when m <= 4 then 5 when m <= 7 then 7 when m <= 12 then 9 else 11 end as base from top),
chosen as (select b.vec_id, b.band, case when base = 0 then 0 when d.bits is not null and d.bits < c.bits then base + 1 else base end as book, case when base = 0 then 0 when d.bits is not null and d.bits < c.bits then d.bits else c.bits end as bits
  from base b left join cost c on c.vec_id = b.vec_id and c.band = b.band and c.book = base left join cost d on base < 11 and d.vec_id = b.vec_id and d.band = b.band and d.book = base + 1)"""


@plan("h10_choose_book", f"with {_COST.format(scale=30)} select vec_id, band, book, bits from chosen")
def h10(spark, sf_dir):
    def f(_, q):
        book, bits = C.choose_books(np.array(q), BANDS, _LENGTHS)
        return [{"band": k, "book": int(x), "bits": int(y)} for k, (x, y) in enumerate(zip(book, bits, strict=True))]

    return _vector_rows(spark, sf_dir, f, "band int, book int, bits int")


@plan("h11_band_write", f"with {_COST.format(scale=90)} select vec_id, band, bits from chosen")
def h11(spark, sf_dir):
    """Bits that are written for a band in its book, escapes included."""

    def f(_, q):
        book, _bits = C.choose_books(np.array(q), BANDS, _LENGTHS)
        out = []
        for k, x in enumerate(book.tolist()):
            n = K.SHAPES[x][0] if x else 4
            put = lambda io, v, n=n, x=x: [P.values(io, x, tuple(v[j : j + n]), K.by_rule()) for j in range(0, 4, n)] if x else None
            out.append({"band": k, "bits": written(put, q[4 * k : 4 * k + 4]).size})
        return out

    return _vector_rows(spark, sf_dir, f, "band int, bits int", 90)


@plan(
    "h12_side_cost",
    f"with {_COST.format(scale=30)}, w0 as (select symbol, n from ({'select * from words'}) where book = 1), steps(symbol, n) as (values {', '.join(f'({s}, {K.by_rule()[K.STEPS].code[s][1]})' for s in range(121))}), sf as (select *, (vec_id * 7 + band * band * 5) % 90 + 60 as sf from chosen), runs as (select vec_id, sum(case when band = 0 or book <> prev then 1 else 0 end) * 9 as bits from (select *, lag(book) over (partition by vec_id order by band) as prev from sf) group by 1), d as (select vec_id, coalesce(sf - lag(sf) over (partition by vec_id order by band), 0) as step from sf where book > 0), ds as (select vec_id, sum(coalesce(n, 19)) as bits from d left join steps on symbol = step + 60 group by 1) select runs.vec_id, runs.bits + coalesce(ds.bits, 0) as bits from runs left join ds using (vec_id)",
)
def h12(spark, sf_dir):
    """Runs of books and words of scalefactor steps; a step beyond the book counts 19."""

    def f(v, q):
        book, _ = C.choose_books(np.array(q), BANDS, _LENGTHS)
        sf = np.array([(v * 7 + b * b * 5) % 90 + 60 for b in range(16)])
        return [{"bits": C.side_cost(book, sf, _LENGTHS)}]

    return _vector_rows(spark, sf_dir, f, "bits int")


# --- filters over lines -------------------------------------------------------------------------


@plan("d8_step_up", f"with {SPEC_SQL}, r as (select vec_id, max(x) filter (where k = 0) * 2 as a, max(x) filter (where k = 1) * 2 as b, max(x) filter (where k = 2) * 2 as c from sp group by 1) select vec_id, round(a + a * b + b * c, 8) as c1, round(b + c * (a + a * b), 8) as c2, round(c, 8) as c3 from r")
def d8(spark, sf_dir):
    """Direct-form coefficients of three reflection coefficients."""
    a, b, c = (F.get("x", F.lit(k)) * 2 for k in range(3))
    rows = by_row(spectra(spark, sf_dir).select("vec_id", F.array(a, b, c).alias("r")), lambda r: [{"vec_id": r["vec_id"], **{f"c{k}": float(v) for k, v in enumerate(C.step_up(r["r"])) if k}}], "vec_id bigint, c1 double, c2 double, c3 double")
    return rows.select("vec_id", *[F.round(f"c{k}", 8).alias(f"c{k}") for k in (1, 2, 3)])


_TILED = f"with {SPEC_SQL} select vec_id, r * 64 + k as line, round(x * (1000 + r), 4) as x from sp, (select unnest(range(16)) as r)"


def _tiled(r: dict) -> np.ndarray:
    return np.concatenate([np.array(r["x"]) * (1000 + k) for k in range(16)])


@plan("d12_filters_apply", _TILED)
def d12(spark, sf_dir):
    """Lines through the encoder's filter, and back through the decoder's: the lines."""

    def f(r):
        x = _tiled(r)
        shaped, found = C.shape_lines(x, RATE, 49, least_gain=0.0)
        spec = shaped[None].copy()
        C.unshape(spec, {"window": {"sequence": 0, "max_band": 49}, "filters": found}, RATE)
        return [{"vec_id": r["vec_id"], "line": k, "x": float(v)} for k, v in enumerate(spec[0])]

    return by_row(spectra(spark, sf_dir), f, "vec_id bigint, line int, x double").select("vec_id", "line", (F.round("x", 4) + 0.0).alias("x"))


@plan("a27_line_predictor", f"with {SPEC_SQL}, r as (select vec_id, sum(x * x) as r0, sum(x * p1) * exp(-0.0002) as r1, sum(x * p2) * exp(-0.0008) as r2 from (select *, lag(x, 1, 0) over w as p1, lag(x, 2, 0) over w as p2 from sp window w as (partition by vec_id order by k)) group by 1), a as (select *, greatest(-0.99, least(0.99, -r1 / r0)) as a1 from r), b as (select *, r0 * (1 - a1 * a1) as err from a), c as (select *, greatest(-0.99, least(0.99, -(r2 + a1 * r1) / err)) as a2 from b) select vec_id, round(a1, 6) as first, round(a2, 6) as second, round(r0 / (err * (1 - a2 * a2)), 6) as gain from c")
def a27(spark, sf_dir):
    """Two reflection coefficients of a vector's lines, and the prediction gain."""

    def f(r):
        parcor, gain = C.predictor(np.array(r["x"]), 2)
        return [{"vec_id": r["vec_id"], "first": float(parcor[0]), "second": float(parcor[1]), "gain": gain}]

    got = by_row(spectra(spark, sf_dir), f, "vec_id bigint, first double, second double, gain double")
    return got.select("vec_id", *[F.round(c, 6).alias(c) for c in ("first", "second", "gain")])


@plan("a26_filter_choice", f"with {SPEC_SQL} select distinct vec_id, true as angles, true as shorter, true as from_1500 from sp")
def a26(spark, sf_dir):
    """What must hold of each encoder filter: angles of 4 bits, order at most 12, starts at 1500 Hz; a filter that is used lessens the energy."""

    def f(r):
        x = _tiled(r)
        shaped, found = C.shape_lines(x, RATE, 49)
        of = found[0]["of"][0] if found else {"coefficients": [], "order": 0, "length": 0}
        first = int(np.searchsorted(np.cumsum([0, *band_widths(RATE, False)]), 1500 * 2 * 1024 / RATE))
        return [{"vec_id": r["vec_id"], "angles": all(-8 <= c <= 7 for c in of["coefficients"]) and of["order"] <= 12, "shorter": not found or bool((shaped**2).sum() < (x**2).sum()), "from_1500": not found or of["length"] == 49 - first}]

    return by_row(spectra(spark, sf_dir), f, "vec_id bigint, angles boolean, shorter boolean, from_1500 boolean")


# --- budgets ------------------------------------------------------------------------------------


def _block(r: dict) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([r["x"], r["x"]]) * 4000.0
    energy = np.add.reduceat(x * x, np.cumsum([0, *SHORT_48])[:-1])
    return x, energy * 10**-1.3


@plan("a21_attempt", f"with {SPEC_SQL} select distinct vec_id, l as lift, true as representable, true as near, true as allowed from sp, (select unnest([-20, 0, 15]) as l)")
def a21(spark, sf_dir):
    """What must hold of an attempt: every line within 8191, scalefactors within 60 of the lowest coded one, bits as its books and steps cost."""

    def f(r):
        x, t = _block(r)
        out = []
        for lift in (-20, 0, 15):
            a = C.attempt(x, SHORT_48, t, lift, _LENGTHS)
            coded = a["sf"][a["book"] > 0]
            _, bits = C.choose_books(a["q"], SHORT_48, _LENGTHS)
            out.append({"vec_id": r["vec_id"], "lift": lift, "representable": bool(np.abs(a["q"]).max() <= 8191), "near": len(coded) == 0 or bool(coded.max() - coded.min() <= 60), "allowed": a["bits"] == int(bits.sum()) + C.side_cost(a["book"], a["sf"], _LENGTHS)})
        return out

    return by_row(spectra(spark, sf_dir), f, "vec_id bigint, lift int, representable boolean, near boolean, allowed boolean")


@plan("a22_fit", f"with {SPEC_SQL} select distinct vec_id, b as budget, true as kept, true as tight from sp, (select unnest([150, 300, 600]) as b)")
def a22(spark, sf_dir):
    """The budget is kept, and a lift at most 0.35 dB less was tried and broke it (or the least lift is reached)."""

    def f(r):
        x, t = _block(r)
        out = []
        for b in (150, 300, 600):
            g = C.fit(x, SHORT_48, t, b, _LENGTHS)
            tight = g["lift"] <= -80 or 0 < g["lift"] - g["broke"] <= 0.35 and C.attempt(x, SHORT_48, t, g["broke"], _LENGTHS)["bits"] > b
            out.append({"vec_id": r["vec_id"], "budget": b, "kept": g["bits"] <= b, "tight": tight})
        return out

    return by_row(spectra(spark, sf_dir), f, "vec_id bigint, budget int, kept boolean, tight boolean")


@plan("a24_budget_split", "select event_id, cast(floor(2000 * (event_id % 50) / cast(event_id % 50 + event_id % 7 + 1 as double)) as bigint) as first, cast(floor(2000 * (event_id % 7 + 1) / cast(event_id % 50 + event_id % 7 + 1 as double)) as bigint) as second from events".replace("floor(2000 * (event_id % 50) / cast(event_id % 50 + event_id % 7 + 1 as double))", "floor(2000 * ((event_id % 50) / cast(event_id % 50 + event_id % 7 + 1 as double)))").replace("floor(2000 * (event_id % 7 + 1) / cast(event_id % 50 + event_id % 7 + 1 as double))", "floor(2000 * ((event_id % 7 + 1) / cast(event_id % 50 + event_id % 7 + 1 as double)))"))
def a24(spark, sf_dir):
    """A frame's bits by its channels' perceptual entropy."""
    a, b = F.col("event_id") % 50, F.col("event_id") % 7 + 1
    share = lambda x: F.floor(2000 * (x / (a + b).cast("double")))
    return table(spark, sf_dir, "events").select("event_id", share(a).alias("first"), share(b).alias("second"))


# --- whole streams ------------------------------------------------------------------------------


def _source(spark, sf_dir) -> DataFrame:
    """Streams in two channels: a stream's samples, and the same halved and turned over."""
    x = S.framed(pcm(spark, sf_dir))
    return x.select("stream", "f", "x", F.transform("x", lambda v: v * -0.5).alias("y"))


def _encoded(spark, sf_dir, shaping: bool = True) -> DataFrame:
    return S.encode(["x", "y"], RATE, BITRATE, shaping=shaping)(_source(spark, sf_dir))


#: Frames that a stream has, with the one that closes it.
_FRAMES = f"{PCM_SQL}, n as (select stream, max(n) // 1024 + 2 as frames from pcm group by 1), fr as (select stream, unnest(range(frames)) as f from n)"


@plan("a29_encode_frames", f"with {_FRAMES} select stream, f, true as whole, true as kept from fr")
def a29(spark, sf_dir):
    """A payload for each frame and the closing one; each parses, and keeps the bit rate."""
    most = BITRATE * 1024 // RATE // 8 + 1

    def f(r):
        got = P.block(Reader(r["payload"]), [], RATE, K.by_rule())
        return [{"stream": r["stream"], "f": r["f"], "whole": [e["kind"] for e in got] == [P.PAIR], "kept": len(r["payload"]) <= most}]

    return by_row(_encoded(spark, sf_dir), f, "stream string, f bigint, whole boolean, kept boolean")


def _fidelity(decoded: DataFrame, source: DataFrame, least: float = 10.0) -> DataFrame:
    """stream, f, channel, good: whether a frame's decoded samples are within `least` dB of its own (all silent: within 16 steps)."""
    want = source.select("stream", (F.col("f") + 1).alias("f"), F.posexplode(F.array("x", "y")).alias("channel", "x"))
    met = decoded.join(want, ["stream", "f", "channel"])
    off = F.zip_with("samples", "x", lambda a, b: a - b)
    power = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    good = F.col("error").isNull() & ((power(off) * 10 ** (least / 10) <= power(F.col("x"))) | (power(off) <= 1024 * 256))
    return met.select("stream", "f", "channel", good.alias("good"))


_DECODED = f"with {_FRAMES} select stream, f + 1 as f, channel, true as good from fr, (select unnest([0, 1]) as channel) where f + 1 < (select frames from n where n.stream = fr.stream)"


@plan("d16_frame_decode", _DECODED)
def d16(spark, sf_dir):
    """Payloads to samples; every frame must resemble its source.

    Without filters over lines: those move noise to where it is masked, which
    costs likeness by this measure.
    """
    return _fidelity(S.decode(RATE)(_encoded(spark, sf_dir, False)), _source(spark, sf_dir))


@plan("d18_parallel_decode", _DECODED.replace("true as good", "true as equal"))
def d18(spark, sf_dir):
    """Frame by frame in parallel, and the stream as a whole one after another: the same samples.

    Whole streams are put together here to have something to compare with.
    """
    frames = _encoded(spark, sf_dir)
    alone = S.decode(RATE)(frames).where("f > 0").select("stream", "f", "channel", "samples")
    streams = frames.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("f", "payload"))).alias("p")).select("stream", F.col("p.payload").alias("p"))

    def f(r):
        x = S.decode_whole(r["p"], RATE)
        return [{"stream": r["stream"], "f": k, "channel": c, "whole": x[c, 1024 * k : 1024 * k + 1024].astype(int).tolist()} for k in range(1, len(r["p"])) for c in range(len(x))]

    whole = by_row(streams, f, "stream string, f bigint, channel int, whole array<int>")
    return alone.join(whole, ["stream", "f", "channel"]).select("stream", "f", "channel", (F.col("samples") == F.col("whole")).alias("equal"))


@plan("d17_stream_decode", f"with {_FRAMES} select stream, cast(max(f) * 1024 as bigint) as samples, 2 as channels, true as good from fr group by 1")
def d17(spark, sf_dir):
    """A stream after another: number of samples, and fidelity of the whole (as in d16)."""
    frames = _encoded(spark, sf_dir, False).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("f", "payload"))).alias("p")).select("stream", F.col("p.payload").alias("p"))
    own = S.framed(pcm(spark, sf_dir)).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("x")).select("stream", F.flatten("x.x").alias("x"))

    def f(r):
        y, x = S.decode_whole(r["p"], RATE)[:, 1024:], np.array(r["x"])
        off = y[0] - x[: y.shape[1]]
        return [{"stream": r["stream"], "samples": y.shape[1], "channels": len(y), "good": bool((off**2).sum() * 10 <= (x**2).sum())}]

    return by_row(frames.join(own, "stream"), f, "stream string, samples bigint, channels int, good boolean")


@plan("d19_seek", f"with {_FRAMES} select stream, f, channel, true as equal from fr, (select unnest([0, 1]) as channel) where f >= 2")
def d19(spark, sf_dir):
    """Decoding that starts at frame 1 gives, from frame 2 on, what the whole stream gives."""
    frames = _encoded(spark, sf_dir)
    late = S.decode(RATE)(frames.where("f >= 1")).where("f >= 2").select("stream", "f", "channel", F.col("samples").alias("late"))
    return S.decode(RATE)(frames).join(late, ["stream", "f", "channel"]).select("stream", "f", "channel", (F.col("samples") == F.col("late")).alias("equal"))


@plan("a30_chunk_encode", f"with {PCM_SQL}, c as (select stream, n // 2048 as chunk, max(n) as last from pcm group by all) select stream, chunk, unnest(range((last - chunk * 2048) // 1024 + 2)) as f, true as read from c")
def a30(spark, sf_dir):
    """Chunks of two frames, each encoded by itself from silence and closed by itself."""
    x = pcm(spark, sf_dir).select(F.struct("stream", F.floor(F.col("n") / 2048).alias("chunk")).alias("stream"), (F.col("n") % 2048).alias("n"), "s")
    named = x.withColumn("stream", F.concat_ws("|", "stream.stream", "stream.chunk"))
    got = S.elements(S.encode(["x"], RATE, BITRATE)(S.framed(named)), RATE)
    return got.select(F.substring_index("stream", "|", 1).alias("stream"), F.substring_index("stream", "|", -1).cast("bigint").alias("chunk"), "f", (F.col("error").isNull() & (F.col("channels") == 1)).alias("read"))


@plan("d20_band_dequantise", f"with {SPEC_SQL} select vec_id, k, round(sign(q) * pow(abs(q), 4.0 / 3) * pow(2.0, (90 + vec_id % 20 - 100) / 4.0), 6) as x from (select vec_id, k, round_even(x * 30, 0) as q from sp)")
def d20(spark, sf_dir):
    """Another name for the band form."""
    from ..functions.quant import dequantise

    q = spectra(spark, sf_dir).select("vec_id", F.posexplode(F.transform("x", lambda v: F.rint(v * 30))).alias("k", "q"))
    return q.select("vec_id", "k", (F.round(dequantise(F.col("q"), (90 + F.col("vec_id") % 20).cast("int")), 6) + 0.0).alias("x"))


@plan("t24_table_windows", "select k, round(sin(pi() * (k + 0.5) / 256), 12) as w, cast(least(2147483647, round(sin(pi() * (k + 0.5) / 256) * 2147483648)) as bigint) as fixed from (select unnest(range(256)) as k)")
def t24(spark, sf_dir):
    """The sine window as doubles and as Q31 integers."""
    w = F.sin(F.lit(np.pi) * (F.col("id") + 0.5) / 256)
    return spark.range(256).select(F.col("id").alias("k"), F.round(w, 12).alias("w"), F.least(F.lit(2147483647), F.round(w * 2147483648).cast("bigint")).alias("fixed"))


@plan("unsupported_features", "select event_id, case event_id % 4 when 0 then 'Unsupported: coupling channels' when 1 then 'Unsupported: prediction' when 2 then 'Unsupported: gain control' else 'Truncated: ' end as error from events")
def unsupported(spark, sf_dir):
    """Payloads that ask for what is not implemented, or break off, give their error as a row."""

    def payload(r):
        e = r["event_id"]
        from ..operators.bitio import Writer

        io = Writer()
        if e % 4 == 0:
            io.u(3, P.COUPLING)
        else:
            io.u(3, P.SINGLE), io.u(4, 0), io.u(8, 100)
            if e % 4 == 1:
                io.u(10, 0), io.u(1, 1)
            elif e % 4 == 2:
                io.u(11, 0), io.u(2, 0), io.u(1, 1)
        return [{"stream": e, "f": 0, "payload": io.data}]

    frames = by_row(table(spark, sf_dir, "events").select("event_id"), payload, "stream bigint, f bigint, payload binary")
    got = S.elements(frames, 48000)
    return got.select(F.col("stream").alias("event_id"), F.regexp_extract("error", "^(Unsupported: .*|Truncated: )", 1).alias("error"))
