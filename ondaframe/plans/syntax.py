"""Bits, headers, configurations and elements: written, read back, and held against SQL that puts the same bits together as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import books as K
from ..functions.tables import FILTER_BANDS, RATES
from ..operators import headers as H
from ..operators import payload as P
from ..operators.bitio import Reader, Writer, written
from ..operators.streams import by_row
from ..sources.signals import SPEC_SQL, spectra, table
from .registry import plan


def b(expr, n: int) -> str:
    """SQL: a number as n bits of text."""
    return f"lpad(bin(cast({expr} as bigint)), {n}, '0')"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id")


def _event_rows(spark, sf_dir, f, schema: str):
    return by_row(_events(spark, sf_dir), lambda r: [{"event_id": r["event_id"], **x} for x in f(r["event_id"])], f"event_id bigint, {schema}")


_HZ = "(case event_id % 13 " + " ".join(f"when {k} then {r}" for k, r in enumerate(RATES)) + " end)"


# --- bits ---------------------------------------------------------------------------------------


def _eight(e: int) -> Reader:
    return Reader(e.to_bytes(8, "big") * 8)


@plan("s20_skip_align", "select event_id, (event_id % 50 + 7) // 8 * 8 as at, (event_id >> (56 - 8 * (((event_id % 50 + 7) // 8) % 8))) & 255 as byte from events")
def s20(spark, sf_dir):
    """A cursor skips, goes on to a whole byte, and reads it."""

    def f(e):
        io = _eight(e)
        io.skip(e % 50)
        io.align()
        return [{"at": io.at, "byte": io.u(8)}]

    return _event_rows(spark, sf_dir, f, "at bigint, byte bigint")


@plan("s21_bit_write", f"select event_id, {b('event_id % 8', 3)} || {b('event_id % 1024', 10)} || {b('event_id % 2', 1)} || {b('event_id * event_id % 1099511627776', 40)} as bits from events")
def s21(spark, sf_dir):
    def f(e):
        io = Writer()
        for n, v in ((3, e % 8), (10, e % 1024), (1, e % 2), (40, e * e % (1 << 40))):
            io.u(n, v)
        return [{"bits": io.bits}]

    return _event_rows(spark, sf_dir, f, "bits string")


@plan("s22_byte_align", f"select event_id, n, ones, {b('event_id % 2', 1)} || repeat('1', n) || repeat(case when ones then '1' else '0' end, 7 - n) as bits from events, (select unnest(range(8)) as n), (select unnest([true, false]) as ones)")
def s22(spark, sf_dir):
    def f(e):
        out = []
        for n in range(8):
            for ones in (True, False):
                io = Writer()
                io.u(1, e % 2)
                io.u(n, (1 << n) - 1)
                io.align(ones)
                out.append({"n": n, "ones": ones, "bits": io.bits})
        return out

    return _event_rows(spark, sf_dir, f, "n int, ones boolean, bits string")


# --- headers and configurations -----------------------------------------------------------------


def _config(e: int) -> dict:
    """Rates of the table, and every seventh one of 24 bits."""
    return {"object_type": 42 if e % 11 == 0 else 2, "rate": 40000 + e % 1000 if e % 7 == 0 else RATES[e % 13], "channels": e % 8, "short_frames": e % 3 == 0, "core_delay": e % 16384 if e % 5 == 0 else None}


_RATE = f"(case when event_id % 7 = 0 then 40000 + event_id % 1000 else {_HZ} end)"
# 44000 is no rate of the table, so no 24-bit rate has an index
_CONFIG_BITS = f"(case when event_id % 11 = 0 then '11111' || {b('10', 6)} else '00010' end || case when event_id % 7 = 0 and 40000 + event_id % 1000 not in (44100, 48000) then '1111' || {b('40000 + event_id % 1000', 24)} else {b('event_id % 13', 4)} end || {b('event_id % 8', 4)} || case when event_id % 3 = 0 then '1' else '0' end || case when event_id % 5 = 0 then '1' || {b('event_id % 16384', 14)} else '0' end || '0')"


@plan("s11_config_write", f"select event_id, {_CONFIG_BITS} as bits from events")
def s11(spark, sf_dir):
    return _event_rows(spark, sf_dir, lambda e: [{"bits": written(H.config, _config(e)).bits}], "bits string")


@plan("s10_config_parse", f"select event_id, case when event_id % 11 = 0 then 42 when event_id % 4 = 1 then 5 when event_id % 4 = 3 then 29 else 2 end as object_type, {_RATE} as rate, event_id % 8 as channels, event_id % 3 = 0 as short_frames, case when event_id % 5 = 0 then event_id % 16384 end as core_delay, event_id % 11 <> 0 and event_id % 2 = 1 as replication, case when event_id % 11 <> 0 and event_id % 2 = 1 then 48000 end as extension_rate from events")
def s10(spark, sf_dir):
    """Also configurations that signal an extension in front of the base type."""

    def f(e):
        c, io = _config(e), Writer()
        kind = c["object_type"] if c["object_type"] == 42 or e % 2 == 0 else 5 if e % 4 == 1 else 29
        H._object_type(io, kind)
        H._rate(io, c["rate"])
        io.u(4, c["channels"])
        if kind in (5, 29):
            io.u(4, 3), io.u(5, 2)
        io.u(1, c["short_frames"])
        if io.u(1, c["core_delay"] is not None):
            io.u(14, c["core_delay"])
        io.u(1, 0)
        return [H.config(Reader(io.data), {})]

    return _event_rows(spark, sf_dir, f, "object_type int, rate int, channels int, short_frames boolean, core_delay int, replication boolean, extension_rate int")


def _adif(e: int) -> dict:
    return {"copyright": f"{e % 256:02x}" * 9 if e % 4 == 0 else None, "original": e % 2 == 0, "home": e % 5 == 0, "variable": e % 3 == 0, "bitrate": e * 37 % (1 << 23), "fullness": None if e % 3 == 0 else e * 11 % (1 << 20), "configs": [{"rate": RATES[e % 13], "channels": 2}, {"rate": 44100, "channels": 1}][: 1 + e % 2]}


def _flag(condition: str) -> str:
    return f"case when {condition} then '1' else '0' end"


@plan(
    "s6_adif_write",
    f"select event_id, '01000001010001000100100101000110' || case when event_id % 4 = 0 then '1' || repeat({b('event_id % 256', 8)}, 9) else '0' end || {_flag('event_id % 2 = 0')} || {_flag('event_id % 5 = 0')} || {_flag('event_id % 3 = 0')} || {b('event_id * 37 % 8388608', 23)} || {b('event_id % 2', 4)} || case when event_id % 3 = 0 then '' else {b('event_id * 11 % 1048576', 20)} end || '00010' || {b('event_id % 13', 4)} || '0010000' || case when event_id % 2 = 1 then '0001001000001000' else '' end as bits from events",
)
def s6(spark, sf_dir):
    return _event_rows(spark, sf_dir, lambda e: [{"bits": written(H.adif, _adif(e)).bits}], "bits string")


@plan("s5_adif_parse", f"select event_id, case when event_id % 4 = 0 then repeat(lpad(lower(to_hex(event_id % 256)), 2, '0'), 9) end as copyright, event_id % 2 = 0 as original, event_id % 5 = 0 as home, event_id % 3 = 0 as variable, event_id * 37 % 8388608 as bitrate, case when event_id % 3 <> 0 then event_id * 11 % 1048576 end as fullness, 1 + event_id % 2 as configs, {_HZ} as rate, 2 as channels from events")
def s5(spark, sf_dir):
    def f(e):
        h = H.adif(Reader(written(H.adif, _adif(e)).data), {})
        return [h | {"rate": h["configs"][0]["rate"], "channels": h["configs"][0]["channels"], "configs": len(h["configs"])}]

    return _event_rows(spark, sf_dir, f, "copyright string, original boolean, home boolean, variable boolean, bitrate int, fullness int, configs int, rate int, channels int")


def _mux(e: int) -> dict:
    return {"version": e % 2, "same_framing": e % 3 == 0, "subframes": e % 64 + 1, "programs": e % 16 + 1, "layers": e % 8 + 1, "config": {"rate": RATES[e % 13], "channels": e % 8}}


_MUX_BITS = f"({b('event_id % 2', 1)} || {_flag('event_id % 3 = 0')} || {b('event_id % 64', 6)} || {b('event_id % 16', 4)} || {b('event_id % 8', 3)} || '00010' || {b('event_id % 13', 4)} || {b('event_id % 8', 4)} || '000')"


@plan("s9_mux_parse", f"select event_id, event_id % 2 as version, event_id % 3 = 0 as same_framing, event_id % 64 + 1 as subframes, event_id % 16 + 1 as programs, event_id % 8 + 1 as layers, {_HZ} as rate from events")
def s9(spark, sf_dir):
    def f(e):
        m = H.mux(Reader(written(H.mux, _mux(e)).data), {})
        return [m | {"rate": m["config"]["rate"]}]

    return _event_rows(spark, sf_dir, f, "version int, same_framing boolean, subframes int, programs int, layers int, rate int")


def _loas(e: int) -> dict:
    return {"mux": _mux(e) if e % 2 else None, "payload": f"{e % 256:02x}" * (e % 9)}


@plan("s8_loas_write", f"select event_id, '01010110111' || {b('event_id % 9 + case when event_id % 2 = 1 then 4 else 1 end', 13)} || case when event_id % 2 = 1 then '1' || {_MUX_BITS} else '0' end || repeat({b('event_id % 256', 8)}, cast(event_id % 9 as integer)) as bits from events")
def s8(spark, sf_dir):
    return _event_rows(spark, sf_dir, lambda e: [{"bits": written(H.loas, _loas(e)).bits}], "bits string")


@plan("s7_loas_parse", "select event_id, event_id % 9 + case when event_id % 2 = 1 then 4 else 1 end as length, case when event_id % 2 = 1 then event_id % 64 + 1 end as subframes, repeat(lpad(lower(to_hex(event_id % 256)), 2, '0'), cast(event_id % 9 as integer)) as payload from events")
def s7(spark, sf_dir):
    def f(e):
        x = H.loas(Reader(written(H.loas, _loas(e)).data), {})
        return [{"length": x["length"], "subframes": x["mux"] and x["mux"]["subframes"], "payload": x["payload"]}]

    return _event_rows(spark, sf_dir, f, "length int, subframes int, payload string")


def _program(e: int) -> dict:
    return {"tag": e % 16, "object_type": e % 4 + 1, "rate": RATES[e % 13], "front": [[k % 2, (e + k) % 16] for k in range(e % 4)], "side": [[1, e % 16]] * (e % 2), "back": [[0, k] for k in range(e % 3)], "low": [e % 16] * (e % 4), "data_elements": e % 8, "coupling_elements": e % 16, "mono_mixdown": e % 16 if e % 2 else None, "stereo_mixdown": None, "matrix_mixdown": [e % 4, 1] if e % 5 == 0 else None}


_TAGS = "list_aggregate(list_transform(range(0, event_id % 4), lambda k: {}), 'string_agg', '')"


@plan(
    "s12_program_config",
    f"select event_id, {b('event_id % 16', 4)} || {b('event_id % 4', 2)} || {b('event_id % 13', 4)} || {b('event_id % 4', 4)} || {b('event_id % 2', 4)} || {b('event_id % 3', 4)} || {b('event_id % 4', 2)} || {b('event_id % 8', 3)} || {b('event_id % 16', 4)} || case when event_id % 2 = 1 then '1' || {b('event_id % 16', 4)} else '0' end || '0' || case when event_id % 5 = 0 then '1' || {b('event_id % 4', 2)} || '1' else '0' end"
    f" || coalesce({_TAGS.format('(case when k % 2 = 1 then ' + chr(39) + '1' + chr(39) + ' else ' + chr(39) + '0' + chr(39) + ' end) || ' + b('(event_id + k) % 16', 4))}, '') || repeat('1' || {b('event_id % 16', 4)}, cast(event_id % 2 as integer)) || case event_id % 3 when 0 then '' when 1 then '00000' else '0000000001' end || repeat({b('event_id % 16', 4)}, cast(event_id % 4 as integer)) as bits, event_id % 16 as tag, {_HZ} as rate, event_id % 4 as front, event_id % 3 as back, case when event_id % 2 = 1 then event_id % 16 end as mono_mixdown from events",
)
def s12(spark, sf_dir):
    def f(e):
        io = written(H.program, _program(e))
        p = H.program(Reader(io.data), {})
        assert p == _program(e)
        return [{"bits": io.bits, "tag": p["tag"], "rate": p["rate"], "front": len(p["front"]), "back": len(p["back"]), "mono_mixdown": p["mono_mixdown"]}]

    return _event_rows(spark, sf_dir, f, "bits string, tag int, rate int, front int, back int, mono_mixdown int")


@plan("s13_raw_frame", f"select event_id, {_HZ} as rate, event_id % 40 as size from events")
def s13(spark, sf_dir):
    """A frame and its configuration are a struct of columns."""
    rates = F.array(*map(F.lit, RATES))
    frame = F.struct(F.get(rates, (F.col("event_id") % 13).cast("int")).alias("rate"), F.unhex(F.repeat(F.lit("00"), (F.col("event_id") % 40).cast("int"))).alias("payload"))
    return _events(spark, sf_dir).select("event_id", frame.alias("raw")).select("event_id", "raw.rate", F.octet_length("raw.payload").alias("size"))


@plan("s16_container_sniff", "select event_id, case event_id % 6 when 0 then 'adif' when 1 then 'private' when 2 then 'loas' when 3 then 'adts' else 'raw' end as kind from events")
def s16(spark, sf_dir):
    """By the first bytes; the last two kinds are another word and an empty stream."""
    heads = ["41444946", "56555343", "56E0", "FFF1", "52494646", ""]
    head = F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("event_id") % 6).cast("int")))
    first = F.hex(F.substring(head, 1, 4))
    two = F.conv(F.substring(first, 1, 4), 16, 10).cast("int")
    is_two = F.length(first) >= 4
    kind = F.when(first == "41444946", "adif").when(first == "56555343", "private").when(is_two & (F.shiftright(two, 5) == H.SYNC), "loas").when(is_two & (F.shiftright(two, 4) == 0xFFF), "adts").otherwise("raw")
    return _events(spark, sf_dir).select("event_id", kind.alias("kind"))


# --- elements -----------------------------------------------------------------------------------

_BOOKS = K.by_rule


def _silent(gain: int) -> dict:
    return {"gain": gain, "window": {"sequence": 0, "shape": 0, "max_band": 0, "groups": [1]}, "books": [[]], "scales": [[]], "pulse": None, "filters": None, "lines": [0] * P.LINES}


def _elements(e: int) -> list[dict]:
    out = [{"kind": P.SINGLE, "tag": e % 16, "channels": [_silent(e % 256)]}]
    out += [{"kind": P.DATA, "tag": k, "aligned": k == 1, "payload": "5a" * (e % 600 % 510)} for k in range(e % 3)]
    out += [{"kind": P.FILL, "payload": "a5" * (e % 269)}] * (e % 2)
    return [*out, {"kind": P.LOW, "tag": 3, "channels": [_silent(1)]}]


@plan("s29_elements", "with e as (select event_id, event_id % 3 as d, event_id % 2 as l from events), r as (select *, unnest(range(2 + d + l)) as place from e) select event_id, place, case when place = 0 then 0 when place <= d then 4 when place = 1 + d + l then 3 else 6 end as kind, case when place = 0 then event_id % 16 when place <= d then place - 1 when place = 1 + d + l then 3 end as tag, case when place = 0 or place = 1 + d + l then 0 when place <= d then event_id % 600 % 510 else event_id % 269 end as size from r")
def s29(spark, sf_dir):
    """Each element of a block, up to the end mark."""

    def f(e):
        got = P.block(Reader(written(P.block, _elements(e), 48000, _BOOKS()).data), [], 48000, _BOOKS())
        return [{"place": k, "kind": x["kind"], "tag": x.get("tag"), "size": len(x.get("payload", "")) // 2} for k, x in enumerate(got)]

    return _event_rows(spark, sf_dir, f, "place int, kind int, tag int, size int")


def _bits_of(e: dict) -> int:
    return written(P.element, e, 48000, _BOOKS()).size


@plan("s30_fill_element", "select event_id, event_id % 270 as size, 7 + case when event_id % 270 >= 15 then 8 else 0 end + 8 * (event_id % 270) as bits from events")
def s30(spark, sf_dir):
    def f(e):
        x = {"kind": P.FILL, "payload": "00" * (e % 270)}
        back = P.element(Reader(written(P.element, x, 48000, _BOOKS()).data), {}, 48000, _BOOKS())
        return [{"size": len(back["payload"]) // 2, "bits": _bits_of(x)}]

    return _event_rows(spark, sf_dir, f, "size int, bits int")


@plan("s31_data_element", "select event_id, event_id % 500 as size, case when event_id % 2 = 1 then (16 + case when event_id % 500 >= 255 then 8 else 0 end + 7) // 8 * 8 else 16 + case when event_id % 500 >= 255 then 8 else 0 end end + 8 * (event_id % 500) as bits from events")
def s31(spark, sf_dir):
    def f(e):
        x = {"kind": P.DATA, "tag": 5, "aligned": e % 2 == 1, "payload": "77" * (e % 500)}
        back = P.element(Reader(written(P.element, x, 48000, _BOOKS()).data), {}, 48000, _BOOKS())
        return [{"size": len(back["payload"]) // 2, "bits": _bits_of(x)}]

    return _event_rows(spark, sf_dir, f, "size int, bits int")


@plan("p1_window_info", "select event_id, event_id % 4 as sequence, event_id // 4 % 2 as shape, event_id % 15 as max_band, case when event_id % 4 = 2 then 8 - bit_count((event_id * 5 % 128)::int) else 1 end as groups from events")
def p1(spark, sf_dir):
    def f(e):
        io = Writer()
        io.u(1), io.u(2, e % 4), io.u(1, e // 4 % 2)
        if e % 4 == 2:
            io.u(4, e % 15), io.u(7, e * 5 % 128)
        else:
            io.u(6, e % 15), io.u(1)
        w = P.window(Reader(io.data), {}, 48000)
        return [w | {"groups": len(w["groups"])}]

    return _event_rows(spark, sf_dir, f, "sequence int, shape int, max_band int, groups int")


@plan("p4_filter_parse", "select event_id, event_id % 2 as resolution, event_id % 64 as length, k, case when raw >= half then raw - 2 * half else raw end as c from (select *, (event_id * (k + 3)) % (2 * half) as raw from (select *, cast(pow(2, 2 + event_id % 2 - case when event_id % 3 = 0 then 1 else 0 end) as bigint) as half, unnest(range(event_id % 21)) as k from events))")
def p4(spark, sf_dir):
    """Coefficients come back with their signs, compressed ones too."""

    def f(e):
        io, bits = Writer(), 3 + e % 2 - (e % 3 == 0)
        io.u(1, 1), io.u(2, 1), io.u(1, e % 2), io.u(6, e % 64), io.u(5, e % 21)
        if e % 21:
            io.u(1, 1), io.u(1, e % 3 == 0)
        for k in range(e % 21):
            io.u(bits, e * (k + 3) % (1 << bits))
        c = {"window": {"sequence": 0}}
        P.filters(Reader(io.data), c)
        of = c["filters"][0]
        return [{"resolution": of["resolution"], "length": of["of"][0]["length"], "k": k, "c": v} for k, v in enumerate(of["of"][0]["coefficients"])]

    return _event_rows(spark, sf_dir, f, "resolution int, length int, k int, c int")


@plan("p5_pulse_parse", "select event_id, event_id % 64 as start, k, event_id * (k + 1) % 32 as step, (event_id + k) % 16 as amount from (select *, unnest(range(event_id % 4 + 1)) as k from events)")
def p5(spark, sf_dir):
    def f(e):
        c = {"window": {"sequence": 0}, "pulse": {"start": e % 64, "steps": [[e * (k + 1) % 32, (e + k) % 16] for k in range(e % 4 + 1)]}}
        data, back = written(P.pulse, c).data, {"window": {"sequence": 0}}
        P.pulse(Reader(data), back)
        return [{"start": back["pulse"]["start"], "k": k, "step": a, "amount": v} for k, (a, v) in enumerate(back["pulse"]["steps"])]

    return _event_rows(spark, sf_dir, f, "start int, k int, step int, amount int")


@plan("p14_channel_write", f"select event_id, {b('event_id % 256', 8)} || '0' || '00' || '0' || '000000' || '0' || '0' || '0' || '0' as bits from events")
def p14(spark, sf_dir):
    """A channel without bands."""
    return _event_rows(spark, sf_dir, lambda e: [{"bits": written(P.channel, _silent(e % 256), 48000, _BOOKS()).bits}], "bits string")


@plan("p15_frame_write", f"select event_id, 'FFF14C40017FFC' as header, '000' || '0000' || {b('event_id % 256', 8)} || '00000000000' || '000' || '111' as bits, 11 as size from events")
def p15(spark, sf_dir):
    """Packets of silence: header and block."""

    def f(e):
        io = Writer()
        P.block(io, [{"kind": P.SINGLE, "tag": 0, "channels": [_silent(e % 256)]}], 48000, _BOOKS())
        return [{"bits": io.bits, "payload": io.data}]

    from ..operators.streams import as_adts

    got = as_adts(_event_rows(spark, sf_dir, f, "bits string, payload binary"), 48000, 1)
    return got.select("event_id", F.hex(F.substring("packet", 1, 7)).alias("header"), "bits", F.octet_length("packet").alias("size"))


@plan("d11_filter_limit", "select event_id, least(case event_id // 2 % 12 " + " ".join(f"when {k} then case when event_id % 2 = 1 then {s} else {l} end" for k, (l, s) in enumerate(FILTER_BANDS)) + " end, event_id % 52) as bands from events")
def d11(spark, sf_dir):
    e = F.col("event_id")
    flat = F.array(*[F.lit(v) for pair in FILTER_BANDS for v in pair])
    at = F.floor(e / 2) % 12 * 2 + e % 2
    return _events(spark, sf_dir).select(e, F.least(F.get(flat, at.cast("int")), (e % 52).cast("int")).alias("bands"))


# --- words and lines ----------------------------------------------------------------------------


def words_sql(books: list[int]) -> str:
    """CTE words(book, symbol, n, word)."""
    rows = ", ".join(f"({k}, {s}, {n}, '{w:0{n}b}')" for k in books for s, (w, n) in sorted(_BOOKS()[k].code.items()))
    return f"words(book, symbol, n, word) as (values {rows})"


@plan("h2_step_decode", "select event_id, event_id * 7 % 121 - 60 as step from events")
def h2(spark, sf_dir):
    def f(e):
        io = Writer()
        io.symbol(_BOOKS()[K.STEPS], e * 7 % 121)
        return [{"step": Reader(io.data).symbol(_BOOKS()[K.STEPS]) - K.SAME}]

    return _event_rows(spark, sf_dir, f, "step int")


@plan("h3_symbol_search", f"with {words_sql([K.STEPS])}, w as (select *, rpad(word, 32, '0') as lo, rpad(word, 32, '1') as hi from words), e as (select event_id, lpad(bin(event_id * 2654435769 % 4294967296), 32, '0') as ahead from events) select event_id, symbol, n as bits from e join w on ahead between lo and hi")
def h3(spark, sf_dir):
    """The word that 32 bits begin with: the last whose first place is not beyond them."""
    book = _BOOKS()[K.STEPS]
    ahead = F.col("event_id") * 2654435769 % 4294967296
    at = F.size(F.filter(F.array(*[F.lit(s).cast("bigint") for s in book.starts]), lambda s: s <= ahead)) - 1
    pick = lambda v: F.get(F.array(*map(F.lit, v)), at)
    return _events(spark, sf_dir).select("event_id", pick(book.symbols).alias("symbol"), pick(book.lengths).alias("bits"))


_SEVEN = "event_id % 8 as u, event_id // 8 % 8 as v, event_id % 3 = 0 as minus"


@plan("h7_tuple_write", f"with {words_sql([7])}, e as (select event_id, {_SEVEN} from events) select event_id, word || case when u > 0 then case when minus then '1' else '0' end else '' end || case when v > 0 then '0' else '' end as bits from e join words on symbol = u * 8 + v")
def h7(spark, sf_dir):
    def f(e):
        u, v = e % 8, e // 8 % 8
        return [{"bits": written(lambda io, t: P.values(io, 7, t, _BOOKS()), (-u if e % 3 == 0 else u, v)).bits}]

    return _event_rows(spark, sf_dir, f, "bits string")


@plan("h8_tuple_cost", f"with {words_sql([7, 9])}, e as (select event_id, event_id % 14 as u, event_id // 14 % 14 as v, 7 + event_id % 2 * 2 as book from events) select event_id, e.book, case when greatest(u, v) <= case when e.book = 7 then 7 else 12 end then n + (u > 0)::int + (v > 0)::int end as bits from e left join words w on w.book = e.book and symbol = u * (case when e.book = 7 then 8 else 13 end) + v")
def h8(spark, sf_dir):
    """Null where the tuple is beyond the book."""
    e = F.col("event_id")
    u, v, nine = e % 14, F.floor(e / 14) % 14, e % 2 == 1
    size = lambda k: F.array(*[F.lit(_BOOKS()[k].code[s][1]) for s in range(len(_BOOKS()[k].code))])
    signs = (u > 0).cast("int") + (v > 0).cast("int")
    cost = F.when(nine, F.when(F.greatest(u, v) <= 12, F.get(size(9), (u * 13 + v).cast("int")))).otherwise(F.when(F.greatest(u, v) <= 7, F.get(size(7), (u * 8 + v).cast("int"))))
    return _events(spark, sf_dir).select("event_id", (7 + e % 2 * 2).alias("book"), (cost + signs).alias("bits"))


def _quantised(spark, sf_dir, scale: int = 30):
    return spectra(spark, sf_dir).select("vec_id", F.transform("x", lambda v: F.rint(v * scale).cast("int")).alias("q"))


def _vector_rows(spark, sf_dir, f, schema: str, scale: int = 30):
    return by_row(_quantised(spark, sf_dir, scale), lambda r: [{"vec_id": r["vec_id"], **x} for x in f(r["vec_id"], r["q"])], f"vec_id bigint, {schema}")


@plan("h1_lines_decode", f"with {SPEC_SQL} select vec_id, k, cast(round_even(x * 60, 0) as integer) as q from sp")
def h1(spark, sf_dir):
    """Pairs in book 11, with escapes."""

    def f(_, q):
        io = Writer()
        for k in range(0, 64, 2):
            P.values(io, 11, (q[k], q[k + 1]), _BOOKS())
        back = Reader(io.data)
        return [{"k": k + j, "q": v} for k in range(0, 64, 2) for j, v in enumerate(P.values(back, 11, (0, 0), _BOOKS()))]

    return _vector_rows(spark, sf_dir, f, "k int, q int", 60)


def _channel(vec_id: int, q: list[int], sequence: int = 0) -> dict:
    """A channel whose lines repeat the vector, in the cheaper book of each band."""
    import numpy as np

    from ..functions.tables import band_widths
    from ..operators import coder as C

    lines = np.tile(q, 16)
    groups = [2, 1, 5] if sequence == P.SHORT else [1]
    widths = [n * w for n in groups for w in band_widths(48000, sequence == P.SHORT)]
    book, _ = C.choose_books(lines, widths, C.word_lengths(_BOOKS()))
    bands = len(widths) // len(groups)
    books = book.reshape(-1, bands).tolist()
    return {"gain": 100, "window": {"sequence": sequence, "shape": vec_id % 2, "max_band": bands, "groups": groups}, "books": books, "scales": [[0 if k == 0 else 90 + (b + vec_id) % 20 for b, k in enumerate(g)] for g in books], "pulse": None, "filters": None, "lines": lines.tolist()}


@plan("h6_spectral_data", f"with {SPEC_SQL} select vec_id, r * 64 + k as line, cast(round_even(x * 30, 0) as integer) as q from sp, (select unnest(range(16)) as r)")
def h6(spark, sf_dir):
    """All lines of a channel, band by band, written and read."""

    def f(v, q):
        c = _channel(v, q)
        back = {"window": c["window"], "books": c["books"]}
        P.lines(Reader(written(P.lines, dict(c), 48000, _BOOKS()).data), back, 48000, _BOOKS())
        return [{"line": k, "q": x} for k, x in enumerate(back["lines"])]

    return _vector_rows(spark, sf_dir, f, "line int, q int")


@plan("p3_channel_stream", f"with {SPEC_SQL}, q as (select vec_id, cast(round_even(x * 30, 0) as bigint) as q, k from sp) select vec_id, vec_id % 3 = 0 as short, 100 as gain, vec_id % 2 as shape, sum(q * (r * 64 + k + 1)) as lines from q, (select unnest(range(16)) as r) group by all")
def p3(spark, sf_dir):
    """Whole channel streams, every third of eight short windows in three groups; scalefactors must come back too."""

    def f(v, q):
        c = _channel(v, q, P.SHORT if v % 3 == 0 else 0)
        back = P.channel(Reader(written(P.channel, dict(c), 48000, _BOOKS()).data), {}, 48000, _BOOKS())
        assert back["scales"] == c["scales"] and back["books"] == c["books"]
        return [{"short": back["window"]["sequence"] == P.SHORT, "gain": back["gain"], "shape": back["window"]["shape"], "lines": sum(x * (k + 1) for k, x in enumerate(back["lines"]))}]

    return _vector_rows(spark, sf_dir, f, "short boolean, gain int, shape int, lines bigint")


@plan("p6_pulse_apply", f"with {SPEC_SQL}, q as (select vec_id, r * 64 + k as line, cast(round_even(x * 30, 0) as integer) as q from sp, (select unnest(range(16)) as r)), s as (select vec_id, j, 1 + vec_id * (j + 1) % 31 as step, (vec_id + j) % 16 as amount from (select distinct vec_id from sp), (select unnest(range(4)) as j)), p as (select vec_id, amount, (case vec_id % 4 when 0 then 0 when 1 then 4 when 2 then 8 else 12 end) + sum(step) over (partition by vec_id order by j) as line from s) select q.vec_id, q.line, q + case when q >= 0 then 1 else -1 end * coalesce(amount, 0) as q from q left join p on p.vec_id = q.vec_id and p.line = q.line")
def p6(spark, sf_dir):
    from ..operators.coder import with_pulses

    def f(v, q):
        c = {"lines": q * 16, "pulse": {"start": v % 4, "steps": [[1 + v * (j + 1) % 31, (v + j) % 16] for j in range(4)]}}
        return [{"line": k, "q": int(x)} for k, x in enumerate(with_pulses(c, 48000))]

    return _vector_rows(spark, sf_dir, f, "line int, q int")


