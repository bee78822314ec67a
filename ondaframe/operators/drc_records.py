"""Records of dynamic range control, each laid out once for reading and writing (see bitio)."""

from __future__ import annotations

import math

from .bitio import field, flag

#: Positions of low-frequency channels, most channels, most bands, most gain sequences.
LOW_POSITIONS, MOST_CHANNELS, MOST_BANDS, MOST_SEQUENCES = (3, 26), 8, 8, 24
#: Fixed values in dB: downmix coefficients of version 0, of its low-frequency channels, of version 1.
DOWNMIX_V0 = [0.0, -0.5, -1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.5, -5.0, -5.5, -6.0, -7.5, -9.0, -1000.0]
DOWNMIX_LOW = [10.0, 6.0, 4.5, 3.0, 1.5, 0.0, -1.5, -3.0, -4.5, -6.0, -10.0, -15.0, -20.0, -30.0, -40.0, -1000.0]
DOWNMIX_V1 = [10.0, 6.0, 4.5, 3.0, 1.5, 0.0, -0.5, -1.0, -1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.5, -5.0, -5.5, -6.0, -6.5, -7.0, -7.5, -8.0, -9.0, -10.0, -11.0, -12.0, -15.0, -20.0, -25.0, -30.0, -40.0, -100000.0]
#: Loudness methods 0 to 9 by name; bits of their values where not 8.
METHODS = ["other", "program", "anchor", "range_max", "momentary_max", "short_term_max", "range", "mixing_level", "room", "short_term"]
METHOD_BITS = {"mixing_level": 5, "room": 2}
EXPERTS, SYSTEMS = 5, 7


def _optional(io, r: dict, name: str, n: int) -> None:
    r[name] = io.u(n, r.get(name) or 0) if io.u(1, r.get(name) is not None) else None


def method_value(method: str, raw: int) -> float:
    if method == "range":
        return raw / 4 if raw <= 128 else raw / 2 - 32 if raw <= 204 else raw - 134.0
    return {"mixing_level": raw + 80.0, "room": float(raw), "short_term": raw / 2 - 116}.get(method, raw / 4 - 57.75)


def peak_db(raw: int | None) -> float | None:
    return 20 - raw / 32 if raw else None


def loudness(io, r: dict, version: int) -> dict:
    """drc_set, eq_set, downmix, sample_peak and true_peak (raw; 0 is unknown), measures of (method, raw, system, reliability)."""
    field(io, r, "drc_set", 6)
    if version:
        field(io, r, "eq_set", 6)
    field(io, r, "downmix", 7)
    _optional(io, r, "sample_peak", 12)
    _optional(io, r, "true_peak", 12)
    if r["true_peak"] is not None:
        field(io, r, "peak_system", 4)
        field(io, r, "peak_reliability", 2)
    old = r.get("measures", [])
    n = io.u(4, len(old))
    out = []
    for m in old if io.writing else [{} for _ in range(n)]:
        if field(io, m, "method", 4) >= len(METHODS):
            raise ValueError(f"loudness method {m['method']}")
        field(io, m, "raw", METHOD_BITS.get(METHODS[m["method"]], 8))
        if field(io, m, "system", 4) >= SYSTEMS:
            raise ValueError(f"measurement system {m['system']}")
        field(io, m, "reliability", 2)
        out.append(m | {"value": method_value(METHODS[m["method"]], m["raw"])})
    r["measures"] = out
    r["anchor"] = any(METHODS[m["method"]] == "anchor" for m in out)
    r["expert"] = any(m["system"] == EXPERTS for m in out)
    return r


def layout(io, r: dict, expected: int | None = None) -> dict:
    """channels, defined (null: not signalled; 0: positions follow), positions, low (which are low-frequency channels)."""
    if not 1 <= field(io, r, "channels", 7) <= MOST_CHANNELS or expected not in (None, r["channels"]):
        raise ValueError(f"{r['channels']} channels")
    _optional(io, r, "defined", 8)
    old = r.get("positions") or [0] * r["channels"]
    r["positions"] = [io.u(7, p) for p in old] if r["defined"] == 0 else []
    r["low"] = [p in LOW_POSITIONS for p in r["positions"]]
    return r


def _offset(kind: int, target: int, base: int, db: list[float]) -> float:
    share = 20 * math.log10(target / base) if target else -math.inf
    if kind > 3:
        raise ValueError(f"offset {kind}")
    level = [None, share, 2 * share, 20 * math.log10(sum(10 ** (v / 10) for v in db)) if db else 0.0][kind]
    return 0.0 if not kind else 0.5 * math.floor(0.5 + level)


def downmix(io, r: dict, version: int, base: int, low: list[bool]) -> dict:
    """id, target_channels, target_layout, offset (version 1), codes, and gains: target x base linear coefficients."""
    field(io, r, "id", 7)
    if field(io, r, "target_channels", 7) > MOST_CHANNELS:
        raise ValueError(f"{r['target_channels']} target channels")
    field(io, r, "target_layout", 8)
    old, pairs = r.get("codes"), r["target_channels"] * base
    if not io.u(1, old is not None):
        return r | {"codes": None, "gains": []}
    if version:
        field(io, r, "offset", 4)
    codes = r["codes"] = [io.u(5 if version else 4, c) for c in old or [0] * pairs]
    if version:
        db = [DOWNMIX_V1[c] for c in codes]
        plus = _offset(r["offset"], r["target_channels"], base, db)
    else:
        db, plus = [(DOWNMIX_LOW if k % base < len(low) and low[k % base] else DOWNMIX_V0)[c] for k, c in enumerate(codes)], 0.0
    r["gains"] = [10 ** ((v + plus) / 20) for v in db]
    return r


def characteristic(io, r: dict, version: int) -> dict:
    """cicp, or left and right; all null where there is none."""
    if not version:
        r["cicp"] = io.u(7, r.get("cicp") or 0) or None
    elif io.u(1, any(r.get(k) is not None for k in ("cicp", "left", "right"))):
        if io.u(1, r.get("cicp") is not None):
            r["cicp"] = io.u(7, r.get("cicp") or 0)
        else:
            field(io, r, "left", 4)
            field(io, r, "right", 4)
    return {k: r.get(k) for k in ("cicp", "left", "right")}


def _scaling(io, b: dict) -> None:
    _optional(io, b, "scaling", 8)
    _optional(io, b, "offset", 6)


def modifiers(io, r: dict, version: int, bands: int) -> dict:
    """bands of left and right target characteristics, scaling (two nibbles of eighths) and offset (sign, and quarters of a dB less one); shape filter."""
    old = r.get("bands") or [{} for _ in range(bands)]
    if not version:
        _scaling(io, old[0])
        old = [old[0]] * bands
    else:
        for b in old:
            for name in ("left", "right"):
                _optional(io, b, name, 4)
                if (b[name] or 0) > MOST_BANDS:
                    raise ValueError(f"characteristic {b[name]}")
            _scaling(io, b)
        if bands == 1:
            _optional(io, r, "shape", 4)
            if (r["shape"] or 0) > MOST_BANDS:
                raise ValueError(f"shape filter {r['shape']}")
        else:
            r["shape"] = None
    r["bands"] = old
    return r


def scaling_factors(raw: int | None) -> tuple[float, float] | None:
    """Of attenuation and of amplification."""
    return None if raw is None else ((raw >> 4) / 8, (raw & 15) / 8)


def offset_db(raw: int | None) -> float | None:
    return None if raw is None else (-1 if raw >> 5 else 1) * (1 + (raw & 31)) / 4


def gain_set(io, r: dict, version: int, counter: int) -> tuple[dict, int]:
    """profile (3: constant), spline, full_frame, aligned, time_step (null: not given), bands of (sequence, characteristic), split at crossovers or sub-bands; and the sequence counter after them.

    A band takes the counter's next value, or in version 1 one of its own.
    """
    field(io, r, "profile", 2)
    for name in ("spline", "full_frame", "aligned"):
        flag(io, r, name)
    r["time_step"] = io.u(11, (r.get("time_step") or 1) - 1) + 1 if io.u(1, r.get("time_step") is not None) else None
    old, crossover = r.get("bands", [{}]), False
    n = 1
    if r["profile"] != 3:
        n = io.u(4, len(old))
        if n > MOST_BANDS:
            raise ValueError(f"{n} bands")
        crossover = bool(io.u(1, r.get("crossover", False))) if n > 1 else False
    r["crossover"], out = crossover, []
    for b in old if io.writing else [{} for _ in range(n)]:
        if version and io.u(1, b.get("sequence") is not None):
            counter = io.u(6, b.get("sequence") or 0)
        else:
            counter += 1
        if counter >= MOST_SEQUENCES:
            raise ValueError(f"gain sequence {counter}")
        out.append({"sequence": counter, **characteristic(io, b, version)})
    r["bands"] = out
    width = 4 if crossover else 10
    r["split"] = [io.u(width, x) for x in r.get("split") or [0] * (n - 1)] if n > 1 else []
    return r, counter
