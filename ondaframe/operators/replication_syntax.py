"""Headers, time grids and flags of band replication, each laid out once for reading and writing (see bitio)."""

from __future__ import annotations

from .bitio import field, flag

#: What a header that leaves out a group of fields stands for.
FIRST_DEFAULTS = {"scale": 2, "warp": True, "noise_index": 2}
SECOND_DEFAULTS = {"limiter_bands": 2, "limiter_gains": 2, "interpolate": True, "smooth_off": True}
#: Slots of a frame; frame classes.
SLOTS = 16
FIXED, FIXED_VARIABLE, VARIABLE_FIXED, VARIABLE = range(4)


def header(io, h: dict) -> dict:
    """fine_steps, start, stop, crossover, and two groups of fields that may be left out (their defaults then)."""
    flag(io, h, "fine_steps")
    field(io, h, "start", 4)
    field(io, h, "stop", 4)
    field(io, h, "crossover", 3)
    io.u(2, 0)
    first = io.u(1, any(k in h and h[k] != v for k, v in FIRST_DEFAULTS.items()))
    second = io.u(1, any(k in h and h[k] != v for k, v in SECOND_DEFAULTS.items()))
    for on, defaults in ((first, FIRST_DEFAULTS), (second, SECOND_DEFAULTS)):
        for name, v in defaults.items():
            if not on:
                h[name] = v
            elif isinstance(v, bool):
                h.setdefault(name, v)
                flag(io, h, name)
            else:
                h.setdefault(name, v)
                field(io, h, name, 2)
    return h


def _relative(io, old: list[int]) -> list[int]:
    n = io.u(2, len(old))
    return [io.u(2, (x - 2) // 2) * 2 + 2 for x in (old if io.writing else [2] * n)]


def grid(io, g: dict) -> dict:
    """kind, lead and trail (slots by which a border is off the frame's), from_lead and from_trail (widths), pointer, fine (a flag an envelope).

    Adds borders (of envelopes, in slots) and noise_borders.
    """
    kind = field(io, g, "kind", 2)
    if kind == FIXED:
        n = 1 << io.u(2, (len(g.get("fine", [0])) - 1).bit_length())
        g |= {"lead": 0, "trail": 0, "pointer": 0}
        g["fine"] = [bool(io.u(1, g.get("fine", [0])[0]))] * n
        borders = [(SLOTS * k + n // 2) // n for k in range(n + 1)]
    else:
        ahead, behind = kind in (VARIABLE_FIXED, VARIABLE), kind in (FIXED_VARIABLE, VARIABLE)
        g["lead"] = io.u(2, g.get("lead", 0)) if ahead else 0
        g["trail"] = io.u(2, g.get("trail", 0)) if behind else 0
        if kind == VARIABLE:  # both counts stand before both lists
            counts = [io.u(2, len(g.get(k, []))) for k in ("from_lead", "from_trail")]
            for k, n in zip(("from_lead", "from_trail"), counts, strict=True):
                g[k] = [io.u(2, (x - 2) // 2) * 2 + 2 for x in (g[k] if io.writing else [2] * n)]
        else:
            g["from_lead"] = _relative(io, g.get("from_lead", [])) if ahead else []
            g["from_trail"] = _relative(io, g.get("from_trail", [])) if behind else []
        n = len(g["from_lead"]) + len(g["from_trail"]) + 1
        g["pointer"] = io.u(n.bit_length(), g.get("pointer", 0))
        if g["pointer"] > n:
            raise ValueError(f"pointer {g['pointer']} of {n} envelopes")
        order = range(n) if kind != FIXED_VARIABLE else range(n - 1, -1, -1)
        fine = g.get("fine") or [False] * n
        got = {k: bool(io.u(1, fine[k])) for k in order}
        g["fine"] = [got[k] for k in range(n)]
        first, last = [g["lead"]], [SLOTS + g["trail"]]
        for w in g["from_lead"]:
            first.append(first[-1] + w)
        for w in g["from_trail"]:
            last.insert(0, last[0] - w)
        borders = first + last
    if any(b <= a for a, b in zip(borders, borders[1:], strict=False)) or n > 8:
        raise ValueError(f"borders {borders}")
    p = g["pointer"]
    middle = n // 2 if kind == FIXED else (1 if p == 0 else n - 1 if p == 1 else p - 1) if kind == VARIABLE_FIXED else n + 1 - p if p > 1 else n - 1
    g["borders"], g["noise_borders"] = borders, [borders[0], *([borders[middle]] if n > 1 else []), borders[-1]]
    return g


def flags(io, r: dict, envelopes: int, noise: int, noise_bands: int, fine_bands: int) -> dict:
    """Directions of envelopes and noise floors (true: over time), a filter mode of two bits a noise band, and sinusoids (null: none)."""
    for name, n in (("envelope_time", envelopes), ("noise_time", noise)):
        r[name] = [bool(io.u(1, x)) for x in r.get(name) or [0] * n]
    r["modes"] = [io.u(2, x) for x in r.get("modes") or [0] * noise_bands]
    if io.u(1, r.get("sinusoids") is not None):
        r["sinusoids"] = [bool(io.u(1, x)) for x in r.get("sinusoids") or [0] * fine_bands]
    else:
        r["sinusoids"] = None
    return r


def deltas(io, rows: list[list[int]], over_time: list[bool], sizes: list[int], start_bits: int, book, before: list[int] | None, step: int = 1) -> list[list[int]]:
    """Scalefactors or noise floors of envelopes in a row, each of `sizes` bands.

    Over frequency: a start value, then steps from band to band.  Over time:
    steps from the envelope before (from the last frame's last one at first),
    whose bands are taken to this one's resolution by place.  Steps are symbols
    of the book, about its middle one.
    """
    middle, out = len(book.symbols) // 2, []
    for k, (along, n) in enumerate(zip(over_time, sizes, strict=True)):
        last, mine = out[-1] if out else before, []
        if along and not last:
            raise ValueError("steps over time without an envelope before")
        for b in range(n):
            if along:
                base = last[b * len(last) // n]
            elif not b:
                mine.append(io.u(start_bits, rows[k][0] // step if io.writing else 0) * step)
                continue
            else:
                base = mine[-1]
            mine.append(base + (io.symbol(book, ((rows[k][b] - base) // step if io.writing else 0) + middle) - middle) * step)
        out.append(mine)
    return out
