"""Raw data blocks: elements, channel streams, sections, scalefactors, filters and lines.

Each part is one layout for reading and writing (see bitio).  A channel is a
dict: gain; window (sequence, shape, max_band, groups); books and scales, a
list a group of a value a band; pulse, filters (or null); lines, quantised, in
the order group, band, window, line.
"""

from __future__ import annotations

from itertools import groupby

from ..functions import books as K
from ..functions.tables import band_widths, offsets
from .bitio import field, flag
from .headers import Unsupported, program

#: Kinds of element (fixed values).
SINGLE, PAIR, COUPLING, LOW, DATA, PROGRAM, FILL, END = range(8)
SHORT = 2
LINES = 1024


def window(io, w: dict, rate: int) -> dict:
    """sequence (0 long, 1 start, 2 eight short, 3 stop), shape, max_band, groups (windows of each)."""
    io.u(1, 0)
    field(io, w, "sequence", 2)
    field(io, w, "shape", 1)
    if w["sequence"] == SHORT:
        field(io, w, "max_band", 4)
        old = w.get("groups") or [8]
        bits = "".join("0" + "1" * (n - 1) for n in old)[1:]
        bits = format(io.u(7, int(bits, 2)), "07b")
        w["groups"] = [len(run) for run in ("1" + bits).replace("0", " 0").split(" ")]
    else:
        field(io, w, "max_band", 6)
        w["groups"] = [1]
        if io.u(1, 0):
            raise Unsupported("prediction")
    if w["max_band"] > len(band_widths(rate, w["sequence"] == SHORT)):
        raise ValueError(f"{w['max_band']} bands")
    return w


def sections(io, c: dict) -> None:
    """Runs of one book, group by group."""
    width = 3 if c["window"]["sequence"] == SHORT else 5
    last, most, out = (1 << width) - 1, c["window"]["max_band"], []
    for g in range(len(c["window"]["groups"])):
        runs = iter([(b, len(list(r))) for b, r in groupby(c["books"][g])] if io.writing else ())
        mine: list[int] = []
        while len(mine) < most:
            book, left = next(runs, (0, 0))
            book, n, step = io.u(4, book), 0, last
            while step == last:
                step = io.u(width, min(left - n, last))
                n += step
            if not n or len(mine) + n > most:
                raise ValueError(f"a section of {n} bands")
            mine += [book] * n
        out.append(mine)
    c["books"] = out


def scales(io, c: dict, books: dict) -> None:
    """Steps from band to band: of lines from the gain, of intensity positions from 0, of noise from 90 below the gain (the first as 9 bits)."""
    now = {"lines": c["gain"], "place": 0, "noise": c["gain"] - 90}
    first, out = True, []
    for g, of in enumerate(c["books"]):
        mine = []
        for b, book in enumerate(of):
            if book == K.ZERO:
                mine.append(0)
                continue
            kind = "noise" if book == K.NOISE else "place" if book in (K.OUT_OF_PHASE, K.IN_PHASE) else "lines"
            step = c["scales"][g][b] - now[kind] if io.writing else 0
            if kind == "noise" and first:
                step, first = io.u(9, step + 256) - 256, False
            else:
                step = io.symbol(books[K.STEPS], step + K.SAME) - K.SAME
            now[kind] += step
            if kind == "lines" and not 0 <= now[kind] <= 255:
                raise ValueError(f"scalefactor {now[kind]}")
            mine.append(now[kind])
        out.append(mine)
    c["scales"] = out


def pulse(io, c: dict) -> None:
    """start band and steps of (offset, amount); long windows only."""
    if not io.u(1, c.get("pulse") is not None):
        c["pulse"] = None
        return
    if c["window"]["sequence"] == SHORT:
        raise ValueError("pulses in short windows")
    p = c["pulse"] = c.get("pulse") or {}
    n = io.u(2, len(p.get("steps", [0])) - 1) + 1
    field(io, p, "start", 6)
    p["steps"] = [[io.u(5, a), io.u(4, b)] for a, b in p.get("steps") or [(0, 0)] * n]


def filters(io, c: dict) -> None:
    """Of each window: resolution and filters (length in bands from the top down, order, down, compress, coefficients)."""
    if not io.u(1, c.get("filters") is not None):
        c["filters"] = None
        return
    short = c["window"]["sequence"] == SHORT
    old = c.get("filters") or [{"resolution": 0, "of": None} for _ in range(8 if short else 1)]
    for w in old:
        n = io.u(1 if short else 2, len(w["of"] or ()))
        if n:
            field(io, w, "resolution", 1)
        w["of"] = w["of"] if io.writing else [{} for _ in range(n)]
        for f in w["of"]:
            field(io, f, "length", 4 if short else 6)
            if field(io, f, "order", 3 if short else 5) > (7 if short else 20):
                raise ValueError(f"filter of order {f['order']}")
            if not f["order"]:
                f["coefficients"] = []
                continue
            flag(io, f, "down")
            flag(io, f, "compress")
            bits = 3 + w["resolution"] - f["compress"]
            half = 1 << bits - 1
            f["coefficients"] = [(io.u(bits, v & 2 * half - 1) + half) % (2 * half) - half for v in f.get("coefficients") or [0] * f["order"]]
    c["filters"] = old


def values(io, book: int, old: tuple[int, ...], books: dict) -> tuple[int, ...]:
    """A tuple: word, signs of what is not zero where they stand apart, escapes."""
    _, signed, most = K.SHAPES[book]
    if io.writing and max(map(abs, old)) > (8191 if book == 11 else most):
        raise ValueError(f"{old} is not in book {book}")
    size = old if signed else tuple(min(abs(v), most) for v in old)
    size = K_TUPLES[book][io.symbol(books[book], K.symbol(book, size) if io.writing else 0)]
    if signed:
        return size
    signs = [io.u(1, v < 0) if m else 0 for m, v in zip(size, old, strict=True)]
    if book == 11:
        size = tuple(_escape(io, abs(v)) if m == K.ESCAPE else m for m, v in zip(size, old, strict=True))
    return tuple(-m if s else m for m, s in zip(size, signs, strict=True))


def _escape(io, v: int) -> int:
    n = max(4, v.bit_length() - 1)
    k = 4
    while io.u(1, k < n):
        k += 1
        if k > 20:
            raise ValueError("an escape of more than 20 bits")
    return (1 << k) + io.u(k, v - (1 << k) if io.writing else 0)


K_TUPLES = {b: K.tuples(b) for b in K.SHAPES}


def places(w: dict, rate: int) -> list[list[tuple[int, int]]]:
    """From and to of each band of each group in the lines."""
    short = w["sequence"] == SHORT
    at, edge, out = 0, offsets(band_widths(rate, short)), []
    for n in w["groups"]:
        out.append([(at + n * a, at + n * b) for a, b in zip(edge, edge[1:])])
        at += n * (LINES // 8 if short else LINES)
    return out


def lines(io, c: dict, rate: int, books: dict) -> None:
    old = c.get("lines")
    out = [0] * LINES
    for of, spans in zip(c["books"], places(c["window"], rate), strict=True):
        for book, (a, b) in zip(of, spans, strict=False):
            if book in (K.ZERO, K.NOISE, K.OUT_OF_PHASE, K.IN_PHASE):
                continue
            if book not in K.SHAPES:
                raise ValueError(f"book {book}")
            n = K.SHAPES[book][0]
            for k in range(a, b, n):
                out[k : k + n] = values(io, book, tuple(old[k : k + n]) if io.writing else (0,) * n, books)
    c["lines"] = out


def channel(io, c: dict, rate: int, books: dict, shared: dict | None = None) -> dict:
    """A channel stream; shared: the window that a pair has in common."""
    field(io, c, "gain", 8)
    c["window"] = shared or window(io, c.get("window", {}), rate)
    sections(io, c)
    scales(io, c, books)
    pulse(io, c)
    filters(io, c)
    if io.u(1, 0):
        raise Unsupported("gain control")
    lines(io, c, rate, books)
    return c


def pair(io, e: dict, rate: int, books: dict) -> None:
    """Two channels; shared window and mid/side flags (a list a group, true: all) where they have one."""
    shared = e["shared"] = window(io, e.get("shared") or {}, rate) if io.u(1, e.get("shared") is not None) else None
    if shared:
        old = e.get("mid_side")
        how = io.u(2, 2 if old is True else 1 if old else 0)
        if how == 3:
            raise ValueError("mid/side flags of kind 3")
        e["mid_side"] = [None, None, True][how]
        if how == 1:
            e["mid_side"] = [[io.u(1, old[g][b] if io.writing else 0) for b in range(shared["max_band"])] for g in range(len(shared["groups"]))]
    e["channels"] = [channel(io, c, rate, books, shared) for c in e.get("channels") or [{}, {}]]


def _counted(io, n: int, width: int, less: int) -> int:
    """A count with an escape of eight more bits, which counts `less` less."""
    last = (1 << width) - 1
    first = io.u(width, min(n, last))
    return first if first < last else first + io.u(8, n - last + less) - less


def element(io, e: dict, rate: int, books: dict) -> dict:
    kind = e["kind"] = io.u(3, e.get("kind", END))
    if kind == COUPLING:
        raise Unsupported("coupling channels")
    if kind == FILL:
        old = bytes.fromhex(e.get("payload", ""))
        n = _counted(io, len(old), 4, 1)
        e["payload"] = bytes(io.u(8, old[k] if io.writing else 0) for k in range(n)).hex()
    elif kind != END and kind != PROGRAM:
        field(io, e, "tag", 4)
        if kind == DATA:
            old = bytes.fromhex(e.get("payload", ""))
            flag(io, e, "aligned")
            n = _counted(io, len(old), 8, 0)
            if e["aligned"]:
                io.align()
            e["payload"] = bytes(io.u(8, old[k] if io.writing else 0) for k in range(n)).hex()
        elif kind == PAIR:
            pair(io, e, rate, books)
        else:
            e["channels"] = [channel(io, c, rate, books) for c in e.get("channels") or [{}]]
    elif kind == PROGRAM:
        program(io, e)
    return e


def block(io, elements: list[dict], rate: int, books: dict) -> list[dict]:
    """Elements up to the end mark, then a whole byte.  At most 8 channels, at least one."""
    out = []
    for old in [*elements, {"kind": END}] if io.writing else iter(dict, None):
        e = element(io, old, rate, books)
        if e["kind"] == END:
            break
        out.append(e)
        if sum(len(x.get("channels", ())) for x in out) > 8:
            raise ValueError("more than 8 channels")
    if not any(x.get("channels") for x in out):
        raise ValueError("no channel")
    io.align()
    return out
