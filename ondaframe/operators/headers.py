"""Stream headers and configurations, each laid out once for reading and writing."""

from __future__ import annotations

from ..functions.tables import RATES
from .bitio import field, flag


class Unsupported(ValueError):
    """A feature that is recognised and not implemented."""


#: Object types that a configuration may name, and those that signal band replication or parametric stereo in front of another (fixed values).
OBJECT_TYPES = [1, 2, 3, 4, 5, 6, 17, 19, 20, 23, 29, 39, 42]
REPLICATION, PARAMETRIC = 5, 29


def _object_type(io, value: int) -> int:
    first = io.u(5, min(value, 31))
    return first if first < 31 else 32 + io.u(6, value - 32)


def _rate(io, hz: int) -> int:
    index = io.u(4, RATES.index(hz) if hz in RATES else 15)
    if index == 15:
        return io.u(24, hz)
    if index >= len(RATES):
        raise ValueError(f"rate index {index}")
    return RATES[index]


def config(io, c: dict) -> dict:
    """Configuration: object_type, rate, channels, short_frames (960), core_delay (null: none), and with extensions extension_rate and base_type.

    Extension fields are read; a configuration is written without them.
    """
    kind = c["object_type"] = _object_type(io, c.get("object_type", 2))
    if kind not in OBJECT_TYPES:
        raise Unsupported(f"object type {kind}")
    c["rate"] = _rate(io, c.get("rate", 44100))
    if field(io, c, "channels", 4) > 7:
        raise ValueError(f"channel configuration {c['channels']}")
    c["replication"], c["parametric"] = kind in (REPLICATION, PARAMETRIC), kind == PARAMETRIC
    if c["replication"] and not io.writing:
        c["extension_rate"], c["base_type"] = _rate(io, 0), _object_type(io, 0)
    flag(io, c, "short_frames")
    if io.u(1, c.get("core_delay") is not None):
        c["core_delay"] = io.u(14, c.get("core_delay") or 0)
    else:
        c["core_delay"] = None
    io.u(1, 0)
    return c


ADIF = 0x41444946


def adif(io, h: dict) -> dict:
    """File header: copyright (9 bytes as hex, or null), original, home, variable, bitrate, fullness (constant rate only), configs."""
    if io.u(32, ADIF) != ADIF:
        raise ValueError("no ADIF header")
    if io.u(1, h.get("copyright") is not None):
        old = bytes.fromhex(h.get("copyright") or "00" * 9)
        h["copyright"] = bytes(io.u(8, x) for x in old).hex()
    else:
        h["copyright"] = None
    for name in ("original", "home", "variable"):
        flag(io, h, name)
    field(io, h, "bitrate", 23)
    count = io.u(4, len(h.get("configs", [0])) - 1) + 1
    h["fullness"] = None if h["variable"] else io.u(20, h.get("fullness") or 0)
    h["configs"] = [config(io, c) for c in h.get("configs") or [{} for _ in range(count)]]
    return h


def mux(io, m: dict) -> dict:
    """Multiplex configuration: version, same_framing, subframes, programs, layers and one configuration."""
    field(io, m, "version", 1)
    flag(io, m, "same_framing")
    for name, n in (("subframes", 6), ("programs", 4), ("layers", 3)):
        field(io, m, name, n, 1)
    m["config"] = config(io, m.get("config", {}))
    return m


SYNC = 0x2B7


def loas(io, e: dict) -> dict:
    """A transport element: sync word, length, an optional multiplex configuration, payload (hex).

    The stated length is that of the payload and 4 bytes with a configuration,
    1 without; whole bytes that are there are read up to it.
    """
    if io.u(11, SYNC) != SYNC:
        raise ValueError("no transport sync word")
    payload = bytes.fromhex(e.get("payload", ""))
    e["length"] = io.u(13, len(payload) + (4 if e.get("mux") else 1))
    e["mux"] = mux(io, e.get("mux") or {}) if io.u(1, e.get("mux") is not None) else None
    n = len(payload) if io.writing else min(io.size - io.at, 8 * e["length"]) // 8
    e["payload"] = bytes(io.u(8, payload[k] if io.writing else 0) for k in range(n)).hex()
    return e


def program(io, p: dict) -> dict:
    """Program configuration: front, side, back as lists of (is pair, tag), low (tags), and mixdown fields (null: none)."""
    field(io, p, "tag", 4)
    field(io, p, "object_type", 2, 1)
    p["rate"] = RATES[min(io.u(4, RATES.index(p.get("rate", 44100))), len(RATES) - 1)]
    groups = [("front", 4), ("side", 4), ("back", 4), ("low", 2)]
    count = {name: io.u(n, len(p.get(name, []))) for name, n in groups}
    field(io, p, "data_elements", 3)
    field(io, p, "coupling_elements", 4)
    for name in ("mono_mixdown", "stereo_mixdown"):
        p[name] = io.u(4, p.get(name) or 0) if io.u(1, p.get(name) is not None) else None
    p["matrix_mixdown"] = [io.u(2, (p.get("matrix_mixdown") or [0, 0])[0]), io.u(1, (p.get("matrix_mixdown") or [0, 0])[1])] if io.u(1, p.get("matrix_mixdown") is not None) else None
    for name, _ in groups:
        old = p.get(name) or [(0, 0)] * count[name] if name != "low" else p.get(name) or [0] * count[name]
        p[name] = [io.u(4, x) if name == "low" else [io.u(1, x[0]), io.u(4, x[1])] for x in old]
    return p


def container(head: bytes) -> str:
    """What a stream is by its first bytes: adif, loas, private (four letters and version 1), adts, or raw."""
    if head[:4] == b"ADIF":
        return "adif"
    if head[:4] == b"VUSC":
        return "private"
    if len(head) > 1 and head[0] << 3 | head[1] >> 5 == SYNC:
        return "loas"
    return "adts" if len(head) > 1 and head[0] == 0xFF and head[1] & 0xF0 == 0xF0 else "raw"
