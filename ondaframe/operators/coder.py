"""Quantised channels from spectra and back: code book choice, bit budgets, filters over lines, stereo.

Whole frames at a time in NumPy; the bit syntax is in payload.
"""

from __future__ import annotations

import functools

import numpy as np

from ..functions import books as K
from ..functions.tables import FILTER_BANDS, band_widths, offsets, rate_index
from . import payload as P
from .bitio import Writer
from .transforms import frame_window, lines_of, samples_of, short_window

LINES = P.LINES
SHAPE_NAMES = ("sine", "kbd")
SEQUENCES = ("long", "start", "short", "stop")


# --- code books -----------------------------------------------------------------------------------


def word_lengths(books: dict) -> dict[int, np.ndarray]:
    return {b: np.array([book.code[s][1] for s in range(len(book.code))]) for b, book in books.items()}


def line_costs(q: np.ndarray, widths: list[int], lengths: dict[int, np.ndarray]) -> np.ndarray:
    """Bits of each band in each book (a row a book, from 1 on); a large number where a value is beyond the book."""
    edge = np.array(offsets(widths))
    m = np.abs(q)
    most = np.maximum.reduceat(m, edge[:-1])
    out = np.full((len(K.SHAPES), len(widths)), 1 << 40)
    for b, (n, signed, bound) in K.SHAPES.items():
        v = (np.clip(q, -bound, bound) + bound if signed else np.minimum(m, bound)).reshape(-1, n)
        base = 2 * bound + 1 if signed else bound + 1
        bits = lengths[b][v @ base ** np.arange(n - 1, -1, -1)]
        if not signed:
            bits = bits + (v > 0).sum(axis=1)
        if b == 11:
            big = m >= K.ESCAPE
            more = np.where(big, 2 * np.floor(np.log2(np.maximum(m, 1))).astype(int) - 3, 0)
            bits = bits + more.reshape(-1, n).sum(axis=1)
        fits = most <= (8191 if b == 11 else bound)
        out[b - 1, fits] = np.add.reduceat(bits, edge[:-1] // n)[fits]
    return out


def least_books(q: np.ndarray, widths: list[int]) -> np.ndarray:
    """First book that holds a band; 0 for silence."""
    most = np.maximum.reduceat(np.abs(q), offsets(widths)[:-1])
    return np.select([most == 0, most <= 1, most <= 2, most <= 4, most <= 7, most <= 12], [0, 1, 3, 5, 7, 9], 11)


def choose_books(q: np.ndarray, widths: list[int], lengths: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each band the cheaper of its first book and the one after it, the first on a tie; and its bits."""
    cost, first = line_costs(q, widths, lengths), least_books(q, widths)
    at = np.arange(len(widths))
    a, b = cost[np.maximum(first, 1) - 1, at], cost[np.minimum(np.maximum(first, 1), 10), at]
    book = np.where(first == 0, 0, np.where((first < 11) & (b < a), first + 1, first))
    return book, np.where(first == 0, 0, np.where((first < 11) & (b < a), b, a))


def side_cost(book: np.ndarray, sf: np.ndarray, lengths: dict[int, np.ndarray]) -> int:
    """9 bits a run of one book, and the words of the steps between coded bands' scalefactors (19 where there is none)."""
    runs = 1 + int((book[1:] != book[:-1]).sum()) if len(book) else 0
    step = np.diff(sf[book > 0])
    words = lengths[K.STEPS]
    inside = np.abs(step) <= K.SAME
    return 9 * runs + int(words[step[inside] + K.SAME].sum()) + 19 * int((~inside).sum()) + (int(words[K.SAME]) if (book > 0).any() else 0)


# --- quantisation under a budget ------------------------------------------------------------------


def dequantise(q: np.ndarray, sf) -> np.ndarray:
    return np.sign(q) * np.abs(q) ** (4 / 3) * 2.0 ** ((np.clip(sf, 0, 255) - 100) / 4)


def quantise(x: np.ndarray, sf) -> np.ndarray:
    q = np.minimum(np.floor(np.abs(x) ** 0.75 * 2.0 ** (-0.1875 * (np.asarray(sf) - 100)) + 0.4054), 8191)
    return (np.sign(x) * q).astype(int)


def attempt(x: np.ndarray, widths: list[int], threshold: np.ndarray, lift: float, lengths: dict[int, np.ndarray]) -> dict:
    """Quantised lines, scalefactors, books and bits with every threshold raised by `lift` dB.

    A scalefactor follows from its band's form factor, is not below what can
    be represented, nor more than 60 above the lowest of the coded bands.
    """
    edge = offsets(widths)[:-1]
    root = np.add.reduceat(np.sqrt(np.abs(x)), edge)
    peak = np.maximum.reduceat(np.abs(x), edge)
    allowed = threshold * 10 ** (lift / 10)
    heard = (np.add.reduceat(x * x, edge) > allowed) & (peak > 0)
    wanted = 100 + np.floor(8 / 3 * np.log2(6.75 * np.maximum(allowed, 1e-30) / np.maximum(root, 1e-30)))
    least = 100 + np.ceil(16 / 3 * (0.75 * np.log2(np.maximum(peak, 1e-30)) - np.log2(8190.5)))
    sf = np.clip(np.maximum(wanted, least), 0, 255)
    low = sf[heard].min() if heard.any() else 100
    sf = np.where(heard, np.minimum(sf, low + K.SAME), low).astype(int)
    q = np.where(np.repeat(heard, widths), quantise(x, np.repeat(sf, widths)), 0)
    book, bits = choose_books(q, widths, lengths)
    return {"q": q, "sf": sf, "book": book, "bits": int(bits.sum()) + side_cost(book, sf, lengths), "lift": lift}


def fit(x: np.ndarray, widths: list[int], threshold: np.ndarray, budget: int, lengths: dict[int, np.ndarray]) -> dict:
    """The attempt with the least lift between -80 and 120 dB, to 0.35 dB, that keeps the budget; that at 120 dB if none does.

    broke: the last lift that broke the budget.
    """
    low, high = -80.0, 120.0
    best = attempt(x, widths, threshold, low, lengths)
    if best["bits"] <= budget:
        return best
    best = attempt(x, widths, threshold, high, lengths)
    while high - low > 0.35:
        middle = (low + high) / 2
        got = attempt(x, widths, threshold, middle, lengths)
        if got["bits"] <= budget:
            best, high = got, middle
        else:
            low = middle
    return best | {"broke": low}


def split_budget(budget: int, entropy: list[float]) -> list[int]:
    """A frame's bits by perceptual entropy; alike where there is none."""
    total = sum(entropy)
    return [int(budget * (e / total if total > 0 else 1 / len(entropy))) for e in entropy]


def fit_channels(spectra: list, widths: list[int], thresholds: list, budget: int, entropy: list[float], lengths: dict) -> list[dict]:
    """Channels within a frame's budget; what is left goes to the channel with the greatest lift, twice at most."""
    share = split_budget(budget, entropy)
    got = [fit(x, widths, t, b, lengths) for x, t, b in zip(spectra, thresholds, share, strict=True)]
    for _ in range(2):
        left = budget - sum(g["bits"] for g in got)
        k = max(range(len(got)), key=lambda k: got[k]["lift"])
        if left <= 0 or got[k]["lift"] <= -80:
            break
        got[k] = fit(spectra[k], widths, thresholds[k], got[k]["bits"] + left, lengths)
    return got


# --- filters over lines ---------------------------------------------------------------------------


def step_up(parcor) -> np.ndarray:
    """Direct-form coefficients, 1 first, of reflection coefficients."""
    a = np.ones(1)
    for k in parcor:
        a = np.concatenate([a, [0.0]]) + k * np.concatenate([[0.0], a[::-1]])
    return a


def reflection(coefficients, resolution: int) -> np.ndarray:
    """Of quantised angles with 3 + resolution bits."""
    c = np.asarray(coefficients, dtype=float)
    half = 1 << 2 + resolution
    return np.sin(c * (np.pi / 2) / np.where(c >= 0, half - 0.5, half + 0.5))


def angles(parcor, resolution: int = 1) -> list[int]:
    """Nearest quantised angle of each reflection coefficient."""
    half = 1 << 2 + resolution
    grid = np.arange(-half, half)
    return [int(grid[np.abs(reflection(grid, resolution) - k).argmin()]) for k in parcor]


def all_pole(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    y = np.zeros(len(x) + len(a) - 1)
    for n, v in enumerate(x):
        y[n + len(a) - 1] = v - a[:0:-1] @ y[n : n + len(a) - 1]
    return y[len(a) - 1 :]


def all_zero(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.convolve(x, a)[: len(x)]


def predictor(x: np.ndarray, order: int = 12) -> tuple[np.ndarray, float]:
    """Reflection coefficients (within 0.99) of the lines' autocorrelation, widened by a Gaussian lag window; prediction gain."""
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    if r[0] <= 0:
        return np.zeros(order), 1.0
    r = r * np.exp(-0.5 * (0.02 * np.arange(order + 1)) ** 2)
    a, error, out = np.ones(1), r[0], []
    for m in range(1, order + 1):
        k = float(np.clip(-(a @ r[m:0:-1][: len(a)]) / error, -0.99, 0.99))
        out.append(k)
        a = np.concatenate([a, [0.0]]) + k * np.concatenate([[0.0], a[::-1]])
        error *= 1 - k * k
    return np.array(out), float(r[0] / max(error, 1e-12))


def reach(rate: int, short: bool, max_band: int) -> int:
    return min(FILTER_BANDS[rate_index(rate)][short], max_band, len(band_widths(rate, short)))


def shape_lines(x: np.ndarray, rate: int, max_band: int, order: int = 12, least_gain: float = 1.4) -> tuple[np.ndarray, list | None]:
    """A long window's lines from 1500 Hz up through a prediction filter, where that gains enough; the filter as payload has it, else null."""
    edge = np.array(offsets(band_widths(rate, False)))
    top = reach(rate, False, max_band)
    first = int(np.searchsorted(edge, 1500 * 2 * LINES / rate))
    if first >= top:
        return x, None
    part = slice(edge[first], edge[top])
    parcor, gain = predictor(x[part], order)
    c = angles(parcor)
    while c and c[-1] == 0:
        c.pop()
    if gain < least_gain or not c:
        return x, None
    out = x.copy()
    out[part] = all_zero(x[part], step_up(reflection(c, 1)))
    return out, [{"resolution": 1, "of": [{"length": len(edge) - 1 - first, "order": len(c), "down": False, "compress": False, "coefficients": c}]}]


def unshape(spec: np.ndarray, c: dict, rate: int) -> None:
    """Runs a channel's filters backwards, in place; spec: windows x lines."""
    short = c["window"]["sequence"] == P.SHORT
    edge = offsets(band_widths(rate, short))
    most = reach(rate, short, c["window"]["max_band"])
    for w, of in enumerate(c["filters"] or ()):
        top = len(edge) - 1
        for f in of["of"]:
            start = max(0, top - f["length"])
            a, b = edge[min(start, most)], edge[min(top, most)]
            top = start
            if f["order"] and b > a:
                lpc = step_up(reflection(f["coefficients"], of["resolution"]))
                part = spec[w, a:b]
                spec[w, a:b] = all_pole(part[::-1], lpc)[::-1] if f["down"] else all_pole(part, lpc)


# --- channels -------------------------------------------------------------------------------------


def with_pulses(c: dict, rate: int) -> np.ndarray:
    """Lines with pulses put in: each moves its line away from zero; offsets add up from the start band's first line."""
    q = np.array(c["lines"])
    if c["pulse"]:
        at = offsets(band_widths(rate, False))[c["pulse"]["start"]]
        for step, amount in c["pulse"]["steps"]:
            at += step
            q[at] += amount if q[at] >= 0 else -amount
    return q


def _noise(seed: int):
    """Endless 32-bit states of the noise generator, as signed numbers over 8."""
    s = seed & 0xFFFFFFFF
    while True:
        s = s * 1664525 + 1013904223 & 0xFFFFFFFF
        yield (s - (1 << 32) if s >> 31 else s) >> 3


def spectrum(c: dict, rate: int, seed: int) -> np.ndarray:
    """Dequantised lines, windows x lines, with noise where a band has it; filters are not run yet."""
    w = c["window"]
    short = w["sequence"] == P.SHORT
    out = np.zeros((8, LINES // 8) if short else (1, LINES))
    q, edge, noise, first = with_pulses(c, rate), offsets(band_widths(rate, short)), _noise(seed), 0
    for n, books, scales, spans in zip(w["groups"], c["books"], c["scales"], P.places(w, rate), strict=True):
        for b, (book, sf, (lo, hi)) in enumerate(zip(books, scales, spans, strict=False)):
            part = out[first : first + n, edge[b] : edge[b + 1]]
            if book in K.SHAPES:
                part[:] = dequantise(q[lo:hi], sf).reshape(n, -1)
            elif book == K.NOISE:
                for k in range(n):
                    x = np.array([next(noise) for _ in range(part.shape[1])], dtype=float)
                    part[k] = x / np.sqrt(x @ x) * 2.0 ** (sf / 4)
        first += n
    return out


def stereo(left: np.ndarray, right: np.ndarray, e: dict, rate: int) -> None:
    """Mid/side and intensity bands of a pair with a shared window, in place."""
    if not e["shared"]:
        return
    w, second = e["shared"], e["channels"][1]
    edge, first = offsets(band_widths(rate, w["sequence"] == P.SHORT)), 0
    for g, n in enumerate(w["groups"]):
        for b, book in enumerate(second["books"][g]):
            part = np.s_[first : first + n, edge[b] : edge[b + 1]]
            on = e["mid_side"] is True or bool(e["mid_side"]) and bool(e["mid_side"][g][b])
            if book in (K.OUT_OF_PHASE, K.IN_PHASE):
                sign = (1 if book == K.IN_PHASE else -1) * (-1 if on and e["mid_side"] is not True else 1)
                right[part] = sign * 0.5 ** (second["scales"][g][b] / 4) * left[part]
            elif on and book != K.NOISE and e["channels"][0]["books"][g][b] != K.NOISE:
                left[part], right[part] = left[part] + right[part], left[part] - right[part]
        first += n


def transform(block: np.ndarray) -> np.ndarray:
    """Lines of 2n windowed samples."""
    return 2 * lines_of(block)


_long, _short = functools.cache(frame_window), functools.cache(short_window)


def halves(spec: np.ndarray, sequence: int, shape: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time halves of a frame: the first if the frame before had shape 0, if it had shape 1, and the second."""
    n, out = LINES, []
    y = samples_of(spec) / spec.shape[1]
    for before in SHAPE_NAMES:
        x = np.zeros(2 * n)
        if sequence == P.SHORT:
            step = n // 8
            for k in range(8):
                at = n // 2 - step // 2 + k * step
                x[at : at + 2 * step] += y[k] * _short(n, k, SHAPE_NAMES[shape], before)
        else:
            x = y[0] * _long(n, SEQUENCES[sequence], SHAPE_NAMES[shape], before)
        out.append(x)
    return out[0][:n], out[1][:n], out[0][n:]


def frame_seed(f: int) -> int:
    return f * 0x9E3779B9 & 0xFFFFFFFF


def decode_block(elements: list[dict], rate: int, f: int) -> list[tuple]:
    """Of each channel of a frame: shape and the halves; channels in the order of elements."""
    out = []
    for e in elements:
        channels = e.get("channels") or []
        specs = [spectrum(c, rate, frame_seed(f)) for c in channels]
        if e["kind"] == P.PAIR:
            stereo(specs[0], specs[1], e, rate)
        for c, s in zip(channels, specs, strict=True):
            unshape(s, c, rate)
            out.append((c["window"]["shape"], *halves(s, c["window"]["sequence"], c["window"]["shape"])))
    return out


def windowed_lines(block: np.ndarray, sequence: int) -> np.ndarray:
    """Lines of a block of 2,048 samples under its window (sine slopes); of eight short windows one after another."""
    if sequence != P.SHORT:
        return transform(block * _long(LINES, SEQUENCES[sequence], "sine", "sine"))
    step = LINES // 8
    first = (LINES - step) // 2
    return transform(np.stack([block[at : at + 2 * step] for at in range(first, first + LINES, step)]) * _short(LINES, 0, "sine", "sine")).reshape(-1)


def block_widths(rate: int, sequence: int) -> list[int]:
    """Bands of a block's lines, of eight short windows one after another."""
    return band_widths(rate, True) * 8 if sequence == P.SHORT else band_widths(rate, False)


def thresholds(x: np.ndarray, widths: list[int]) -> np.ndarray:
    """Noise energy let pass in each band of a window's lines: 16 dB below what the bands beside it spread."""
    edge = np.cumsum([0, *widths])[:-1]
    energy = np.add.reduceat(x * x, edge)
    spread = np.maximum(np.maximum(energy, 0.05 * np.roll(energy, 1) * (np.arange(len(energy)) > 0)), 0.01 * np.roll(energy, -1) * (np.arange(len(energy)) < len(energy) - 1))
    return np.maximum(spread * 10**-1.6, 1e-3)


def short_thresholds(block: np.ndarray, x: np.ndarray, rate: int) -> np.ndarray:
    """Noise energy of each band of eight short windows: their own thresholds; a window that reaches into both frames leaves the quieter one (50 steps a sample at least) alone."""
    step, widths = LINES // 8, band_widths(rate, True)
    first = (LINES - step) // 2
    # lines hold 2 * step times the energy of a sample; two windows have their noise in 1.5 of the frame's 8 parts
    quiet = max(_quieter(block), 2560.0 * LINES) / (LINES / 2) * 2 * step * 10**-1.8 * np.array(widths)
    own = [thresholds(w, widths) for w in x.reshape(8, -1)]
    return np.concatenate([np.minimum(t, quiet) if first + k * step < LINES < first + (k + 2) * step else t for k, t in enumerate(own)])


def _quieter(block: np.ndarray) -> float:
    return float((block.reshape(2, -1) ** 2).sum(axis=1).min())


def entropy(x: np.ndarray, t: np.ndarray, widths: list[int]) -> float:
    return float((np.array(widths) * np.log2(1 + np.sqrt(np.add.reduceat(x * x, np.cumsum([0, *widths])[:-1]) / t))).sum())


def prefers_short(blocks: list[np.ndarray], rate: int) -> bool:
    """Whether short windows take fewer bits to leave the quieter of a block's two frames alone; blocks: of each channel.

    A long window's noise lies in both frames.  A band that is heard counts 6
    bits besides its lines.
    """
    energy = [(b.reshape(2, -1) ** 2).sum(axis=1) for b in blocks]
    if not any(2 * e.min() < e.max() for e in energy):
        return False
    bits = [0.0, 0.0]
    for b in blocks:
        for k, sequence in enumerate((0, P.SHORT)):
            x, widths = windowed_lines(b, sequence), block_widths(rate, sequence)
            t = np.minimum(thresholds(x, widths), max(_quieter(b), 2560.0 * LINES) * 2 * 10**-1.6 * np.array(widths)) if k == 0 else short_thresholds(b, x, rate)
            bits[k] += entropy(x, t, widths) + 6 * int((np.add.reduceat(x * x, np.cumsum([0, *widths])[:-1]) > t).sum())
    return bits[1] < bits[0]


def sequence_of(before: bool, here: bool, after: bool) -> int:
    """Window of a block by which of three blocks prefer short ones: start and stop lie beside these, and a block between two is short."""
    return P.SHORT if here or before and after else 1 if after else 3 if before else 0


def encode_block(spectra: list[np.ndarray], thresholds: list, entropy: list[float], rate: int, budget: int, books: dict, shaping: bool = True, sequence: int = 0) -> bytes:
    """A raw block of one or two channels within `budget` bits; sequence: the window that the lines are of."""
    short = sequence == P.SHORT
    widths, bands = block_widths(rate, sequence), len(band_widths(rate, short))
    lengths = word_lengths(books)
    shaped = [shape_lines(x, rate, len(widths)) if shaping and not short else (x, None) for x in spectra]
    edge = offsets(widths)[:-1]
    # what a filter takes from a band's energy, the decoder's puts back onto the noise
    thresholds = [t if f is None else t * np.minimum(1.0, np.add.reduceat(y * y, edge) / np.maximum(np.add.reduceat(x * x, edge), 1e-30)) for t, x, (y, f) in zip(thresholds, spectra, shaped, strict=True)]
    # short windows: 4 bits more to describe them, a run's end at each window's, and lengths of 7 bands and more in several parts
    room = budget - 3 - 7 - sum(8 + 11 + 3 + 120 * (f is not None) + (4 + 8 * (9 + 3 * (bands // 7))) * short for _, f in shaped) - 10
    got = fit_channels([x for x, _ in shaped], widths, thresholds, room, entropy, lengths)
    channels = []
    for g, (_, f) in zip(got, shaped, strict=True):
        coded = g["sf"][g["book"] > 0]
        by_window = lambda x: x.reshape(-1, bands).tolist()
        channels.append({"gain": int(coded[0]) if len(coded) else 100, "window": {"sequence": sequence, "shape": 0, "max_band": bands, "groups": [1] * (8 if short else 1)}, "books": by_window(g["book"]), "scales": by_window(np.where(g["book"] > 0, g["sf"], 0)), "pulse": None, "filters": f, "lines": g["q"].tolist()})
    io = Writer()
    elements = [{"kind": P.SINGLE, "tag": 0, "channels": channels}] if len(channels) == 1 else [{"kind": P.PAIR, "tag": 0, "shared": None, "channels": channels}]
    P.block(io, elements, rate, books)
    return io.data
