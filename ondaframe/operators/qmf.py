"""Complex filterbanks: modulated banks of many bands, and the split of the lowest bands.

The prototype is a parameter.  Without one it is designed by rule: a Kaiser
low-pass of ten slots whose cut makes its own autocorrelation vanish at every
second slot, so that analysis and synthesis give the input back nearly.  Banks
that must meet another encoder's take the standard's prototype.
"""

from __future__ import annotations

import functools

import numpy as np

SLOTS = 10


@functools.cache
def designed(bands: int) -> tuple[float, ...]:
    """Prototype of SLOTS * bands taps, of unit energy over a band."""
    n = SLOTS * bands
    t = np.arange(n) - (n - 1) / 2
    window = np.kaiser(n, 9.0)

    def low_pass(cut: float) -> tuple[np.ndarray, float]:
        p = np.sinc(t * cut / np.pi) * window
        p /= np.sqrt(p @ p)
        r = np.correlate(p, p, "full")[n - 1 :: 2 * bands]
        return p, float(np.abs(r[1:]).max())

    grid = np.pi / bands * np.linspace(0.4, 0.8, 401)
    best = min(grid, key=lambda c: low_pass(c)[1])
    fine = best + np.pi / bands * np.linspace(-0.001, 0.001, 201)
    return tuple(low_pass(min(fine, key=lambda c: low_pass(c)[1]))[0].tolist())


def bank(bands: int, prototype=None) -> np.ndarray:
    """bands x taps: band k turns by (k + 1/2) half turns a slot, about the middle tap."""
    p = np.asarray(designed(bands) if prototype is None else prototype)
    t = np.arange(len(p)) - (len(p) - 1) / 2
    return p * np.exp(1j * np.pi / bands * (np.arange(bands)[:, None] + 0.5) * t)


def analyse(x: np.ndarray, bands: int, prototype=None) -> np.ndarray:
    """Slots x bands of samples with (taps - bands) samples of history in front; a slot's newest sample meets the first tap."""
    h = bank(bands, prototype)
    taps = h.shape[1]
    parts = np.lib.stride_tricks.sliding_window_view(x, taps)[::bands]
    return parts[:, ::-1] @ h.T


def synthesise(slots: np.ndarray, prototype=None) -> np.ndarray:
    """Samples of slots x bands, with the taps - bands that reach into the next slots at the end; late by taps - bands against the samples that analyse() got."""
    n, bands = slots.shape
    h = bank(bands, prototype)
    parts = (slots @ np.conj(h[:, ::-1])).real
    out = np.zeros((n - 1) * bands + h.shape[1])
    for k in range(n):
        out[k * bands : k * bands + h.shape[1]] += parts[k]
    return out


#: Half of the symmetric 13-tap filters that split a band in eight and in two.
EIGHT = [0.00746082949812, 0.02270420949825, 0.04546865930473, 0.07266113929591, 0.09885108575264, 0.11793710567217, 0.125]
TWO = [0.0, 0.01899487526049, 0.0, -0.07293139167538, 0.0, 0.30596630545168, 0.5]


def splitter(parts: int) -> np.ndarray:
    """parts x 13: the filters of the sub-bands of a band; they add up to a delay of six slots."""
    g = np.array([*(EIGHT if parts == 8 else TWO), *(EIGHT if parts == 8 else TWO)[-2::-1]])
    t, q = np.arange(13) - 6, np.arange(parts)[:, None]
    return g * np.exp(2j * np.pi / 8 * (q + 0.5) * t) if parts == 8 else g * np.cos(np.pi * q * t)


def split(z: np.ndarray, parts: int) -> np.ndarray:
    """Slots x parts of one band's slots, six slots late."""
    return np.stack([np.convolve(z, h)[: len(z)] for h in splitter(parts)], axis=1)
