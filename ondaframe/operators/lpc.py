"""Linear prediction: analysis, line spectra, their spacing and their blending."""

from __future__ import annotations

import numpy as np

#: Order, line spectra's scale (their value at half the rate), least spacing.
ORDER, HALF_RATE, GAP = 16, 6400.0, 50.0
#: Weight of the new frame's line spectra in each quarter.
BLEND = [0.125, 0.375, 0.625, 0.875]


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Direct-form coefficients, reflection coefficients and error of many autocorrelations (rows) at once."""
    a = np.zeros((len(r), order + 1))
    a[:, 0] = 1
    error, ks = np.maximum(r[:, 0], 1e-12), np.zeros((len(r), order))
    for m in range(1, order + 1):
        k = -(a[:, :m] * r[:, m:0:-1]).sum(axis=1) / error
        a[:, 1 : m + 1] += k[:, None] * a[:, m - 1 :: -1][:, :m] if m > 1 else k[:, None] * a[:, :1]
        error = np.maximum(error * (1 - k * k), 1e-12)
        ks[:, m - 1] = k
    return a, ks, error


def analyse(x: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Coefficients of rows of samples, by the Hamming-windowed autocorrelation."""
    n = x.shape[1]
    w = x * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    r = np.stack([(w[:, : n - k] * w[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1)
    r[:, 0] = r[:, 0] * 1.000001 + 1e-9
    return levinson(r, order)[0]


def to_lines(a: np.ndarray) -> np.ndarray:
    """Line spectra of one set of coefficients: angles of the roots of its sum and difference polynomials, on the unit circle."""
    p = np.append(a, 0) + np.append(0, a[::-1])
    q = np.append(a, 0) - np.append(0, a[::-1])
    angle = np.concatenate([np.angle(np.roots(p)), np.angle(np.roots(q))])
    inside = np.sort(angle[(angle > 1e-7) & (angle < np.pi - 1e-7)])
    return inside / np.pi * HALF_RATE


def from_lines(lines: np.ndarray) -> np.ndarray:
    """Coefficients of line spectra: products of second-order factors, alternate lines each."""
    half = []
    for first, edge in ((0, [1.0, 1.0]), (1, [1.0, -1.0])):
        poly = np.array(edge)
        for f in lines[first::2]:
            poly = np.convolve(poly, [1.0, -2 * np.cos(f / HALF_RATE * np.pi), 1.0])
        half.append(poly)
    return ((half[0] + half[1]) / 2)[: len(lines) + 1]


def spaced(lines: np.ndarray, gap: float = GAP) -> np.ndarray:
    """Lines at least `gap` apart and from both ends: pushed up from below, then down from above.

    Either push is a running extreme of the lines less their due places.
    """
    at = gap * np.arange(1, lines.shape[-1] + 1)
    up = np.maximum(np.maximum.accumulate(lines - at, axis=-1), 0) + at
    over = HALF_RATE - at[::-1]
    return np.minimum(np.minimum.accumulate((up - over)[..., ::-1], axis=-1)[..., ::-1], 0) + over


def blended(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Line spectra of the four quarters between two frames."""
    w = np.array(BLEND)[:, None]
    return (1 - w) * before + w * now
