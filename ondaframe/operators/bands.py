"""Bands of the replicated range (formulas of ISO/IEC 14496-3, 4.6.18.3)."""

from __future__ import annotations

import numpy as np

#: First band's offsets by start index, by rate that stands for others; least rates that each stands for.
START = {
    16000: [-8, -7, -6, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7], 22050: [-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13], 24000: [-5, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16],
    32000: [-6, -4, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16], 40000: [-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 15, 17, 19], 44100: [-4, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 20],
    48000: [-4, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 20], 64000: [-4, -2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 20], 88200: [-2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 20, 24], 96000: [-2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 16, 20, 24],
}
LEAST_RATE = {16000: 0, 22050: 18783, 24000: 23004, 32000: 27713, 40000: 35777, 44100: 42000, 48000: 46009, 64000: 55426, 88200: 75132, 96000: 92017}
#: Most bands in a range, most noise bands, bands an octave by scale, warp of the upper part.
MOST, MOST_NOISE, PER_OCTAVE, WARP = 49, 5, {1: 12, 2: 10, 3: 8}, 1.3


def stood_for(rate: int) -> int:
    return max((r for r, least in LEAST_RATE.items() if rate >= least), key=LEAST_RATE.get)


def _half_up(x):
    return np.floor(np.asarray(x) + 0.5).astype(int)


def ends(start: int, stop: int, rate: int) -> tuple[int, int]:
    """First band and the one past the last, of 64 bands at the output rate."""
    by = stood_for(rate)
    anchor = lambda r, low: low * (1 if r < 32000 else 4 / 3 if r < 64000 else 5 / 3)
    k0 = int(_half_up(anchor(by, 3000) * 128 / by)) + START[by][start]
    if stop >= 14:
        k2 = k0 * (stop - 12)
    else:
        low = int(_half_up(anchor(rate, 6000) * 128 / rate))
        k2 = low + int(np.sort(np.diff(_half_up(low * (64 / low) ** (np.arange(14) / 13))))[:stop].sum())
    k0, k2 = min(max(k0, 0), 64), min(max(k2, 0), 64)
    if not 0 < k2 - k0 <= MOST:
        raise ValueError(f"a replicated range from {k0} to {k2}")
    return k0, k2


def _geometric(a: int, b: int, n: int) -> np.ndarray:
    return np.sort(np.diff(_half_up(a * (b / a) ** (np.arange(n + 1) / n))))


def master(k0: int, k2: int, scale: int, warp: bool) -> np.ndarray:
    """Edges of the finest bands.

    scale 0: equal widths of 1, or 2 with warp, the odd lines shared out at
    the end that they fall at.  Else widths grow geometrically, and where the
    range is over about 1.17 octaves its first octave apart from the rest.
    """
    if not scale:
        step = 1 + warp
        n = 2 * ((k2 - k0 + 2) // 4) if warp else (k2 - k0) // 2 * 2
        if not n:
            raise ValueError("no bands")
        width = np.full(n, step)
        left = k2 - k0 - n * step
        if left > 0:
            width[n - left :] += 1
        elif left < 0:
            width[:-left] -= 1
        return k0 + np.concatenate([[0], np.cumsum(width)])
    per, two = PER_OCTAVE[scale], 10000 * k2 > 22449 * k0
    middle = 2 * k0 if two else k2
    count = lambda a, b, w: 2 * int(_half_up(per * np.log2(b / a) / (2 * w)))
    n = count(k0, middle, 1.0)
    if n < 1:
        raise ValueError("no bands")
    width = _geometric(k0, middle, n)
    if two:
        m = count(middle, k2, WARP if warp else 1.0)
        if m < 1:
            raise ValueError("no bands in the upper part")
        upper = _geometric(middle, k2, m)
        if upper[0] < width[-1]:  # widths may not fall from the lower to the upper part
            move = min(width[-1] - upper[0], (upper[-1] - upper[0]) // 2)
            upper = np.sort(np.concatenate([[upper[0] + move], upper[1:-1], [upper[-1] - move]])) if m > 1 else upper
        width = np.concatenate([width, upper])
    elif not width[0]:
        raise ValueError("a band without width")
    return k0 + np.concatenate([[0], np.cumsum(width)])


def resolutions(edges: np.ndarray, crossover: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse and fine bands above the crossover: every second edge counted from the top, and the lowest."""
    if crossover >= len(edges):
        raise ValueError("the crossover is past the last band")
    fine = edges[crossover:]
    return fine[[0, *list(range(len(fine) - 1, 0, -2))[::-1]]], fine


def noise_bands(coarse: np.ndarray, index: int) -> np.ndarray:
    """Edges of 1 to 5 noise bands, spread over the coarse ones."""
    n = max(1, int(_half_up(index * np.log2(coarse[-1] / coarse[0])))) if index else 1
    if n > MOST_NOISE:
        raise ValueError(f"{n} noise bands")
    at = [0]
    for k in range(n):
        at.append(at[-1] + (len(coarse) - 1 - at[-1]) // (n - k))
    return coarse[at]
