"""Shaping of lines and sub-bands: recurrences over a frame's lines, a batch of frames at a time."""

from __future__ import annotations

import math

import numpy as np


def smoothed(w: np.ndarray) -> np.ndarray:
    """Each line's weight averaged with the smoothed one after it, then with the smoothed one before it; the outermost stay.  Rows x lines."""
    out = w.copy()
    for way in (slice(None, None, -1), slice(None)):
        x = out[:, way]
        for k in range(1, x.shape[1]):
            x[:, k] = (x[:, k] + x[:, k - 1]) / 2
    return out


def whitened(x: np.ndarray, widths: list[int]) -> np.ndarray:
    """Lines times the smoothed inverse root of their band's energy; the last band has the weight of the one before it."""
    edge = np.cumsum([0, *widths])
    weight = 1 / np.sqrt(np.add.reduceat(x * x, edge[:-1], axis=1) + 1e-30)
    if len(widths) > 1:
        weight[:, -1] = weight[:, -2]
    return x * smoothed(np.repeat(weight, widths, axis=1))


def noise_shaped(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A first-order recurrence whose coefficients follow from the gains at a block's start and end; even lines then come first, odd ones last and backwards.  Rows x lines, rows x blocks."""
    total = np.where(start + end == 0, 1, start + end)
    a, b = np.where(start + end == 0, 0, 2 * start * end / total), np.where(start + end == 0, 0, (end - start) / total)
    block = x.shape[1] // start.shape[1]
    y, before = np.empty_like(x), np.zeros(len(x))
    for k in range(x.shape[1]):
        at = min(k // block, start.shape[1] - 1)
        before = y[:, k] = a[:, at] * x[:, k] + b[:, at] * before
    return np.concatenate([y[:, ::2], y[:, ::-1][:, ::2]], axis=1)


def all_pass(x: np.ndarray, turn: complex, decay: float) -> np.ndarray:
    """One section over rows x slots: what the delay holds, turned, less a share of the input."""
    y, line = np.empty_like(x), np.zeros(len(x), dtype=complex)
    for k in range(x.shape[1]):
        y[:, k] = turn * line - decay * x[:, k]
        line = x[:, k] + decay * y[:, k]
    return y


def arrangement(rank: int, values: list[int]) -> list[int]:
    """The rank-th distinct order of values; a value that stands earlier among them comes first."""
    left = {v: values.count(v) for v in values}
    ways = math.factorial(len(values)) // math.prod(map(math.factorial, left.values()))
    if not 0 <= rank < ways:
        raise ValueError(f"rank {rank} of {ways}")
    out = []
    for n in range(len(values), 0, -1):
        for v, count in left.items():
            first = ways * count // n  # orders that begin with v
            if rank < first:
                out.append(v)
                left[v], ways = count - 1, first
                break
            rank -= first
    return out
