"""Lapped transforms and windows over array columns.

A frame's transform is one row's matter: arrays go to NumPy in Arrow batches,
a whole batch in one matrix product, and no row leaves its partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def mdct_matrix(n: int) -> np.ndarray:
    """n x 2n cosines of the lapped transform."""
    k, t = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))


def lines_of(x: np.ndarray) -> np.ndarray:
    """Lapped transform of rows of 2n samples to n lines, by one FFT of 2n points a row."""
    n = x.shape[-1] // 2
    t, k = np.arange(2 * n), np.arange(n) + 0.5
    y = np.fft.fft(x * np.exp(-0.5j * np.pi * t / n))[..., :n]
    return (y * np.exp(-1j * np.pi / n * (0.5 + n / 2) * k)).real


def samples_of(lines: np.ndarray) -> np.ndarray:
    """The transposed transform: rows of n lines to 2n samples."""
    n = lines.shape[-1]
    t, k = np.arange(2 * n), np.arange(n) + 0.5
    z = np.fft.ifft(lines * np.exp(1j * np.pi / n * (0.5 + n / 2) * k), 2 * n) * (2 * n)
    return (z * np.exp(0.5j * np.pi * t / n)).real


def _by_batch(f):
    """A pandas function of equal-length arrays from a function of one matrix."""

    def run(*cols: pd.Series) -> pd.Series:
        if not len(cols[0]):
            return pd.Series([], dtype=object)
        return pd.Series(list(f(*[np.stack(c.to_numpy()).astype(float) for c in cols])))

    return run


def mdct(block: Column, n: int) -> Column:
    """Forward transform of 2n samples to n lines, times 2."""

    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return _by_batch(lambda a: 2 * lines_of(a))(x)

    return run(block)


def imdct(lines: Column, n: int) -> Column:
    """Inverse transform of n lines to 2n samples, over n."""

    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return _by_batch(lambda a: samples_of(a) / n)(x)

    return run(lines)


def fft(re: Column, im: Column, inverse: bool = False) -> Column:
    """struct(re, im) of arrays; forward unnormalised, inverse over n."""

    @pandas_udf("struct<re:array<double>,im:array<double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"re": [], "im": []})
        x = np.stack(a.to_numpy()) + 1j * np.stack(b.to_numpy())
        y = np.fft.ifft(x) if inverse else np.fft.fft(x)
        return pd.DataFrame({"re": list(y.real), "im": list(y.imag)})

    return run(re, im)


def sine_window(length: int) -> np.ndarray:
    return np.sin(np.pi * (np.arange(length) + 0.5) / length)


def kbd_window(length: int, alpha: float) -> np.ndarray:
    """Kaiser-Bessel derived window; the Bessel function's series to 24 terms."""

    def bessel(x: np.ndarray) -> np.ndarray:
        k = np.arange(1, 25)
        return 1 + np.cumprod((0.5 * np.asarray(x)[..., None] / k) ** 2, axis=-1).sum(axis=-1)

    half = length // 2
    x = 2 * np.arange(half + 1) / half - 1
    rise = np.cumsum(bessel(np.pi * alpha * np.sqrt(np.maximum(0, 1 - x * x))))
    up = np.sqrt(rise[:half] / rise[half])
    return np.concatenate([up, up[::-1]])


def low_delay_window(length: int) -> np.ndarray:
    n = np.arange(length) + 0.5
    return np.sin(np.pi / 2 * n / length) * (1 - 0.1 * np.cos(2 * np.pi * n / length))


def shape_half(length: int, shape: str, alpha: float) -> np.ndarray:
    """Rising half, of `length` samples, of a window twice as long."""
    return (sine_window(2 * length) if shape == "sine" else kbd_window(2 * length, alpha))[:length]


def frame_window(n: int, sequence: str, shape: str = "sine", before: str = "sine") -> np.ndarray:
    """2n-sample window of a long frame: the last frame's shape rises, this one's falls.

    start and stop frames meet short windows of n/8 on the falling or rising side.
    """
    short = n // 8
    flat = (n - short) // 2
    rise = shape_half(n, before, 4.0) if sequence != "stop" else np.concatenate([np.zeros(flat), shape_half(short, before, 6.0), np.ones(flat)])
    fall = shape_half(n, shape, 4.0) if sequence != "start" else np.concatenate([np.zeros(flat), shape_half(short, shape, 6.0), np.ones(flat)])
    return np.concatenate([rise, fall[::-1]])


def short_window(n: int, index: int, shape: str = "sine", before: str = "sine") -> np.ndarray:
    """Window `index` of eight; only the first rises in the last frame's shape."""
    short = n // 8
    return np.concatenate([shape_half(short, before if index == 0 else shape, 6.0), shape_half(short, shape, 6.0)[::-1]])


def doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def windowed(x: Column, window: np.ndarray) -> Column:
    return F.zip_with(x, doubles(window), lambda v, w: v * w)


def resample_positions(n: int, in_rate: int, out_rate: int, taps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Input index (-1: outside) and weight of each tap of each output; weights sum to 1."""
    ratio = out_rate / in_rate
    out = int(np.floor(n * ratio))
    pos = np.arange(out) / ratio
    centre = np.floor(pos).astype(int)
    t = np.arange(-taps // 2, taps // 2)
    tap = t[None, :] - (pos - centre)[:, None]
    cut = 0.45 * min(1.0, ratio)
    weight = np.sinc(tap * 2 * cut) * np.sqrt(np.maximum(0, 1 - (tap / (taps // 2)) ** 2))
    at = centre[:, None] + t[None, :]
    inside = (at >= 0) & (at < n)
    weight = np.where(inside, weight, 0)
    total = weight.sum(axis=1, keepdims=True)
    return np.where(inside, at, -1), np.where(np.abs(total) > 1e-6, weight / np.where(total == 0, 1, total), 0)


def resample(x: Column, n: int, in_rate: int, out_rate: int) -> Column:
    """A block of n samples at another rate, by windowed sincs."""
    at, weight = resample_positions(n, in_rate, out_rate)
    m = np.zeros((len(at), n))
    np.add.at(m, (np.repeat(np.arange(len(at)), at.shape[1]), np.maximum(at, 0).reshape(-1)), weight.reshape(-1))

    @pandas_udf("array<double>")
    def run(a: pd.Series) -> pd.Series:
        return _by_batch(lambda v: v @ m.T)(a)

    return run(x)
