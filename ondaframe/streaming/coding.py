"""Coding and detection under Structured Streaming, with the same state handling as the folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import books as K
from ..functions.tables import band_widths
from ..operators import coder as C
from ..operators import folds as O
from ..operators import payload as P
from ..operators.bitio import Reader
from ..operators.transforms import sine_window
from .folds import _stateful

N = P.LINES


def decode(payloads: DataFrame, rate: int, books: dict | None = None) -> DataFrame:
    """stream, n, samples (channel after channel): payloads (stream, n, x array<int>, the bytes) decoded, a frame late.

    What the last frame reaches into the next one is the state.  A payload that
    cannot be read gives no samples, and the next one starts from silence.
    """
    books = books or K.by_rule()

    def step(x, state):
        number, tails = state or (0, None)
        try:
            got = C.decode_block(P.block(Reader(bytes(x.astype(np.uint8))), [], rate, books), rate, number)
        except ValueError:
            return {"samples": np.zeros(0)}, (number + 1, None)
        tails = tails if tails and len(tails) == len(got) else [(0, np.zeros(N))] * len(got)
        y = [np.clip(np.rint((b if shape else a) + tail), -32768, 32767) for (_, a, b, _), (shape, tail) in zip(got, tails, strict=True)]
        return {"samples": np.concatenate(y)}, (number + 1, [(g[0], g[3]) for g in got])

    return _stateful(payloads, step, "stream string, n bigint, samples array<double>")


def encode(frames: DataFrame, rate: int, bitrate: int = 128_000, books: dict | None = None) -> DataFrame:
    """stream, n, payload (bytes as array<double>): frames (stream, n, x of 1,024 samples), each behind the one before."""
    books = books or K.by_rule()
    widths, window = band_widths(rate, False), sine_window(2 * N)

    def step(x, before):
        lines = C.transform(np.concatenate([np.zeros(N) if before is None else before, x]) * window)
        energy = np.add.reduceat(lines * lines, np.cumsum([0, *widths])[:-1])
        data = C.encode_block([lines], [np.maximum(energy * 10**-1.6, 1e-3)], [1.0], rate, bitrate * N // rate, books)
        return {"payload": np.frombuffer(data, np.uint8).astype(float)}, x

    return _stateful(frames, step, "stream string, n bigint, payload array<double>")


def attacks(frames: DataFrame) -> DataFrame:
    """stream, n, place (-1: none): attacks in frames (stream, n, x); the filter's state and the energies that still have weight are kept."""
    system = O.highpass()

    def step(x, state):
        held, energies = state or (None, np.zeros((0, 8)))
        y, held = system.then(x, held)
        energies = np.concatenate([energies, O.sub_energies(y[None])])
        _, place = O.attacks(energies)
        return {"place": place[-1:].astype(float)}, (held, energies[-(O.MEMORY // 8 + 3) :])

    return _stateful(frames, step, "stream string, n bigint, place array<double>")
