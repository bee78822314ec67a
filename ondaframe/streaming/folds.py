"""Ordered per-stream operators under Structured Streaming.

A stream's samples arrive in blocks (stream, n, x) of any length; the state of
a fold travels from one micro-batch to the next, so that a stream gives the
same samples however it is cut.  Blocks of a stream are taken in order of n
within a micro-batch; a block that comes before what was already seen is late
and dropped, like a corrupt frame.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators import folds


def _stateful(blocks: DataFrame, step, schema: str) -> DataFrame:
    """step(x, state) -> (columns, state) over each stream's blocks in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, held = pickle.loads(state.get[0]) if state.exists else (-1, None)
        for _, row in pd.concat(list(frames)).sort_values("n", kind="stable").iterrows():
            if row["n"] <= seen:
                continue
            columns, held = step(np.asarray(row["x"], dtype=float), held)
            seen = row["n"]
            yield pd.DataFrame({"stream": [key[0]], "n": [seen], **{k: [v.tolist()] for k, v in columns.items()}})
        state.update((pickle.dumps((seen, held)),))

    return blocks.groupBy("stream").applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def k_weighting(blocks: DataFrame, rate: int) -> DataFrame:
    """stream, n, y: loudness-weighted samples."""

    def step(x, state):
        y, state = folds.weighted(x, rate, state)
        return {"y": y}, state

    return _stateful(blocks, step, "stream string, n bigint, y array<double>")


def peak_limiter(blocks: DataFrame, rate: int) -> DataFrame:
    """stream, n, y, gain: limited samples, late by the attack time."""

    def step(x, state):
        y, gain, state = folds.limit(x[:, None], rate, state)
        return {"y": y[:, 0], "gain": gain}, state

    return _stateful(blocks, step, "stream string, n bigint, y array<double>, gain array<double>")
