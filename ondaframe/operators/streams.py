"""Encoding and decoding as DataFrame steps.

Frames are rows and stay rows: a frame meets the one before it by both being
sent to one frame number, so a stream is worked on by as many tasks as there
are frames, and no stream is ever whole in one place.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import bits as B
from ..functions import books as K
from ..functions.tables import RATES
from . import coder as C
from . import payload as P
from .bitio import Reader

N = P.LINES


def by_row(df: DataFrame, f: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Rows that f makes of each row, in Arrow batches."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r for x in batch.slice(at, 256).to_pylist() for r in f(x)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return df.mapInArrow(run, schema)


def framed(samples: DataFrame, size: int = N) -> DataFrame:
    """stream, f, x: frames of `size` samples, the last filled up with zeros, and one of zeros that closes the stream."""
    cut = samples.groupBy("stream", F.floor(F.col("n") / size).alias("f")).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    x = F.transform("r", lambda r: r["s"].cast("double"))
    whole = cut.select("stream", "f", F.concat(x, F.array_repeat(F.lit(0.0), F.lit(size) - F.size("r"))).alias("x"))
    ends = samples.groupBy("stream").agg((F.floor(F.max("n") / size) + 1).alias("f"))
    return whole.unionByName(ends.select("stream", "f", F.array_repeat(F.lit(0.0), size).alias("x")))


def encode(channels: list[str], rate: int = 44100, bitrate: int = 128_000, books: dict | None = None, shaping: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Step: frames (stream, f, and an array column of N samples a channel; one or two) to (stream, f, payload).

    A frame's payload keeps the bit rate.  Windows are long; where one frame is
    much quieter than the one beside it they are short if that is cheaper (see
    coder.prefers_short).  The window behind the last frame must be there (see
    framed): its block completes the samples.
    books: see functions.books.
    """
    books = books or K.by_rule()
    budget = bitrate * N // rate
    #: Frames that a block is told of, by the place from its own: it is made of -1 and 0, and the others say what windows lie beside it.
    near = {"o": -2, "p": -1, "x": 0, "n": 1}

    def code(r: dict) -> list[dict]:
        of = {a: [np.array(r[f"{a}{k}"]) for k in range(len(channels))] if r[f"{a}0"] is not None else None for a in near}

        def short(a: str, b: str, heard: bool) -> bool:
            # the first block and the closing one have only one frame that is heard
            return heard and of[a] is not None and of[b] is not None and C.prefers_short([np.concatenate(x) for x in zip(of[a], of[b], strict=True)], rate)

        sequence = C.sequence_of(short("o", "p", True), short("p", "x", of["n"] is not None), short("x", "n", r["more"] is not None))
        blocks = [np.concatenate(b) for b in zip(of["p"] or [np.zeros(N)] * len(channels), of["x"], strict=True)]
        spectra, widths = [C.windowed_lines(b, sequence) for b in blocks], C.block_widths(rate, sequence)
        t = [C.short_thresholds(b, x, rate) if sequence == P.SHORT else C.thresholds(x, widths) for b, x in zip(blocks, spectra, strict=True)]
        entropy = [C.entropy(x, m, widths) for x, m in zip(spectra, t, strict=True)]
        return [{"stream": r["stream"], "f": r["f"], "payload": C.encode_block(spectra, t, entropy, rate, budget, books, shaping, sequence)}]

    def run(df: DataFrame) -> DataFrame:
        cols = [f"{a}{k}" for a in near for k in range(len(channels))]

        def sent(place: int) -> DataFrame:
            arrays = [(F.col(c) if at == place else F.lit(None)).cast("array<double>").alias(f"{a}{k}") for a, at in near.items() for k, c in enumerate(channels)]
            return df.select("stream", (F.col("f") - place).alias("f"), *arrays, (F.lit(True) if place == 2 else F.lit(None).cast("boolean")).alias("more"))

        every = functools.reduce(DataFrame.unionByName, map(sent, (*near.values(), 2)))
        met = every.groupBy("stream", "f").agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*cols, "more"]]).where(F.col("x0").isNotNull())
        return by_row(met, code, f"stream {df.schema['stream'].dataType.simpleString()}, f bigint, payload binary")

    return run


def elements(frames: DataFrame, rate: int, books: dict | None = None) -> DataFrame:
    """A row per element of each payload: stream, f, at, kind, tag, channels; a payload that cannot be read is one row with its error."""
    books = books or K.by_rule()

    def rows(r: dict) -> list[dict]:
        try:
            got = P.block(Reader(r["payload"]), [], rate, books)
            return [{"stream": r["stream"], "f": r["f"], "at": k, "kind": e["kind"], "tag": e.get("tag"), "channels": len(e.get("channels") or ()), "error": None} for k, e in enumerate(got)]
        except ValueError as e:
            return [{"stream": r["stream"], "f": r["f"], "at": None, "kind": None, "tag": None, "channels": 0, "error": f"{type(e).__name__}: {e}"}]

    return by_row(frames.select("stream", "f", "payload"), rows, f"stream {frames.schema['stream'].dataType.simpleString()}, f bigint, at int, kind int, tag int, channels int, error string")


def _lists(rows: list) -> pa.Array:
    """array<double> of equal-length arrays, null where there is none."""
    found = [r for r in rows if r is not None]
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
    flat = pa.array(np.concatenate(found) if found else np.zeros(0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([r is None for r in rows]))


def _halves(frames: DataFrame, rate: int, books: dict) -> DataFrame:
    """A row per frame and channel with its halves (see coder.halves), or one with its error."""
    key = to_arrow_schema(StructType([frames.schema["stream"]])).field(0).type
    names = ["stream", "f", "channel", "shape", "a", "b", "tail", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for stream, f, payload in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    try:
                        got = C.decode_block(P.block(Reader(payload), [], rate, books), rate, f)
                        out += [(stream, f, k, s, a, b, t, None) for k, (s, a, b, t) in enumerate(got)]
                    except ValueError as e:
                        out.append((stream, f, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], key), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), *map(_lists, c[4:7]), pa.array(c[7], pa.string())], names)

    return frames.select("stream", "f", "payload").mapInArrow(run, f"stream {frames.schema['stream'].dataType.simpleString()}, f bigint, channel int, shape int, a array<double>, b array<double>, tail array<double>, error string")


def to_pcm(x: Column) -> Column:
    """Saturated 16-bit samples, halves to even."""
    return F.transform(x, lambda v: F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.rint(v))).cast("int"))


def decode(rate: int = 44100, books: dict | None = None) -> Callable[[DataFrame], DataFrame]:
    """Step: (stream, f, payload) to (stream, f, channel, samples, error), a frame late: frame f holds the samples of input frame f - 1.

    A payload that is broken or asks for something that is not implemented
    gives a row with its error and no samples; the frame after it starts from
    silence.
    """

    def run(df: DataFrame) -> DataFrame:
        half = _halves(df, rate, books or K.by_rule())
        none = F.lit(None).cast("array<double>")
        own = half.select("stream", "f", "channel", "a", "b", none.alias("tail"), F.lit(None).cast("int").alias("shape"), "error")
        later = half.where(F.col("error").isNull()).select("stream", (F.col("f") + 1).alias("f"), "channel", none.alias("a"), none.alias("b"), "tail", "shape", F.lit(None).cast("string").alias("error"))
        met = own.unionByName(later).groupBy("stream", "f", "channel").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("a", "b", "tail", "shape", "error")])
        head = F.when(F.col("shape") == 1, F.col("b")).otherwise(F.col("a"))
        x = F.zip_with(head, F.coalesce("tail", F.array_repeat(F.lit(0.0), N)), lambda u, v: u + v)
        return met.where(F.col("a").isNotNull() | F.col("error").isNotNull()).select("stream", "f", "channel", to_pcm(x).alias("samples"), "error")

    return run


def decode_whole(payloads: list[bytes], rate: int, books: dict | None = None, first: int = 0) -> np.ndarray:
    """Channels x samples of payloads in a row, one after another, frame numbers from `first`."""
    books = books or K.by_rule()
    out, tails, shapes = [], None, None
    for f, payload in enumerate(payloads, first):
        got = C.decode_block(P.block(Reader(payload), [], rate, books), rate, f)
        tails = tails or [np.zeros(N)] * len(got)
        shapes = shapes or [0] * len(got)
        out.append([np.clip(np.rint((b if s else a) + t), -32768, 32767) for (_, a, b, _), s, t in zip(got, shapes, tails, strict=True)])
        tails, shapes = [g[3] for g in got], [g[0] for g in got]
    return np.concatenate(out, axis=1) if out else np.zeros((0, 0))


def as_adts(frames: DataFrame, rate: int, channels: int) -> DataFrame:
    """Adds packet: payload behind a seven-byte header."""
    size = F.octet_length("payload") + 7
    return frames.withColumn("packet", F.concat(B.adts_header(F.lit(2), F.lit(RATES.index(rate)), F.lit(channels), size, F.lit(0x7FF)), F.col("payload")))
