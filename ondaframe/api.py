"""Composable steps for df.transform(...), and readers.

Frames are rows (stream, f, x array<double>); spectra are (stream, f, y).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import psycho, quant
from .operators import folds, streams
from .operators import transforms as T
from .sources import containers, signals

Step = Callable[[DataFrame], DataFrame]

read_adts, read_wav, as_wav = containers.read_adts, containers.read_wav, containers.as_wav
framed, elements, as_adts = streams.framed, streams.elements, streams.as_adts


def encode(channels: list[str], rate: int = 44100, bitrate: int = 128_000, books: dict | None = None, shaping: bool = True) -> Step:
    """Frames of 1,024 samples (stream, f, a column a channel; see framed) to payloads (stream, f, payload)."""
    return streams.encode(channels, rate, bitrate, books, shaping)


def decode(rate: int = 44100, books: dict | None = None) -> Step:
    """Payloads to samples (stream, f, channel, samples, error), a frame late; what cannot be decoded gives its error."""
    return streams.decode(rate, books)


def loudness(rate: int, size: int = 4096) -> Step:
    """Frames (stream, f, x of `size` samples over full scale) to (stream, f, y): K-weighted samples."""
    return lambda df: folds.filtered(df, folds.cascade(folds.k_weighting(rate), size))


def compare(other: DataFrame) -> Step:
    """Samples (stream, n, s) against others: samples, exact, max_abs, rms and snr (dB; null where equal) by stream."""

    def run(df: DataFrame) -> DataFrame:
        d = F.col("s") - F.col("t")
        both = df.select("stream", "n", "s").join(other.select("stream", "n", F.col("s").alias("t")), ["stream", "n"])
        e = F.sum(d * d)
        return both.groupBy("stream").agg(F.count("*").alias("samples"), F.sum((d == 0).cast("bigint")).alias("exact"), F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rms"), F.when(e > 0, 10 * F.log10(F.sum(F.col("s") * F.col("s")) / e)).alias("snr"))

    return run


def frames(size: int = 1024, scale: float = 1.0) -> Step:
    """Samples (stream, n, s) to complete frames."""
    return lambda df: signals.frames(df, size, scale)


def mdct(size: int = 1024, shape: str = "sine") -> Step:
    """Frames to spectra: each frame behind the one before it, windowed and transformed."""
    window = T.sine_window(2 * size) if shape == "sine" else T.kbd_window(2 * size, 4.0)
    return lambda df: signals.with_previous(df, size).select("stream", "f", T.mdct(T.windowed(F.concat("p", "x"), window), size).alias("y"))


def imdct(size: int = 1024, shape: str = "sine") -> Step:
    """Spectra to frames, a frame late: transform, window, overlap-add."""
    window = T.sine_window(2 * size) if shape == "sine" else T.kbd_window(2 * size, 4.0)

    def run(df: DataFrame) -> DataFrame:
        back = df.select("stream", "f", T.windowed(T.imdct(F.col("y"), size), window).alias("b"))
        halves = back.select("stream", "f", F.slice("b", 1, size).alias("head"), F.slice("b", size + 1, size).alias("x"))
        tails = signals.with_previous(halves.select("stream", "f", "x"), size).select("stream", "f", "p")
        return tails.join(halves.select("stream", "f", "head"), ["stream", "f"]).select("stream", "f", F.zip_with("head", "p", lambda a, b: a + b).alias("x"))

    return run


def band_energy(widths: list[int], column: str = "y") -> Step:
    """Adds e: energy of each band."""
    return lambda df: df.withColumn("e", psycho.band_sums(F.col(column), widths))


def mask(widths: list[int], rate: int) -> Step:
    """Adds t: threshold of each band by self-masking, spreading and the quiet floor (no pre-echo control)."""
    up, down = psycho.slopes(widths, rate)
    floor = psycho.doubles(psycho.quiet(widths, rate))
    return lambda df: df.withColumn("t", F.zip_with(psycho.spread(psycho.self_mask(F.col("e")), up, down), floor, lambda a, b: F.greatest(a, b)))


def quantise(scalefactor: int, column: str = "y") -> Step:
    return lambda df: df.withColumn("q", F.transform(column, lambda v: quant.quantise(v, scalefactor)))


def dequantise(scalefactor: int) -> Step:
    return lambda df: df.withColumn("y", F.transform("q", lambda v: quant.dequantise(v, scalefactor)))
