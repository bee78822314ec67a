"""Audio containers as DataFrames: ADTS streams and 16-bit WAV files.

Files are read as binary rows by Spark's own reader, so any store that Spark
reads will do; parsing runs in Arrow batches and a broken file gives an error
row instead of failing the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B

FRAMES = "path string, frame bigint, lo bigint, hi bigint, payload binary"
WAV = "path string, channel int, rate int, samples array<smallint>, error string"


def scan_adts(data: bytes) -> list[tuple[int, int]]:
    """Spans of frames: at a sync word with a fitting length the scan jumps its length, else one byte on."""
    out, at = [], 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 7 <= len(data):
        n = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if data[at + 1] & 0xF0 == 0xF0 and (data[at + 2] >> 2 & 15) < 13 and n >= 7 and at + n <= len(data):
            out.append((at, at + n))
            at += n
        else:
            at += 1
    return out


def read_adts(spark: SparkSession, path: str) -> DataFrame:
    """A row per frame with its header fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = data.as_py()
                spans = scan_adts(b)
                if spans:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(spans)), pa.array(range(len(spans)), pa.int64()), *(pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1)), pa.array([b[lo:hi] for lo, hi in spans], pa.binary())],
                        ["path", "frame", "lo", "hi", "payload"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, FRAMES).withColumn("header", B.adts(F.col("payload")))


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (n x channels) of a RIFF file with 16-bit PCM; other chunks are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate, channels = 12, None, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, depth = struct.unpack_from("<HHIIHH", data, at + 8)
            if code not in (1, 0xFFFE) or depth != 16 or not channels:
                raise ValueError("only 16-bit PCM")
        elif kind == b"data":
            if rate is None:
                raise ValueError("no format before the data")
            body = data[at + 8 : at + 8 + size]
            return rate, np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no data")


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """A RIFF file of n x channels 16-bit samples."""
    s = np.ascontiguousarray(samples, "<i2").reshape(len(samples), -1)
    body, width = s.tobytes(), 2 * s.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, s.shape[1], rate, rate * width, width, 16, b"data", len(body))
    return head + body


def as_wav(samples: DataFrame, rate: int) -> DataFrame:
    """stream, content: a WAV file a stream of (stream, channel, samples array<smallint>), channels in order of number.

    One row holds one file, as a file of 4 GB at most must be one piece of bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [write_wav(np.stack([np.asarray(c["samples"], "<i2") for c in channels], axis=1), rate) for channels in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["stream", "content"])

    whole = samples.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("c"))
    return whole.mapInArrow(run, f"stream {samples.schema['stream'].dataType.simpleString()}, content binary")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """A row per file and channel; a file that cannot be read is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("channel", pa.int32()), ("rate", pa.int32()), ("samples", pa.list_(pa.int16())), ("error", pa.string())])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rate, x = parse_wav(data.as_py())
                    rows = [{"path": name, "channel": c, "rate": rate, "samples": x[:, c], "error": None} for c in range(x.shape[1])]
                except (ValueError, struct.error) as e:
                    rows = [{"path": name, "channel": None, "rate": None, "samples": None, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, WAV)
