"""Headers, bits, checksums and framing over the UTF-8 bytes of documents and synthetic headers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.tables import RATES
from ..operators.checksums import crc16
from ..sources.containers import scan_adts
from ..sources.signals import table
from .registry import plan

_HEAD = "encode(text)[1:32]"
BYTES_SQL = "bts as (select doc_id, list_transform(range(0, least(32, octet_length(encode(text)))), lambda i: ('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2])::integer) as b from documents)"


def head(spark, sf_dir):
    """doc_id, b: the first 32 bytes of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.encode("text", "UTF-8"), 1, 32).alias("b"))


def _crc_sql(width: int, poly: int, start: int, bits: str = "null") -> str:
    mask, top = (1 << width) - 1, 1 << (width - 1)
    unrolled = "flatten(list_transform(b, lambda v: list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda k: (v >> k) & 1)))"
    cut = unrolled if bits == "null" else f"{unrolled}[1:{bits}]"
    return f"with {BYTES_SQL} select doc_id, cast(list_reduce(list_prepend({start}, {cut}), lambda c, x: xor((c * 2) & {mask}, case when (case when c >= {top} then 1 else 0 end) <> x then {poly} else 0 end)) as bigint) as crc from bts"


#: A fold over all bits of each text.
_WHOLE = "bts as (select doc_id, list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2])::integer) as b from documents)"


@plan("s23_crc16_whole", _crc_sql(16, 0x8005, 0xFFFF).replace(BYTES_SQL, _WHOLE))
@plan("s23_crc16", _crc_sql(16, 0x8005, 0xFFFF).replace(BYTES_SQL, _WHOLE))
def s23(spark, sf_dir):
    """Over all bytes of each text.  A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [None if t is None else crc16(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64())], ["doc_id", "crc"])

    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8")).mapInArrow(run, "doc_id bigint, crc bigint")


@plan("s24_crc10", _crc_sql(10, 0x001D, 0, "29"))
def s24(spark, sf_dir):
    """Over the first 29 bits."""
    return head(spark, sf_dir).select("doc_id", B.crc(B.byte_array(F.col("b")), 10, 0x001D, 0, 29).cast("bigint").alias("crc"))


@plan("s25_replication_crc", _crc_sql(10, 0x0233, 0, "100"))
def s25(spark, sf_dir):
    return head(spark, sf_dir).select("doc_id", B.crc(B.byte_array(F.col("b")), 10, 0x0233, 0, 100).cast("bigint").alias("crc"))


def _read_sql(at: int, n: int) -> str:
    first, last = at // 8, (at + n - 1) // 8
    whole = " + ".join(f"b[{i + 1}]::bigint * {1 << (8 * (last - i))}" for i in range(first, last + 1))
    return f"((({whole}) >> {8 * (last + 1) - at - n}) & {(1 << n) - 1})"


@plan("s18_bit_read", f"with {BYTES_SQL} select doc_id, {_read_sql(3, 5)} as five, {_read_sql(6, 13)} as thirteen, case when len(b) > 4 then {_read_sql(1, 33)} end as wide from bts")
def s18(spark, sf_dir):
    b = F.col("b")
    return head(spark, sf_dir).select("doc_id", B.read(b, 3, 5).alias("five"), B.read(b, 6, 13).alias("thirteen"), B.read(b, 1, 33).alias("wide"))


@plan("s19_bit_peek", f"with {BYTES_SQL} select doc_id, coalesce(b[30], 0)::bigint * 16777216 + coalesce(b[31], 0) * 65536 + coalesce(b[32], 0) * 256 as peek from bts")
def s19(spark, sf_dir):
    """32 bits from byte 29 on; zeros stand past the end of the 32 bytes."""
    part = lambda i: F.coalesce(B.byte(F.col("b"), i), F.lit(0)).cast("bigint")
    return head(spark, sf_dir).select("doc_id", (part(29) * 16777216 + part(30) * 65536 + part(31) * 256).alias("peek"))


_IDX = "(event_id % 16)"


@plan("s3_adts_write", f"select event_id, 'FFF1' || lpad(hex(cast(((event_id % 4) * 64 + (case when {_IDX} < 13 then {_IDX} else 4 end) * 4 + (event_id % 8) // 4) as bigint)), 2, '0') || lpad(hex(cast((((event_id % 8) % 4) * 64) as bigint) | cast(((event_id * 31 % 8192) // 2048) as bigint)), 2, '0') || lpad(hex(cast(((event_id * 31 % 8192) % 2048) // 8 as bigint)), 2, '0') || lpad(hex(cast((((event_id * 31 % 8192) % 8) * 32 + (event_id % 2048) // 64) as bigint)), 2, '0') || lpad(hex(cast(((event_id % 64) * 4) as bigint)), 2, '0') as header from events")
def s3(spark, sf_dir):
    return headers(spark, sf_dir).select("event_id", F.hex("b").alias("header"))


def headers(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i, B.adts_header(i % 4 + 1, i % 16, i % 8, i * 31 % 8192, i % 2048).alias("b"))


@plan("s2_adts_parse", "select event_id, event_id % 4 + 1 as object_type, case (case when event_id % 16 < 13 then event_id % 16 else 4 end) " + " ".join(f"when {i} then {r}" for i, r in enumerate(RATES)) + " end as rate, event_id % 8 as channels, event_id * 31 % 8192 as length, event_id % 2048 as fullness, true as protection_absent from events")
def s2(spark, sf_dir):
    h = headers(spark, sf_dir).select("event_id", B.adts(F.col("b")).alias("h"))
    return h.select("event_id", *[F.col(f"h.{c}").alias(c) for c in ("object_type", "rate", "channels", "length", "fullness", "protection_absent")])


@plan("s1_adts_scan", "select event_id // 16 as stream, event_id % 16 as frame, cast(coalesce(sum(size + junk) over w, 0) as bigint) as lo, cast(coalesce(sum(size + junk) over w, 0) + size as bigint) as hi from (select event_id, event_id % 90 + 7 as size, case when event_id % 5 = 0 then 4 else 0 end as junk from events) window w as (partition by event_id // 16 order by event_id rows between unbounded preceding and 1 preceding)")
def s1(spark, sf_dir):
    """Spans of frames in streams of 16 frames: headers, payloads of zeros, and junk that looks like a sync word."""
    i = F.col("event_id")
    size = (i % 90 + 7).cast("int")
    frame = F.concat(B.adts_header(F.lit(2), i % 13, F.lit(2), size, F.lit(0x7FF)), F.unhex(F.repeat(F.lit("00"), size - 7)), F.when(i % 5 == 0, F.unhex(F.lit("FF00FFF1"))).otherwise(F.unhex(F.lit(""))))
    parts = table(spark, sf_dir, "events").select(F.floor(i / 16).alias("stream"), "event_id", frame.alias("b"))
    streams = parts.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("event_id", "b"))).alias("p")).select("stream", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["b"])).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, k, a, e) for s, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (a, e) in enumerate(scan_adts(b))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["stream", "frame", "lo", "hi"])

    return streams.mapInArrow(run, "stream bigint, frame bigint, lo bigint, hi bigint")
