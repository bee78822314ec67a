"""Token ids in files of byte-aligned variable-length codes.

Ids are replaced by their frequency rank over the whole corpus, so that the
common ones take one byte.  A block's ranks are coded in groups of four: one
control byte holds four 2-bit byte counts, and the control bytes stand apart
from the data bytes.  Decoding looks a whole control column up in a table of
256 x 4 lengths; no loop runs over ids.

Block layout, little-endian: magic "FVB1", uint32 number of ids, the control
bytes, the data bytes.  A file is a Parquet table of blocks, in ascending
doc_id order by (part, block); `docs` and `counts` say whose ids they hold.  A
second table beside them has the id of each rank, so that the files can be read
without anything else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import parts
from .chunked import loaded
from .common import stage_out

MAGIC = b"FVB1"
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def encode_block(values: np.ndarray) -> bytes:
    """Code unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    n = len(v)
    most = int(v.max()) if n else 0
    widest = 1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)
    two_bits = np.zeros((n + 3) // 4 * 4, dtype=np.uint8)
    kept = np.ones((n, widest), dtype=bool)
    for k in range(1, widest):
        kept[:, k] = v >= 1 << 8 * k
        two_bits[:n] += kept[:, k]
    control = two_bits[::4] | two_bits[1::4] << 2 | two_bits[2::4] << 4 | two_bits[3::4] << 6
    data = v.view(np.uint8).reshape(n, 4)[:, :widest][kept]
    return MAGIC + n.to_bytes(4, "little") + control.tobytes() + data.tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """Values of a block, by table lookup of its control bytes."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of variable-length ids")
    n = int.from_bytes(block[4:8], "little")
    groups = (n + 3) // 4
    if not n:
        return np.zeros(0, dtype=np.uint32)
    length = _LENGTHS[np.frombuffer(block, np.uint8, groups, 8)].reshape(-1)[:n]
    data = np.concatenate([np.frombuffer(block, np.uint8, offset=8 + groups), np.zeros(3, np.uint8)])
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at].astype(np.uint32)
    for k in range(1, int(length.max())):
        more = np.flatnonzero(length > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(column: pa.Array, path: str, kind: str, end_id: int, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some rows after the other: the first, their ids with end_id one after the other, how many each row has.  rows: at once, where texts do not go by bytes."""
    if kind == "byte":
        encoder = parts.loaded(path, end_id)
        for at, texts, ends in encoder.columns(column):
            yield at, *encoder.encode_column(texts, ends)
        return
    encoder, end = loaded(path, kind, width=2, room=1_000_000), int(end_id).to_bytes(2, "little")
    for at in range(0, len(column), rows):
        got = [x + end for x in encoder.encode(column.slice(at, rows).to_pylist())]
        yield at, np.frombuffer(b"".join(got), "<u2"), np.array([len(x) // 2 for x in got])


def tokenize(docs: DataFrame, path: str, kind: str, end_id: int, rows: int = 256, vocabulary: int = 1 << 16) -> DataFrame:
    """doc_id, ids (16-bit little-endian, end_id appended), and one row a task that has only `seen` and `n`: how often it met each id.  Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for at, ids, count in _encoded(batch.column(1), path, kind, end_id, rows):
                total += np.bincount(ids, minlength=vocabulary)
                ends = np.concatenate([[0], np.cumsum(2 * count)]).astype(np.int32)
                got = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2", copy=False))])
                none = pa.nulls(len(got), pa.list_(pa.int32())), pa.nulls(len(got), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(got)), got, *none], names)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.binary()), pa.array([seen], pa.list_(pa.int32())), pa.array([total[seen]], pa.list_(pa.int64()))], names)

    names = ["doc_id", "ids", "seen", "n"]
    key = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, seen array<int>, n array<bigint>")


def id_ranks(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """id, rank, written beside the files: rank of each id that occurs by its count over all documents, ties to the smaller id.

    The tasks' counts (a row each) are summed by id; at most `vocabulary` rows are ranked.
    """
    pairs = tokens.where(F.col("seen").isNotNull()).select(F.explode(F.arrays_zip("seen", "n")).alias("p"))
    counts = pairs.groupBy(F.col("p.seen").alias("id")).agg(F.sum("p.n").alias("n"))
    return stage_out(counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank")), "id-ranks")


def _by_id(ranks: DataFrame, vocabulary: int) -> np.ndarray:
    """Rank of each id, from the written table of at most `vocabulary` rows."""
    got = ranks.toArrow()
    rank = np.zeros(vocabulary, dtype=np.uint32)
    rank[got.column("id").to_numpy()] = got.column("rank").to_numpy()
    return rank


def write_blocks(tokens: DataFrame, ranks: DataFrame, vocabulary: int, block_ids: int = 1 << 18) -> DataFrame:
    """Write id files in ascending doc_id order; returns them reread.

    Documents are range-partitioned by doc_id, sorted within partitions (equal
    doc_ids by their ids), and coded in blocks of about block_ids ids.
    """
    key = tokens.schema["doc_id"].dataType.simpleString()
    rank = _by_id(ranks, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, n, docs, held
            ids = np.concatenate(held)
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "block": block, "start": start, "docs": docs, "counts": [len(x) for x in held], "payload": encode_block(rank[ids])}],
                schema=schema,
            )
            block, start, n, docs, held = block + 1, start + len(ids), 0, [], []
            return row

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("docs", pa.list_(doc_type)), ("counts", pa.list_(pa.int32())), ("payload", pa.binary())])
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc_id)
                held.append(np.frombuffer(ids, "<u2"))
                n += len(held[-1])
                if n >= block_ids:
                    yield flush()
        if held:
            yield flush()

    doc_type = to_arrow_type(tokens.schema["doc_id"].dataType)
    ordered = tokens.where(F.col("seen").isNull()).select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return stage_out(ordered.mapInArrow(run, f"part int, block int, start bigint, docs array<{key}>, counts array<int>, payload binary"), "id-files")


def read_blocks(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """Documents from id files and their table of ranks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    of_rank = ranks.orderBy("rank").toArrow().column("id").to_numpy().astype("<u4")
    totals = files.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    # one row per partition of the write
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    placed = files.join(F.broadcast(base), "part").select((F.coalesce("base", F.lit(0)) + F.col("start")).alias("start"), "docs", "counts", "payload")
    key = files.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, counts, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids = of_rank[decode_block(payload.as_py())].tobytes()
                n = np.asarray(counts.as_py(), dtype=np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, f"doc_id {key}, start bigint, n_tokens bigint, ids_crc32 bigint")


def corpus_ids(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 2, vocabulary: int = 1 << 16) -> DataFrame:
    """Tokenize once, rank, write files, read them back.

    Null and empty texts hold only end_id.  Rows with equal doc_id stay apart,
    in the order of their ids; a null doc_id comes first.  An empty table gives
    no rows.  Other columns are not read.
    """
    tokens = stage_out(tokenize(docs, path, kind, end_id, vocabulary=vocabulary), "ids")
    ranks = id_ranks(tokens, vocabulary)
    return read_blocks(write_blocks(tokens, ranks, vocabulary), ranks)
