"""Vector bin packing of examples into training sequences.

A sequence is a bin with three capacities: tokens, segments, loss-bearing
tokens.  Bins are filled one at a time from a bounded window of waiting
examples: the example that fits and whose demand has the largest dot product
with the free capacities (both as shares of the capacities) goes in next, so
that examples match the shape of what is free.  Each task packs the rows of
its own partition as it reads them: nothing is shuffled, and a lost task packs
the same rows into the same sequences again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .chunked import loaded


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Packer:
    """Fills bins from a window of examples.

    cut: examples may be cut; then every bin ends full or at a power of two of
    tokens and nothing is padded.  Without it an example beyond a limit gets a
    bin of its own, marked by its size.

    An example is (key, tokens, loss): loss is the number of loss-bearing
    tokens, or for cutting a cumulative count of length tokens + 1 (None: all).
    Bins are lists of (key, start, length, loss).
    """

    def __init__(self, limits: Limits, window: int = 256, cut: bool = True):
        self.limits, self.window, self.cut = limits, window, cut
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.keys: list = []
        self.sums: list = []
        self.starts = np.zeros(window + 1, dtype=np.int64)
        self.need = np.ones((window + 1, 3))

    def _loss(self, sums, start: int, length: int) -> int:
        return length if sums is None else int(sums[start + length] - sums[start]) if not isinstance(sums, int) else sums

    def _wait(self, key, sums, start: int, length: int) -> None:
        k = len(self.keys)
        if k == len(self.need):
            self.need = np.concatenate([self.need, np.ones_like(self.need)])
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.keys.append(key)
        self.sums.append(sums)
        self.starts[k] = start
        self.need[k] = length, 1, self._loss(sums, start, length)

    def _take(self, k: int) -> tuple:
        """Removes an example; the last one fills its place."""
        got = self.keys[k], self.sums[k], int(self.starts[k]), int(self.need[k, 0])
        key, sums = self.keys.pop(), self.sums.pop()
        if k < len(self.keys):
            self.keys[k], self.sums[k] = key, sums
            self.starts[k], self.need[k] = self.starts[len(self.keys)], self.need[len(self.keys)]
        return got

    def _fill(self) -> list[tuple]:
        free, out, total = self.caps.copy(), [], 0
        weight = 1 / self.caps**2
        while self.keys and free[0] > 0 and free[1] > 0:
            need = self.need[: len(self.keys)]
            score = need @ (free * weight)
            fits = (need <= free).all(axis=1)
            k = int(np.where(fits, score, -1).argmax())
            if fits[k]:
                key, sums, start, length = self._take(k)
            elif self.cut:
                k = int(score.argmax())
                room = int(min(free[0], need[k, 0]))
                sums, start = self.sums[k], int(self.starts[k])
                if sums is not None:
                    room = min(room, int(np.searchsorted(sums, sums[start] + free[2], side="right")) - 1 - start)
                if room < 1:
                    break
                key, sums, start, length = self._take(k)
                if length > room:
                    self._wait(key, sums, start + room, length - room)
                    length = room
            elif not out:
                key, sums, start, length = self._take(int(score.argmax()))
            else:
                break
            loss = self._loss(sums, start, length)
            free -= length, 1, loss
            total += length
            out.append((key, sums, start, length))
        if self.cut and total < self.limits.tokens:
            over = total - (1 << (total.bit_length() - 1))
            while over:
                key, sums, start, length = out.pop()
                back = min(over, length)
                self._wait(key, sums, start + length - back, back)
                if length > back:
                    out.append((key, sums, start, length - back))
                over -= back
        return [(key, start, length, self._loss(sums, start, length)) for key, sums, start, length in out]

    def add(self, key, length: int, sums=None) -> Iterator[list[tuple]]:
        """Takes in an example; yields the bins that are now filled."""
        start = 0
        if self.cut and sums is None and self.limits.loss >= self.limits.tokens:
            while length >= self.limits.tokens:
                yield [(key, start, self.limits.tokens, self.limits.tokens)]
                start, length = start + self.limits.tokens, length - self.limits.tokens
        if length:
            self._wait(key, sums, start, length)
        while len(self.keys) >= self.window:
            yield self._fill()

    def end(self) -> Iterator[list[tuple]]:
        while self.keys:
            yield self._fill()


def _sequence_ids() -> Iterator[int]:
    at = TaskContext.get().partitionId() << 36
    while True:
        yield at
        at += 1


def pack_documents(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, limits: Limits = Limits(), rows: int = 256, room: int = 1_000_000) -> DataFrame:
    """Pack whole documents, cut where a sequence is full.

    room: parts of texts that a worker keeps (see chunked.PartCache); fewer
    take less memory and more time.

    Every token of a document counts towards the loss.  Returns a row per piece:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  Null and
    empty texts hold only end_id.  Repeated rows are packed each for itself; an
    empty table gives no rows; other columns are not read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, numbers = loaded(path, kind, room=room), Packer(limits), _sequence_ids()
        end = int(end_id).to_bytes(4, "little")
        rows_out: list[tuple] = []

        def placed(bins: Iterator[list[tuple]]) -> None:
            for b in bins:
                number, offset = next(numbers), 0
                for (doc_id, ids), start, length, _ in b:
                    rows_out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, number, offset))
                    offset += length

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows_out, strict=True))
            rows_out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    placed(packer.add((doc_id, ids), len(ids) // 4))
                if len(rows_out) > 4096:
                    yield flush()
        placed(packer.end())
        if rows_out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def pack_conversations(turns: DataFrame, path: str, kind: str = "word", end_id: int = 1, limits: Limits = Limits(2048, 16, 1024), loss_role: str = "assistant") -> DataFrame:
    """Pack instruction data: whole conversations, at most so many in a sequence.

    Turns are encoded where they lie and only their token counts are shuffled
    by conversation.  Tokens of turns by loss_role bear loss.  A conversation
    beyond a limit gets a sequence of its own.  Null texts hold only end_id;
    a null conv_id is a conversation like any other.
    Returns conv_id, tokens, loss, sequence_id, offset.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path, kind)
        for batch in batches:
            n = [len(x) // 4 + 1 for x in encoder.encode(batch.column(2).to_pylist())]
            role = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([k if r == loss_role else 0 for k, r in zip(n, role, strict=True)], pa.int64())], ["conv_id", "tokens", "loss"])

    key = turns.schema["conv_id"].dataType.simpleString()
    by_conv = turns.select("conv_id", "role", "text").mapInArrow(sizes, f"conv_id {key}, tokens bigint, loss bigint").groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, numbers = Packer(limits, cut=False), _sequence_ids()
        names = ["conv_id", "tokens", "loss", "sequence_id", "offset"]

        def rows(bins: Iterator[list[tuple]]) -> list[tuple]:
            out = []
            for b in bins:
                number, offset = next(numbers), 0
                for conv, _, length, loss in b:
                    out.append((conv, length, loss, number, offset))
                    offset += length
            return out

        for batch in batches:
            out = []
            for conv, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += rows(packer.add(conv, tokens, loss))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names)
        if out := rows(packer.end()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], names)

    conv_type = to_arrow_type(turns.schema["conv_id"].dataType)
    schema = pa.schema([("conv_id", conv_type), *((n, pa.int64()) for n in ("tokens", "loss", "sequence_id", "offset"))])
    return by_conv.mapInArrow(run, f"conv_id {key}, tokens bigint, loss bigint, sequence_id bigint, offset bigint")
