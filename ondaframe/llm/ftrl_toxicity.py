"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are the presence of its words and their stems (first 5 and 4
letters, which stand for inflected forms), its word pairs, and its skip-grams
(pairs with one word left out between), hashed into 2**bits buckets.  Words are
lower-cased and lose everything but letters and digits.  Training
keeps two sums per bucket; each bucket has a learning rate of its own, and the
L1 bound leaves most weights at exactly zero, so the model is a short list of
(bucket, weight), of 2**bits entries at most, that travels in the task closure.
Texts are unpacked a few rows at a time, whatever the size of Arrow's batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scored_schema, stage_out
from .vlc_ids import decode_block, encode_block

#: Rows of a batch whose texts are unpacked at a time.
ROWS = 256
_NOT_WORD = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 1.0
    epochs: int = 6
    #: A toxic row counts so many times.
    toxic_weight: float = 3.0
    #: Most labelled rows that training reads, smallest hash of doc_id first.
    max_rows: int = 12_000


class WordHasher:
    """32-bit hashes of the words of a text and of their stems; keeps those of at most `room` spellings.

    A word has a column for itself and one for each length in STEMS: the hash
    of its first so many letters.
    """

    STEMS = (5, 4)

    def __init__(self, room: int = 1 << 18):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((room, 1 + len(self.STEMS)), dtype=np.uint32)

    def _hashes(self, part: str) -> list[int]:
        word = _NOT_WORD.sub("", part.lower())
        if not word:
            return [0] * (1 + len(self.STEMS))
        return [zlib.crc32(word.encode("utf-8", "replace")) or 1, *(zlib.crc32(f"{n}:{word[:n]}".encode("utf-8", "replace")) or 1 for n in self.STEMS)]

    def words(self, text: str | None) -> np.ndarray:
        """Rows of hashes in text order; what has no letter or digit is left out."""
        parts = (text or "").split()
        room = len(self.table) // 2
        out = [np.zeros((0, self.table.shape[1]), dtype=np.uint32)]
        for at in range(0, len(parts), room):
            some = parts[at : at + room]
            if len(self.rows) + len(some) > len(self.table):
                self.rows.clear()
            found = list(map(self.rows.get, some))
            if None in found:
                for i, k in enumerate(found):
                    if k is None:
                        k = self.rows.get(some[i])
                        if k is None:
                            k = self.rows[some[i]] = len(self.rows)
                            self.table[k] = self._hashes(some[i])
                        found[i] = k
            out.append(self.table[found])
        h = np.concatenate(out)
        return h[h[:, 0] > 0]


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (x >> np.uint32(32 - bits)).astype(np.int32)


def features(h: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of words and stems, word pairs and skip-grams, with repeats."""
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
    w = h[:, 0]
    return _mixed(np.concatenate([h.reshape(-1), w[:-1] * a + w[1:] + b, w[:-2] * a + w[2:] + c]), bits)


def train(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """FTRL-proximal over (distinct buckets, label): bias, buckets, weights."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias, seen = 0.0, 0.0
    for _ in range(s.epochs):
        for idx, y in rows:
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > s.l1, (np.sign(zi) * s.l1 - zi) / ((s.beta + root) / s.alpha + s.l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = (p - y) * (s.toxic_weight if y else 1.0)
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / s.alpha * w
            n[idx] = ni + g * g
            seen += g * g
            bias -= s.alpha * g / (s.beta + np.sqrt(seen))
    keep = np.flatnonzero(np.abs(z) > s.l1)
    w = (np.sign(z[keep]) * s.l1 - z[keep]) / ((s.beta + np.sqrt(n[keep])) / s.alpha + s.l2)
    return float(bias), keep.astype(np.int32), w


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, s: Settings = Settings()) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on a bounded sample of labelled documents.

    labels: doc_id, toxic (rows with a null in either are left out; the larger
    label of repeated rows counts).  learnable: which rows of labels may be
    learnt from.  The sample is the max_rows label rows of smallest
    (xxhash64(doc_id), doc_id), thinned by that hash to about twice as many before
    they are ordered; it is picked before any text is read.  No usable row gives
    a model without weights.  A row's buckets go as their differences in one to
    four bytes each, half of what integers take on their way to the one task.
    """
    known = labels.where(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    h = F.xxhash64("doc_id")
    # the smallest hashes, of the whole range that there is, so that the order is over few rows
    share = min(1.0, 2 * s.max_rows / max(1, known.count()))
    few = known.withColumn("h", h).where(F.col("h") <= int(-(2**63) + share * (2**64 - 1025)))
    sample = few.orderBy("h", "doc_id").limit(s.max_rows)
    # at most max_rows short rows
    text = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    bits = s.bits

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(1 << 17)
        for part in _parts(batches):
            f = [encode_block(np.diff(np.unique(features(hasher.words(t), bits)), prepend=0)) for t in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(f, pa.binary())], ["h", "doc_id", "y", "f"])

    key = docs.schema["doc_id"].dataType.simpleString()
    kept = stage_out(text.select("h", "doc_id", F.col("y").cast("int"), "text").mapInArrow(buckets, f"h bigint, doc_id {key}, y int, f binary"), "toxic-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.cumsum(decode_block(f), dtype=np.int32), y) for b in _parts(batches) for f, y in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
        bias, idx, w = train(rows, s)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *idx.tolist()], pa.int32()), pa.array([bias, *w.tolist()])], ["i", "w"])

    # the bounded sample in one task: the method learns row after row
    model = kept.repartition(1).sortWithinPartitions("h", "doc_id", "y").mapInArrow(learn, "i int, w double").toArrow()
    idx, w = model.column("i").to_numpy(), model.column("w").to_numpy()
    at = idx >= 0
    return float(w[~at][0]) if (~at).any() else -35.0, idx[at], w[at]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], keep: list[str], s: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """Columns `keep` of docs with score (0 to 1) and predicted (1 if score >= threshold).

    keep must not hold those two names (ValueError).

    Whole texts, narrow.  Null and empty texts have no features and get the
    bias' score.
    """
    bias, idx, w = model
    bits = s.bits
    out = scored_schema(docs, keep, "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << bits, dtype=np.float32)
        weight[idx] = w
        hasher = WordHasher()
        for batch in _parts(batches):
            got = []
            for t in batch.column(0).to_pylist():
                f = features(hasher.words(t), bits)
                hit = f[weight[f] != 0]
                got.append(bias + float(weight[np.unique(hit)].sum(dtype=np.float64)) if len(hit) else bias)
            p = 1 / (1 + np.exp(-np.clip(np.array(got, dtype=float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(F.col("text").alias("_t"), *keep).mapInArrow(run, out)
