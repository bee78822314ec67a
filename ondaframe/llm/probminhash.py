"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A text's shingles of five words are weighted by how often they occur.  Each
shingle's hash seeds a Poisson process whose rate is the weight; every arrival
falls on one of `registers` registers, and a register keeps the shingle that
arrived first.  A process ends as soon as its next arrival comes after the
latest first arrival of all registers.  Two texts agree in a register with
probability J_P, the probability Jaccard similarity of their weights.

Registers are banded.  Each bucket's least text is compared with all its
others, which is linear in the bucket; what then still stands apart within a
bucket is compared block by block, each text's best pairs first, so that no
pair which shares a bucket goes unjudged unless its texts are linked already.  Pairs whose registers agree well enough are verified: J_P is worked
out exactly from the whole texts.  Classes are the components of verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_out
from .components import components

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    registers: int = 128
    #: Registers in a band and bands: a pair at 0.8 shares a bucket but for 1 case in 20,000.
    rows: int = 5
    bands: int = 25
    #: A pair is verified if its share of agreeing registers is this far (4 standard deviations) below the similarity or higher.
    slack: float = 0.14
    #: Pairs that a text which stands apart gets first, per block.
    best: int = 4
    #: Most members of a bucket that one step compares with one another.
    block: int = 2048
    #: Most ids that are broadcast to pick the texts to verify; beyond, they are joined.
    broadcast_ids: int = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Weighted shingles of texts: lower-cased, words between blanks."""

    def __init__(self, words: int, room: int = 1 << 18):
        self.n = words
        self.rows: dict[str, int] = {}
        self.table = np.zeros(room, dtype=np.uint64)

    def _hashes(self, text: str) -> np.ndarray:
        parts = text.lower().split()
        room, out = len(self.table) // 2, []
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
                            self.table[k] = xxhash.xxh64_intdigest(some[i].encode("utf-8", "replace"))
                        found[i] = k
            out.append(self.table[found])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def shingles(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes and their counts.

        A text of fewer words than a shingle has one shingle, of all its words;
        a text without words has none.
        """
        h = self._hashes(text or "")
        n = min(self.n, len(h))
        if not n:
            return h, np.zeros(0)
        s = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            s = _mix(s * _GOLD + h[k : len(h) - n + 1 + k])
        keys, counts = np.unique(s, return_counts=True)
        return keys, counts.astype(float)


def sketch(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, registers: int) -> np.ndarray:
    """32-bit register contents (owners x registers) of many texts at once.

    keys, weights: the shingles of all texts; owner: whose they are.  Texts
    without shingles get zeros.
    """
    first = np.full(owners * registers, np.inf)
    who = np.zeros(owners * registers, dtype=np.uint32)
    last = np.full(owners, np.inf)
    key, rate, own, t = keys, weights, owner, np.zeros(len(keys))
    step = 0
    while len(key):
        step += 1
        u = _mix(key + np.uint64(step * int(_GOLD) % 2**64))
        t = t - np.log(((u >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / rate
        on = np.flatnonzero(t < last[own])
        key, rate, own, t, u = key[on], rate[on], own[on], t[on], u[on]
        slot = own * registers + ((u * _C2 >> np.uint64(40)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        who[slot[won]] = _mix(key[won]).astype(np.uint32)
        touched = np.unique(own[won])
        last[touched] = first.reshape(owners, registers)[touched].max(axis=1)
        on = np.flatnonzero(t < last[own])
        key, rate, own, t = key[on], rate[on], own[on], t[on]
    return who.reshape(owners, registers)


def probability_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """J_P: sum over x in both of 1 / sum over y of max(a_y/a_x, b_y/b_x)."""
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = wa[i], wb[j]
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    ratio = a / b
    at = np.searchsorted(ratio, ratio)  # elements before have a smaller ratio
    above = np.concatenate([np.cumsum(a[::-1])[::-1], [0.0]])[at] + wa.sum() - a.sum()
    below = np.concatenate([[0.0], np.cumsum(b)])[at] + wb.sum() - b.sum()
    return float((1 / (above / a + below / b)).sum())


def sketch_documents(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, digest (16 bytes of the text), sig (registers as bytes; null without words).  Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        for batch in batches:
            at = 0
            size = np.array([len(t) if t else 0 for t in batch.column(1).to_pylist()])
            ends = np.cumsum(size)
            while at < batch.num_rows:  # at most 1024 texts and about 4 million characters at a time
                to = min(at + 1024, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000))))
                part = batch.slice(at, to - at)
                at = to
                texts = part.column(1).to_pylist()
                found = [shingler.shingles(t) for t in texts]
                n = np.array([len(k) for k, _ in found])
                sig = sketch(np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found]), np.repeat(np.arange(len(n)), n), len(n), s.registers)
                digest = [hashlib.blake2b((t or "").encode("utf-8", "replace"), digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array([x.tobytes() if k else None for x, k in zip(sig, n, strict=True)], pa.binary())], ["doc_id", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, digest binary, sig binary")


def _agree(a: np.ndarray, b: np.ndarray, registers: int) -> np.ndarray:
    return (a == b).sum(axis=-1) / registers


def _pairs_alike(pairs: DataFrame, sigs: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose registers agree in at least similarity - slack."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    least = s.similarity - s.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, s.registers) for k in (2, 3))
            on = pa.array(_agree(x, y, s.registers) >= least)
            yield batch.select([0, 1]).filter(on)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _texts(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text of the documents in ids (distinct doc_id), at least; only those where ids are few enough to broadcast."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if ids.limit(s.broadcast_ids + 1).count() <= s.broadcast_ids:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    return texts


def verify(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Pairs (u, v, similarity) whose exact J_P reaches the similarity.  pairs: a, b, distinct."""
    spark = docs.sparkSession
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), s)
    roles = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), "a", "b", F.lit(0).alias("side")), F.struct(F.col("b").alias("doc_id"), "a", "b", F.lit(1).alias("side")))).alias("r")).select("r.*")
    sides = roles.join(texts, "doc_id").select("a", "b", "side", "text")
    least = s.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        hub, profile = None, None
        for batch in batches:
            out = []
            for a, b, side, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    if hub != a:
                        hub, profile = a, shingler.shingles(text)
                elif hub == a:
                    j = probability_jaccard(*profile, *shingler.shingles(text))
                    if j >= least - 1e-12:
                        out.append((a, b, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["u", "v", "similarity"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sides.repartition(n, "a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(run, "u bigint, v bigint, similarity double")


def _meetings(members: DataFrame, payload: DataFrame, s: Settings, rest_block: int, block: int) -> DataFrame:
    """Rows for comparing, in each bucket of several components, all that are not of its commonest one with all members.

    members: bucket, band, doc_id, label; payload: doc_id and what travels along.
    Keys (bucket, block, rest): at most about rest_block rows of side 0 and
    `block` of side 1, whatever the bucket's size.  Sorted by key, then side.
    """
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = by_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where(F.col("labels") > 1)
    blocks = F.ceil(F.col("n") / block).cast("int")
    rests = F.ceil((F.col("n") - F.col("top.n")) / rest_block).cast("int")
    known = members.join(sizes.select("bucket", F.col("top.label").alias("top"), blocks.alias("blocks"), rests.alias("rests")), "bucket").join(payload, "doc_id")
    at = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n).cast("int")
    along = ["band", "doc_id", "label", *(c for c in payload.columns if c != "doc_id")]
    rest = known.where(F.col("label") != F.col("top")).select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), at(1, F.col("rests")).alias("rest"), F.lit(0).alias("side"), *along)
    all_of = known.select("bucket", at(2, F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("rest"), F.lit(1).alias("side"), *along)
    keys = ["bucket", "block", "rest"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rest.unionByName(all_of).repartition(n, *keys).sortWithinPartitions(*keys, "side", "doc_id")


def _best_apart(members: DataFrame, sigs: DataFrame, s: Settings) -> DataFrame:
    """Alike pairs (a, b) of one bucket in different components: of each text that stands apart, the `best` a block."""
    least, best = s.similarity - s.slack, s.best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, labels, sig = None, [], [], []
        ids_a = labels_a = sig_a = top = who = None
        out: list[np.ndarray] = []

        def close() -> None:
            if top is not None:
                r, c = np.nonzero(top >= least)
                out.append(np.stack([np.minimum(ids_a[r], who[r, c]), np.maximum(ids_a[r], who[r, c])]))

        def made() -> pa.RecordBatch:
            a, b = np.concatenate(out, axis=1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for bucket, block, rest, side, _, doc, label, sg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, block, rest) != now:
                    close()
                    now, ids, labels, sig, sig_a, top = (bucket, block, rest), [], [], [], None, None
                if side == 0:
                    ids.append(doc), labels.append(label), sig.append(np.frombuffer(sg, np.uint32))
                    continue
                if not ids:
                    continue
                if sig_a is None:
                    ids_a, labels_a, sig_a = np.array(ids), np.array(labels), np.stack(sig)
                    top, who = np.zeros((len(ids), best)), np.zeros((len(ids), best), dtype=np.int64)
                share = np.where(labels_a != label, _agree(sig_a, np.frombuffer(sg, np.uint32), s.registers), 0.0)
                worst = top.argmin(axis=1)
                up = np.flatnonzero(share > top[np.arange(len(top)), worst])
                top[up, worst[up]], who[up, worst[up]] = share[up], doc
            if out:
                yield made()
        close()
        if out:
            yield made()

    return _meetings(members, sigs, s, s.block, s.block).mapInArrow(run, "a bigint, b bigint").distinct()


def _judge_apart(docs: DataFrame, members: DataFrame, sigs: DataFrame, s: Settings) -> DataFrame:
    """Verified links (u, v, similarity) between the components of a bucket: every alike pair is judged where it meets.

    The texts travel with their blocks, so the pairs themselves never become
    rows.  A pair is judged in the first band that it shares; a text that is
    linked to a component needs no second link to it in its block.
    """
    several = members.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("bucket")
    few = members.join(several, "bucket", "left_semi")
    payload = sigs.join(_texts(docs, few.select("doc_id").distinct(), s), "doc_id").dropDuplicates(["doc_id"])
    least, limit = s.similarity - s.slack, s.similarity - 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.words)
        now, ids, labels, sig, texts = None, [], [], [], []
        sig_a, profiles, linked = None, {}, set()
        for batch in batches:
            out = []
            for bucket, block, rest, side, band, doc, label, sg, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, block, rest) != now:
                    now, ids, labels, sig, texts, sig_a, profiles, linked = (bucket, block, rest), [], [], [], [], None, {}, set()
                mine = np.frombuffer(sg, np.uint32)
                if side == 0:
                    ids.append(doc), labels.append(label), sig.append(mine), texts.append(text)
                    continue
                if not ids:
                    continue
                if sig_a is None:
                    sig_a, labels_a = np.stack(sig), np.array(labels)
                same = sig_a == mine
                hits = np.flatnonzero((labels_a != label) & (same.sum(axis=1) >= least * s.registers))
                if not len(hits):
                    continue
                bands = same[hits, : s.rows * s.bands].reshape(len(hits), s.bands, s.rows).all(axis=2)
                own = None
                for i in hits[bands.argmax(axis=1) == band].tolist():
                    if (i, label) in linked:
                        continue
                    if i not in profiles:
                        profiles[i] = shingler.shingles(texts[i])
                    own = own or shingler.shingles(text)
                    j = probability_jaccard(*profiles[i], *own)
                    if j >= limit:
                        linked.add((i, label))
                        out.append((min(ids[i], doc), max(ids[i], doc), j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["u", "v", "similarity"])

    return _meetings(few, payload, s, max(1, s.block // 8), max(1, s.block // 4)).mapInArrow(run, "u bigint, v bigint, similarity double")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, class_id for every row: the least doc_id of its near-duplicate class.

    Equal texts are one class, null and empty texts too (null counts as empty).
    Texts without words are in no other class.  A doc_id names one text: rows
    repeated under one doc_id fall into one class.  Rows with a null doc_id
    take the class of an equal text, else null.  An empty table gives no rows.
    """
    marks = stage_out(sketch_documents(docs, s), "sketches")
    texts = stage_out(marks.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")), "texts")
    sigs = texts.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "sig")
    width = 4 * s.rows
    hashes = F.array(*[F.xxhash64(F.lit(k), F.expr(f"substring(sig, {k * width + 1}, {width})")) for k in range(s.bands)])
    rows = sigs.select("doc_id", F.posexplode(hashes).alias("band", "bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1).select("bucket", "hub")
    members = stage_out(rows.join(hubs, "bucket"), "buckets")
    stars = members.where(F.col("doc_id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    tried = stage_out(_pairs_alike(stars, sigs, s), "pairs")
    links = stage_out(verify(docs, tried, s), "links")
    label = components(links.select("u", "v"))
    standing = lambda: members.join(label, F.col("doc_id") == F.col("u"), "left").select("bucket", "band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    # most of what stands apart is linked by its best pairs; then all that still does is judged
    more = stage_out(_best_apart(standing(), sigs, s).join(tried, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        links = links.unionByName(stage_out(verify(docs, more, s), "links"))
        label = components(links.select("u", "v"))
    last = stage_out(_judge_apart(docs, standing(), sigs, s), "links")
    if last.limit(1).count():
        label = components(links.unionByName(last).select("u", "v"))
    named = texts.select("digest", F.col("doc_id").alias("rep")).join(label, F.col("rep") == F.col("u"), "left").select("digest", F.coalesce("label", "rep").alias("class_id"))
    return marks.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
