"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a logistic classifier over hashed
character n-grams (1 to 4 bytes, within words) predicts that bit.  A text is
decoded to the language whose codeword has the smallest loss against the
bits' margins, each bit weighted by its accuracy in training.  Texts whose two
nearest codewords lie close together are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scored_schema, stage_out

@dataclass(frozen=True)
class Settings:
    bits: int = 16
    longest: int = 4
    epochs: int = 5
    rate: float = 0.5
    #: Most rows that training reads for a language, smallest hash of doc_id first, and for all of them together (a row each at least).
    max_rows: int = 600
    max_sample: int = 38_400
    #: Shortest distance between the two nearest codewords' scores that counts as certain.
    margin: float = 0.1


def codewords(languages: int) -> np.ndarray:
    """+-1 codewords, a row per language.

    Up to 6 languages: all distinct splits (each column a nontrivial split of
    the languages); up to 256: rows of a Sylvester-Hadamard matrix without the
    constant column, any two of which differ in half of the bits; beyond:
    distinct rows of 256 drawn bits, so that weights stay of one size.
    """
    if languages <= 6:
        cols = [[1] + [1 if m >> k & 1 else -1 for k in range(languages - 1)] for m in range((1 << (languages - 1)) - 1)]
        return np.array(cols or [[1]], dtype=np.int8).T
    if languages > 256:
        drawn = np.random.default_rng(9).integers(0, 2, (languages, 256), dtype=np.int8) * 2 - 1
        assert len(np.unique(drawn, axis=0)) == languages
        return drawn
    h = np.ones((1, 1), dtype=np.int8)
    while len(h) < languages:
        h = np.block([[h, h], [h, -h]])
    return h[:languages, 1:]


class NgramTable:
    """Row numbers of words, and for each row what `value` makes of the word's n-grams."""

    def __init__(self, bits: int, longest: int):
        self.bits, self.longest = bits, longest

    def grams(self, word: str) -> np.ndarray:
        """Buckets of the 1- to `longest`-byte grams of a word between blanks."""
        b = np.frombuffer(f" {word} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        out, h = [], np.zeros(len(b), np.uint32)
        for n in range(1, self.longest + 1):
            if n > len(b):
                break
            h = (h[: len(b) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
            out.append(x >> np.uint32(32 - self.bits))
        return np.concatenate(out).astype(np.int32)


    def word_sums(self, words: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of many words at once: the summed weights of their grams, and how many grams they have."""
        parts = [f" {x} ".encode("utf-8", "replace") for x in words]
        size = np.array([len(x) for x in parts])
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(words)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes to the word's end
        sums, count = np.zeros((len(words), w.shape[1])), np.zeros(len(words))
        h = np.zeros(len(data), np.uint32)
        for n in range(1, min(self.longest, len(data)) + 1):
            h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
            inside = np.flatnonzero(left[: len(h)] >= n)
            x = (h[inside] ^ (h[inside] >> np.uint32(15))) * np.uint32(0x846CA68B)
            hit, own = w[x >> np.uint32(32 - self.bits)], owner[inside]
            count += np.bincount(own, minlength=len(words))
            for bit in range(w.shape[1]):
                sums[:, bit] += np.bincount(own, hit[:, bit], minlength=len(words))
        return sums, count


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def train(texts: list[str], languages: np.ndarray, codes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x bits) and each bit's accuracy, by stochastic gradients on relative gram counts."""
    table = NgramTable(s.bits, s.longest)
    rows, known = [], {}
    for t in texts:
        g = []
        for w in _words(t):
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = table.grams(w)
            g.append(known[w])
        idx, n = np.unique(np.concatenate(g), return_counts=True) if g else (np.zeros(0, np.int32), np.zeros(0))
        rows.append((idx, n / max(1, n.sum())))
    w = np.zeros((1 << s.bits, codes.shape[1]), dtype=np.float32)
    scale = 100.0
    for epoch in range(s.epochs):
        for (idx, x), k in zip(rows, languages, strict=True):
            m = (x @ w[idx]) * codes[k]
            g = codes[k] / (1 + np.exp(np.clip(m, -35, 35)))
            w[idx] += (s.rate * scale / (1 + epoch)) * x[:, None] * g
    right = np.array([((x @ w[idx]) * codes[k]) > 0 for (idx, x), k in zip(rows, languages, strict=True)])
    return w, right.mean(axis=0) if len(right) else np.ones(codes.shape[1])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    accuracy: np.ndarray


def fit(docs: DataFrame, learnable: Column, s: Settings = Settings()) -> Model:
    """Fit on a bounded sample: up to max_rows learnable rows of each language, fewer where max_sample is shared by many.

    Every language has a codeword.  Rows with a null doc_id, lang or text are
    not learnt from.  The driver gets the languages and the nonzero weights.
    """
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # a row per language
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(size))
    codes = codewords(max(1, len(languages)))
    if not languages:
        return Model((), codes, np.zeros(0, np.int32), np.zeros((0, codes.shape[1]), np.float32), np.ones(codes.shape[1]))
    most = max(1, min(s.max_rows, s.max_sample // len(languages)))
    # thin by hash to about twice what is needed before ranking, so that no language's rows meet in one task
    shares = docs.sparkSession.createDataFrame([(lang, max(1, n // (2 * most))) for lang, n in size.items()], "lang string, share bigint")
    h = F.xxhash64("doc_id")
    few = known.join(F.broadcast(shares), "lang").where(F.pmod(h, F.col("share")) == 0).select("doc_id", "lang", h.alias("h"))
    ranked = few.withColumn("r", F.row_number().over(_by_lang())).where(F.col("r") <= most).drop("r")
    sample = stage_out(docs.select("doc_id", "text", "lang").join(F.broadcast(ranked), ["doc_id", "lang"]), "lang-sample")
    number = {lang: k for k, lang in enumerate(languages)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        w, accuracy = train([r[0] for r in rows], np.array([number[r[1]] for r in rows], dtype=int), codes, s)
        used = np.flatnonzero(w.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 2) * w.shape[1], pa.int32()), pa.array(np.concatenate([accuracy[None].astype(np.float32), w[used]]).ravel()))], ["i", "w"])

    # the bounded sample in one task
    got = sample.repartition(1).sortWithinPartitions("h", "doc_id", "lang").select("text", "lang").mapInArrow(learn, "i int, w array<float>").toArrow()
    idx, w = got.column("i").to_numpy(), got.column("w").combine_chunks().flatten().to_numpy().reshape(-1, codes.shape[1])
    return Model(languages, codes, idx[idx >= 0], w[idx >= 0], w[idx < 0][0])


def _by_lang():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy("h", "doc_id")


def predict(docs: DataFrame, model: Model, keep: list[str], s: Settings = Settings()) -> DataFrame:
    """Columns `keep` with lang_pred, score (0 to 1) and ambiguous.

    score is the share of the nearest codeword among all, by exp(-loss).
    keep must not hold those three names (ValueError).  Whole texts, narrow.
    Null texts, texts without a letter (str.isalpha), and all texts where nothing could be learnt give `und`, 0.0, true.
    """
    out = scored_schema(docs, keep, "lang_pred string, score double, ambiguous boolean")
    languages, codes = np.array(model.languages, dtype=object), model.codes.astype(float)
    bit_weight = np.maximum(model.accuracy - 0.5, 1e-3)
    bit_weight = bit_weight / bit_weight.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = NgramTable(s.bits, s.longest)
        w = np.zeros((1 << s.bits, codes.shape[1]), dtype=np.float32)
        w[model.buckets] = model.weights
        room = min(1 << 18, (1 << 24) // codes.shape[1])  # sums of 64 MB at most
        sums, grams, rows = np.zeros((room, codes.shape[1]), dtype=np.float32), np.zeros(room, dtype=np.float32), {}

        def totals(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Summed margins and gram counts of texts; at most room / 2 words are looked up at a time."""
            total, n = np.zeros((len(texts), codes.shape[1])), np.zeros(len(texts))
            segments: list[tuple[int, list[str]]] = []
            held = 0

            def flush() -> None:
                new = {x for _, part in segments for x in part if x not in rows}
                if len(rows) + len(new) > room:
                    rows.clear()
                    new = {x for _, part in segments for x in part}
                if new:
                    fresh = list(new)
                    at = len(rows)
                    sums[at : at + len(fresh)], grams[at : at + len(fresh)] = table.word_sums(fresh, w)
                    rows.update(zip(fresh, range(at, at + len(fresh)), strict=True))
                for k, part in segments:
                    found = list(map(rows.__getitem__, part))
                    total[k] += sums[found].sum(axis=0, dtype=np.float64)
                    n[k] += grams[found].sum(dtype=np.float64)
                segments.clear()

            for k, text in enumerate(texts):
                words = _words(text)
                for at in range(0, len(words), room // 4):
                    part = words[at : at + room // 4]
                    if held + len(part) > room // 2:
                        flush()
                        held = 0
                    segments.append((k, part))
                    held += len(part)
            flush()
            return total, np.maximum(n, 1.0)

        for batch in batches:
            lang, score, unsure = [], [], []
            texts = batch.column(0).to_pylist()
            told = [bool(t and len(languages) and any(map(str.isalpha, t))) for t in texts]
            total, n = totals([t if on else "" for t, on in zip(texts, told, strict=True)])
            for k, on in enumerate(told):
                if not on:
                    lang.append("und"), score.append(0.0), unsure.append(True)
                    continue
                loss = (np.logaddexp(0, -codes * (total[k] / n[k])) * bit_weight).sum(axis=1)
                share = np.exp(-8 * (loss - loss.min()))
                share /= share.sum()
                best = int(share.argmax())
                rest = np.delete(share, best)
                lang.append(languages[best]), score.append(float(share[best])), unsure.append(bool(len(rest) and share[best] - rest.max() < s.margin))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("text").alias("_t"), *keep).mapInArrow(run, out)
