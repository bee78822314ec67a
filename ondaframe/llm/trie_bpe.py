"""Byte-level BPE by prefix-sharing trie traversal.

Distinct words of a batch go into a byte trie.  A depth-first walk gives each
node the last token of the BPE encoding of its prefix; a prefix shared by many
words is worked out once.  The state of a node follows from its ancestors':
among the vocabulary's tokens that end there, longest first by an automaton over the
vocabulary, the last one is the token t that stands compatibly after the last
token of the prefix before it, where two
tokens are compatible if BPE would leave them apart side by side.  A word's ids
are read off by stepping back from its node, token by token.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .chunked import _KEPT_CHARS, PartCache, byte_parts, piece

#: The byte-level pre-tokenizer's pattern (fixed value), blanks by the Unicode White_Space property.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE(PartCache):
    """Encoder and decoder over a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str, room: int = 500_000):
        super().__init__(room)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(s): i for s, i in vocab.items()}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.text: list[bytes] = [b""] * size
        for s, i in self.ids.items():
            self.text[i] = s
        for s, i in self.added.items():
            self.text[i] = s.encode()
        #: Rank of the merge that makes a token, -1 for single bytes; its two parts; rank of a merging pair.
        self.rank, self.parts, self.pair = [-1] * size, [(-1, -1)] * size, {}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.pair[i, j] = r
            if self.rank[made] < 0:
                self.rank[made], self.parts[made] = r, (i, j)
        self._automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.marks = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")")

    def _automaton(self) -> None:
        """States for all prefixes of tokens: the step on a byte, where to fall back, the longest token that ends there.

        shorter: the next shorter token that ends a token.
        """
        self.step, self.length = {}, [len(s) for s in self.text]
        step, token, path = self.step, [-1], [(-1, -1)]
        for s, i in self.ids.items():
            at = 0
            for b in s:
                key = at << 8 | b
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(token)
                    token.append(-1)
                    path.append((at, b))
                at = nxt
            token[at] = i
        depth = [0] * len(token)
        for n in range(1, len(token)):
            depth[n] = depth[path[n][0]] + 1
        self.fail, self.longest, self.shorter = [0] * len(token), list(token), [-1] * len(self.text)
        fail, longest = self.fail, self.longest
        for n in sorted(range(1, len(token)), key=depth.__getitem__):
            up, b = path[n]
            if up:
                f = fail[up]
                while f and f << 8 | b not in step:
                    f = fail[f]
                fail[n] = step.get(f << 8 | b, 0)
            if token[n] < 0:
                longest[n] = longest[fail[n]]
            else:
                self.shorter[token[n]] = longest[fail[n]]

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE keeps these tokens as they are, side by side.

        Undoes merges from the latest back; at each point the pair that faces
        the border must not have a merge that would have come first.
        """
        rank, parts, pair = self.rank, self.parts, self.pair
        bound = len(pair) + 1
        while True:
            r = pair.get((left, right))
            if r is not None and r < bound:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # the one merged later existed only after the other; on equal ranks the left came first
            if a > b:
                bound, left = a, parts[left][1]
            else:
                bound, right = b + 1, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._apart(left, right)
        return known

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each distinct word as little-endian unsigned 32-bit bytes."""
        kids: list[dict[int, int]] = [{}]
        whole: list[int] = [-1]
        deepest = 0
        for k, word in enumerate(words):
            node = 0
            for b in word:
                below = kids[node]
                node = below.get(b, 0)
                if not node:
                    node = below[b] = len(kids)
                    kids.append({})
                    whole.append(-1)
            whole[node] = k
            deepest = max(deepest, len(word))
        out: list[bytes] = [b""] * len(words)
        last, state = [0] * (deepest + 1), [0] * (deepest + 1)
        step, fail, longest, shorter, length = self.step, self.fail, self.longest, self.shorter, self.length
        fits, compatible = self.fits, self.compatible
        todo = [(node, 1, b) for b, node in kids[0].items()]
        while todo:
            node, depth, b = todo.pop()
            s = state[depth - 1]
            while (to := step.get(s << 8 | b)) is None:
                s = fail[s]
            state[depth] = to
            t = longest[to]
            while (n := length[t]) < depth:
                before = last[depth - n]
                good = fits.get(before << 20 | t)
                if good if good is not None else compatible(before, t):
                    break
                t = shorter[t]
            last[depth] = t
            if (k := whole[node]) >= 0:
                back, at = [], depth
                while at:
                    t = last[at]
                    back.append(t)
                    at -= length[t]
                out[k] = array("I", back[::-1]).tobytes()
            if below := kids[node]:
                depth += 1
                for b, kid in below.items():
                    todo.append((kid, depth, b))
        return out

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        return dict(zip(parts, self.encode_plain([piece(p) for p in parts]), strict=True))

    def encode_mark(self, mark: str) -> bytes:
        return self.encode_plain([mark])[0]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens; each distinct word goes into the trie once."""
        cut = [_WORD.findall(t) for t in texts]
        known, words = self.words, []
        if len(known) > self.room:
            known.clear()
        words = list({w for ws in cut for w in ws if w not in known})
        fresh = dict(zip(words, self.encode_words([w.encode("utf-8", "replace") for w in words]), strict=True))
        out = [b"".join([known.get(w) or fresh[w] for w in ws]) for ws in cut]
        known.update((w, x) for w, x in fresh.items() if len(w) <= _KEPT_CHARS)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as the tokenizers library gives them; null counts as empty."""
        cut: list[list[str]] = []
        out: list[list[bytes]] = []
        owner: list[tuple[int, int]] = []
        for k, t in enumerate(texts):
            pieces = [t or ""]
            if self.added and any(a in pieces[0] for a in self.added):
                pieces = self.marks.split(pieces[0])
            got: list[bytes] = []
            for p in pieces:
                got.append(b"")
                if p in self.added:
                    got[-1] = np.asarray([self.added[p]], dtype="<u4").tobytes()
                elif p:
                    owner.append((k, len(got) - 1))
                    cut.append(byte_parts(p))
            out.append(got)
        for (k, i), ids in zip(owner, self.assemble(cut), strict=True):
            out[k][i] = ids
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> str:
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, TrieBPE] = {}


def loaded(path: str) -> TrieBPE:
    """The encoder of this worker process."""
    if path not in _loaded:
        _loaded[path] = TrieBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, digests: bool = True, rows: int = 256) -> DataFrame:
    """Encode and decode every text.  Narrow: one pass over the scan, no shuffle.

    Returns doc_id and n_tokens with, by digests, the SHA-256 of ids and of the
    decoded text, or else ids array<int> and decoded string.  Null and empty
    texts have no ids.  Repeated rows stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = bpe.encode(part.column(1).to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    a = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                    b = pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids])
                    yield pa.RecordBatch.from_arrays([part.column(0), n, a, b], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    a = pa.array([np.frombuffer(x, "<u4").astype("int32") for x in ids], pa.list_(pa.int32()))
                    b = pa.array([bpe.decode(x) for x in ids])
                    yield pa.RecordBatch.from_arrays([part.column(0), n, a, b], ["doc_id", "n_tokens", "ids", "decoded"])

    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, {out}")
