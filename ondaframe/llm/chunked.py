"""Exact tokenizer encoding with a bounded cache of text chunks.

Both public vocabularies pre-tokenize a text by a pattern none of whose matches
crosses certain blanks.  A text can therefore be cut at those blanks, each
distinct chunk encoded once by the tokenizers library, and the ids joined:

* byte-level BPE: cut before each single space that a non-blank character
  follows (the space always opens the next pre-token), and before a line end
  between two non-blank characters (no match holds a blank after a non-blank).
* word BPE (blanks dropped, lower-cased, NFC): cut at every run of blanks.

Texts that hold an added token's string, or for word BPE characters on whose
blankness Python and the library differ, are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np

#: Where byte-level BPE may be cut; the space goes, a line end stays with what follows.  What Python takes for blank is blank for the library, but for \x1c to \x1f: then a cut is merely left out.
_CUT = re.compile(r" (?=\S)|(?<=\S)(?=\n\S)")
#: Blanks other than space and line end.
_OTHER_BLANK = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Blank for Python, not for the library's patterns.
_ODD_BLANK = re.compile("[\x1c-\x1f]")
#: Marks the first part of a text; no other part has a blank after a line end.
_FIRST = "\n "
#: Words of letters that every Unicode version knows.
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: Longer chunks are encoded but not kept.
_KEPT_CHARS = 64


def byte_parts(text: str) -> list[str]:
    """Parts of a text for byte-level BPE, each of which encodes by itself as piece(part)."""
    parts = None
    if _OTHER_BLANK.search(text) is None:
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts:  # a blank beside another, or at an end
            parts = None
    parts = parts or _CUT.split(text)
    parts[0] = _FIRST + parts[0]
    return parts


def piece(part: str) -> str:
    """The piece of text that a part stands for: a space goes before it, but for line ends and for a text's first part, which is marked by a line end and a space."""
    return " " + part if part[0] != "\n" else part[2:] if part[:2] == _FIRST else part


class PartCache:
    """Ids by part of a text.  Subclasses encode the parts that are new.

    room: parts that a generation keeps.  When it is full it becomes the older
    generation, from which parts that occur again are taken over; what was older
    goes.  A worker holds 2 * room parts at most, of about 200 bytes each, and
    the frequent ones stay.
    """

    def __init__(self, room: int):
        self.room = room
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        raise NotImplementedError

    def encode_mark(self, mark: str) -> bytes:
        """Ids of a mark that no blank precedes."""
        raise NotImplementedError

    def assemble(self, cut: list[list[str]]) -> list[bytes]:
        """Joined ids of each list of parts."""
        if len(self.cache) > self.room:
            self.older, self.cache = self.cache, {}
            gc.freeze()  # parts are in no cycle: the collector need not visit them
        cache, older = self.cache, self.older
        # the parts of these texts in a dictionary of their own, which is small enough to stay near the processor
        parts = list(set().union(*cut))
        here = dict(zip(parts, map(cache.get, parts)))
        unknown = new = [p for p, x in here.items() if x is None]
        if older:
            again = list(map(older.get, new))
            cache.update((p, x) for p, x in zip(new, again, strict=True) if x is not None)
            new = [p for p, x in zip(new, again, strict=True) if x is None]
        # a full stop or comma after a letter is a pre-token of its own: without it fewer parts are new
        marked = [p for p in new if p[-1] in ".," and p[-2:-1].isalpha() and p[-2:-1] < "\u0250"]
        if marked:
            stems = [p[:-1] for p in marked]
            bare = set(new).difference(marked)
            bare.update(s for s in stems if s not in cache)
            new = list(bare)
        cache.update(self.encode_new(new))
        if marked:
            tail = {m: self.encode_mark(m) for m in ".,"}
            cache.update((p, cache[s] + tail[p[-1]]) for p, s in zip(marked, stems, strict=True))
            new += marked
        here.update(zip(unknown, map(cache.__getitem__, unknown)))
        out = [b"".join(map(here.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > _KEPT_CHARS:
                del cache[p]
        return out


class ChunkEncoder(PartCache):
    """Encodes texts as the tokenizers library does, part by part.

    kind: "byte" or "word", by the vocabulary's pre-tokenizer.
    width: bytes per little-endian unsigned id, 2 or 4.
    """

    def __init__(self, path: str, kind: str, width: int = 4, room: int = 150_000):
        super().__init__(room)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.kind, self.dtype = kind, f"<u{width}"
        #: Tokens that begin with a space or a line end, as byte-level vocabularies write them.
        self.opens = np.zeros(max(self.lib.get_vocab().values()) + 1, dtype=bool)
        self.opens[[i for t, i in self.lib.get_vocab().items() if t[0] in "\u0120\u010a"]] = True
        #: Tokens that end a pre-token, as the word vocabulary writes them.
        self.closes = np.zeros(len(self.opens), dtype=bool)
        self.closes[[i for t, i in self.lib.get_vocab().items() if t.endswith("</w>")]] = True

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        """One call of the library for a thousand parts."""
        if self.kind == "word":
            return self._plain_words(parts)
        firsts = [p for p in parts if p[:2] == _FIRST]
        rest = list(set(parts).difference(firsts)) if firsts else parts
        out = dict(zip(firsts, self._by_word([p[2:] for p in firsts]), strict=True))
        rows = [rest[i : i + 1000] for i in range(0, len(rest), 1000)]
        pieces = [list(map(piece, row)) for row in rows]
        for row, own, e in zip(rows, pieces, self.lib.encode_batch_fast(["".join(own) for own in pieces], add_special_tokens=False), strict=True):
            out.update(zip(row, self._by_blank(np.asarray(e.ids, dtype=self.dtype), len(row)) or self._by_word(own), strict=True))
        return out

    def _plain_words(self, parts: list[str]) -> dict[str, bytes]:
        """Words of Latin letters are one pre-token each: a thousand go as one text, to be cut where tokens end a word; the others are pre-split."""
        plain = [p for p in parts if _LATIN.fullmatch(p)] if self.closes.any() else []
        rest = list(set(parts).difference(plain)) if plain else parts
        out = dict(zip(rest, self._by_word(rest), strict=True))
        rows = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for row, e in zip(rows, self.lib.encode_batch_fast([" ".join(row) for row in rows], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype=self.dtype)
            data, ends = ids.tobytes(), [0, *((np.flatnonzero(self.closes[ids]) + 1) * self.size).tolist()]
            # a letter that is made two by lower-casing can end a word too early
            out.update(zip(row, [data[a:b] for a, b in zip(ends, ends[1:])] if len(ends) == len(row) + 1 else self._by_word(row), strict=True))
        return out

    def _by_blank(self, ids: np.ndarray, parts: int) -> list[bytes] | None:
        """Ids of parts that were encoded as one text, if only the first byte of each is a space or line end: there a token begins."""
        at = np.flatnonzero(self.opens[ids])
        if len(at) != parts:
            return None
        data, ends = ids.tobytes(), [*(at * self.size).tolist(), len(ids) * self.size]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _by_word(self, parts: list[str]) -> list[bytes]:
        """As if pre-split: no token crosses the parts' borders."""
        out, w = [], self.size
        rows = [parts[i : i + 1000] for i in range(0, len(parts), 1000)]
        for row, e in zip(rows, self.lib.encode_batch(rows, is_pretokenized=True, add_special_tokens=False), strict=True):
            data = np.asarray(e.ids, dtype=self.dtype).tobytes()
            ends = (np.searchsorted(np.asarray(e.word_ids, dtype=np.int64), np.arange(len(row) + 1)) * w).tolist()
            out += [data[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def encode_mark(self, mark: str) -> bytes:
        return self.whole([mark])[0]

    @property
    def size(self) -> int:
        return int(self.dtype[2:])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _is_plain(self, text: str) -> bool:
        return not any(a in text for a in self.added) and not (self.kind == "word" and _ODD_BLANK.search(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes; null counts as empty."""
        texts = [t or "" for t in texts]
        plain = [i for i, t in enumerate(texts) if t and self._is_plain(t)]
        out = [b""] * len(texts)
        cut = [byte_parts(texts[i]) if self.kind == "byte" else texts[i].split() for i in plain]
        for i, ids in zip(plain, self.assemble(cut), strict=True):
            out[i] = ids
        odd = sorted({i for i, t in enumerate(texts) if t} - {*plain})
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out


_loaded: dict[tuple, ChunkEncoder] = {}


def loaded(path: str, kind: str, width: int = 4, room: int = 150_000) -> ChunkEncoder:
    """The encoder of this worker process: its parts serve all tasks that the process runs."""
    key = (path, kind, width, room)
    if key not in _loaded:
        _loaded[key] = ChunkEncoder(path, kind, width, room)
        gc.freeze()
    return _loaded[key]
