"""Byte-level BPE of whole batches of texts, as the tokenizers library encodes them.

Texts are cut where chunked.byte_parts cuts them, and before a full stop or
comma that ends a part after a letter, but on the bytes of a batch at once.  A
part of up to 16 bytes is two 64-bit words, which an open-addressed table of
arrays finds for all parts together: no Python object is made of a part that is
known, and no hash stands for it.  Parts that are new, each once a batch, go to
the library; the ids of all texts are gathered from one pool.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .chunked import _KEPT_CHARS, ChunkEncoder

_SPACE, _LINE, _BLANK, _LEAD = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*b"\t\v\f\r\x1c\x1d\x1e\x1f"]] = _BLANK
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD
_CLASS[[0x20, 0x0A]] = _SPACE, _LINE
#: Blanks of more than one byte, as numbers of three bytes (of two, for the first).
_TWO = np.array([0xC285, 0xC2A0])
_THREE = np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: The first n bytes of a 64-bit word.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_PAD = 24
#: New parts that go to the library as one text.
_TOGETHER = 30


def part_starts(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin: b holds their bytes one after the other (and _PAD bytes more), ends those that are not empty."""
    n = int(ends[-1])
    b = b[:n]
    kind = _CLASS[b]
    blank = (kind - 1) < _BLANK  # unsigned: 0 wraps
    opens = closes = blank  # a blank begins, or ends, at this byte
    lead = np.flatnonzero(kind == _LEAD)
    if len(lead):
        two = b[lead].astype(np.int64) << 8 | b[lead + 1]
        three = two << 8 | b[np.minimum(lead + 2, n - 1)]
        wide = np.isin(two, _TWO)
        last = np.where(wide, lead + 1, lead + 2)
        wide |= np.isin(three, _THREE)
        if wide.any():
            opens, closes = blank.copy(), blank.copy()
            opens[lead[wide]] = True
            closes[last[wide]] = True
    first = np.concatenate([[0], ends[:-1]])
    cut = np.ones(n + 1, dtype=bool)  # the end too
    before = cut[:-1]  # a text goes on with what is not blank
    np.logical_not(opens[1:], out=before[:-1])
    before[ends - 1] = False
    line = np.flatnonzero(kind == _LINE)
    line = line[before[line]]
    line = line[~closes[line - 1]]
    before &= kind == _SPACE
    before[line] = True
    before[first] = True
    mark = np.flatnonzero(((b == 0x2E) | (b == 0x2C)) & cut[1:])
    one, other = b[mark - 1], b[mark - 2]
    # of two bytes: U+00C0 to U+023F but the signs for times and division
    latin = ((other >= 0xC3) & (other <= 0xC8) & (one >= 0x80) & ~((other == 0xC3) & ((one == 0x97) | (one == 0xB7))))
    mark = mark[_LETTER[one] | latin]
    before[mark] = True
    return np.flatnonzero(before)


class PartTable:
    """Ids by part.  Entry 0 is the end of a text, and what is not found.

    A part of more than 16 bytes is found in a dictionary.  When `room` entries
    are passed, or a quarter as many long ones, those that were not found again
    go, and of the others what is over half of that.
    """

    def __init__(self, room: int, end: int):
        self.room = room
        self.low, self.high = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.found = np.zeros(1 << 12, bool)
        self.pool = np.zeros(1 << 14, np.uint16)
        self.pool[0], self.length[0] = end, 1
        self.n = self.used = 1
        self.long: dict[bytes, int] = {}
        self._rehash()

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rehash(self) -> None:
        self.bits = max(14, (2 * self.n).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)
        self._place(np.flatnonzero(self.low[: self.n]))

    def _place(self, entries: np.ndarray) -> None:
        """Entries of different parts go to the first free slot from their own on."""
        at = self._slot(self.low[entries], self.high[entries])
        while len(entries):
            free = self.slots[at] == 0
            self.slots[at[free]] = entries[free]
            left = self.slots[at] != entries
            entries, at = entries[left], (at[left] + 1) & (len(self.slots) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each part, 0 if there is none."""
        at = self._slot(low, high)
        out = self.slots[at]
        wrong = np.flatnonzero((self.low[out] != low) | (self.high[out] != high))
        while len(wrong):
            wrong = wrong[out[wrong] != 0]
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            entry = self.slots[at[wrong]]
            out[wrong] = entry
            wrong = wrong[(self.low[entry] != low[wrong]) | (self.high[entry] != high[wrong])]
        self.found[out] = True
        return out

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """New entries; a low word of 0 (a long part's) is not to be found."""
        n, used = self.n + len(low), self.used + len(ids)
        if n > len(self.low):
            for name in ("low", "high", "start", "length", "found"):
                was = getattr(self, name)
                now = np.zeros(max(n, 3 * len(was) // 2), was.dtype)
                now[: len(was)] = was
                setattr(self, name, now)
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(used - len(self.pool), len(self.pool) // 2), np.uint16)])
        entries = np.arange(self.n, n)
        self.low[entries], self.high[entries], self.length[entries] = low, high, length
        self.start[entries] = self.used + np.cumsum(length, dtype=np.int64) - length
        self.found[entries] = False
        self.pool[self.used : used] = ids
        self.n, self.used = n, used
        if 2 * n > len(self.slots):
            self._rehash()
        else:
            self._place(entries[low != 0])
        return entries

    def ids(self, entries: np.ndarray) -> np.ndarray:
        """Ids of the entries one after the other."""
        length = self.length[entries].astype(np.int64)
        before = np.cumsum(length) - length
        at = np.repeat(self.start[entries] - before, length)
        at += np.arange(len(at))
        return self.pool[at]

    def forget(self, keep: np.ndarray) -> None:
        """Only the entries in `keep`, ascending from 0, stay."""
        new = np.zeros(self.n, np.int64)
        new[keep] = np.arange(len(keep))
        ids = self.ids(keep)
        low, high, length = self.low[keep[1:]], self.high[keep[1:]], self.length[keep[1:]]
        self.long = {k: int(new[e]) for k, e in self.long.items() if new[e]}
        self.n = self.used = 1
        self.slots = np.zeros(1 << 14, np.int32)
        self.bits = 14
        self.add(low, high, ids[1:], length)

    def shrink(self) -> None:
        if self.n > self.room or len(self.long) > self.room // 4:
            keep = np.flatnonzero(self.found[1 : self.n]) + 1
            long = self.low[keep] == 0
            keep = keep[~long | (np.cumsum(long) <= self.room // 8)][: self.room // 2]
            self.forget(np.concatenate([[0], keep]))


class PartEncoder(ChunkEncoder):
    """Encodes columns of texts; texts that hold an added token or a zero byte go by ChunkEncoder."""

    def __init__(self, path: str, end: int, room: int = 2_000_000):
        super().__init__(path, "byte", width=2, room=10_000)
        self.parts = PartTable(room, end)
        self.end = end
        self.odd = [*(a.encode() for a in self.added), b"\0"]

    def columns(self, texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """Slices of about `size` bytes of a column, nulls as empty texts: the first row, the texts, their offsets."""
        if not len(texts):
            return
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield at, texts.slice(at, to - at), ends[at : to + 1]
            at = to

    def encode_column(self, texts: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each text's with the end id; how many each has.  ends: the column's offsets."""
        data = texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if ends[-1] > ends[0] else b""
        if not any(a in data for a in self.odd):
            return self._plain(data, ends[1:] - ends[0])
        own = texts.to_pylist()
        odd = np.array([any(a in t.encode() for a in self.odd) for t in own])
        rest = "".join(t for t, o in zip(own, odd.tolist(), strict=True) if not o).encode()
        ids, n = self._plain(rest, np.cumsum(np.diff(ends)[~odd]))
        out: list = [None] * len(own)
        for k, x in zip(np.flatnonzero(~odd).tolist(), np.split(ids, np.cumsum(n)[:-1])):
            out[k] = x
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.append(np.frombuffer(self.encode([own[k]])[0], "<u2"), np.uint16(self.end))
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def _plain(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table, n = self.parts, len(data)
        table.shrink()
        if not n:
            return np.full(len(ends), self.end, np.uint16), np.ones(len(ends), np.int64)
        b = np.zeros(n + _PAD, np.uint8)
        b[:n] = np.frombuffer(data, np.uint8)
        start = part_starts(b, ends[np.diff(ends, prepend=0) > 0])
        size = np.diff(start, append=n)
        words = np.ndarray(n + 9, "<u8", b, strides=(1,))
        low = words[start] & _FIRST_BYTES[np.minimum(size, 8)]
        high = words[start + 8 * (size > 8)] & _FIRST_BYTES[np.clip(size - 8, 0, 8)]
        entry = table.find(low, high)
        entry[size > 16] = 0
        new = np.flatnonzero(entry == 0)
        kept = table.n, table.used
        if len(new):
            kept = self._add(data, start, size, low, high, entry, new)
        # the end of a text is a part too
        text_at = np.searchsorted(start, ends)
        whole = np.insert(entry, text_at, 0)
        ids = table.ids(whole)
        upto = np.concatenate([[0], np.cumsum(table.length[whole], dtype=np.int64)])
        count = np.diff(upto[text_at + np.arange(len(ends)) + 1], prepend=0)
        table.n, table.used = kept
        return ids, count

    def _add(self, data: bytes, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, entry: np.ndarray, new: np.ndarray) -> tuple[int, int]:
        """Entries for parts that were not found; the number of entries and ids that are to be kept: very long parts come last."""
        table = self.parts
        own = [data[a : a + k] for a, k in zip(start[new].tolist(), size[new].tolist(), strict=True)]
        one_of = dict(zip(own, range(len(own)), strict=True))
        known = {p: table.long[p] for p in one_of.keys() & table.long.keys()} if table.long else {}
        table.found[[*known.values()]] = True
        todo = [p for p in one_of if p not in known]
        brief = [p for p in todo if len(p) <= _KEPT_CHARS]
        extra = [p for p in todo if len(p) > _KEPT_CHARS]
        kept = table.n, table.used
        for parts in (brief, extra):
            if parts:
                at = new[np.fromiter(map(one_of.__getitem__, parts), np.int64, len(parts))]
                short = size[at] <= 16
                order, ids, length = self._encode_parts(parts)
                at, short = at[order], short[order]
                got = table.add(np.where(short, low[at], 0).astype(np.uint64), high[at], ids, length).tolist()
                known.update(zip([parts[k] for k in order], got, strict=True))
            if parts is brief:
                table.long.update((p, known[p]) for p in brief if len(p) > 16)
                kept = table.n, table.used
        entry[new] = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
        return kept

    def _encode_parts(self, parts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the parts; in it their ids, one after the other, and how many each has.  _TOGETHER parts go as one text where only their first bytes are spaces or line ends."""
        order, lone, ids, length = [], [], [], []
        for k, p in enumerate(parts):
            (order if p[0] in b" \n" and b" " not in p[1:] and b"\n" not in p[1:] else lone).append(k)
        rows = [order[i : i + _TOGETHER] for i in range(0, len(order), _TOGETHER)]
        order = []
        for row, e in zip(rows, self.lib.encode_batch_fast([b"".join(map(parts.__getitem__, row)).decode() for row in rows], add_special_tokens=False), strict=True):
            got = np.asarray(e.ids, dtype=np.uint16)
            at = np.flatnonzero(self.opens[got])
            if len(at) == len(row) and at[0] == 0:
                order += row
                ids.append(got)
                length.append(np.diff(at, append=len(got)))
            else:
                lone += row
        if lone:
            each = self._by_word([parts[k].decode() for k in lone])
            order += lone
            ids.append(np.frombuffer(b"".join(each), "<u2"))
            length.append(np.array([len(x) // 2 for x in each]))
        return order, np.concatenate(ids), np.concatenate(length)


_loaded: dict[tuple, PartEncoder] = {}


def loaded(path: str, end: int, room: int = 2_000_000) -> PartEncoder:
    """The encoder of this worker process: its parts serve all tasks that the process runs."""
    key = (path, end, room)
    if key not in _loaded:
        _loaded[key] = PartEncoder(path, end, room)
        gc.freeze()
    return _loaded[key]
