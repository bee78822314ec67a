"""Code books for quantised tuples and scalefactor steps.

What a book holds is fixed by the coding standard: tuples of 4 or 2 values up
to a bound, with their signs inside the word or behind it.  Which word stands
for which tuple is a parameter: `from_rows` takes (book, symbol, bits, word)
rows, such as the standard's, read from a table of the user's.  Without one
the words follow a rule: a Huffman code for falling magnitudes, in canonical
order.  Streams that other encoders made need the standard's words.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterable

#: By book, values in a tuple, whether signs are inside the word, largest magnitude.
SHAPES = {1: (4, True, 1), 2: (4, True, 1), 3: (4, False, 2), 4: (4, False, 2), 5: (2, True, 4), 6: (2, True, 4), 7: (2, False, 7), 8: (2, False, 7), 9: (2, False, 12), 10: (2, False, 12), 11: (2, False, 16)}
#: Books that code no lines (silence, noise, intensity out of phase and in phase); the escape's magnitude; the scalefactor book's key, its symbol for no change.
ZERO, NOISE, OUT_OF_PHASE, IN_PHASE, ESCAPE = 0, 13, 14, 15, 16
STEPS, SAME = 0, 60


class Book:
    """A prefix code: words by symbol, and sorted for search."""

    def __init__(self, code: dict[int, tuple[int, int]]):
        self.code = code
        rows = sorted((word << 32 - n, n, word, s) for s, (word, n) in code.items())
        self.starts, self.lengths, self.words, self.symbols = ([r[k] for r in rows] for k in range(4))
        if any(a[0] + (1 << 32 - a[1]) > b[0] for a, b in zip(rows, rows[1:], strict=False)):
            raise ValueError("a word begins another")


def canonical(weights: list[float]) -> dict[int, tuple[int, int]]:
    """Huffman code of the weights: (word, bits) by symbol, words in order of (bits, symbol)."""
    heap = [(w, k, [k]) for k, w in enumerate(weights)]
    bits = [0] * len(weights)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in a[2] + b[2]:
            bits[k] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    out, word, last = {}, 0, 0
    for n, k in sorted((n, k) for k, n in enumerate(bits)):
        word <<= n - last
        out[k], last = (word, n), n
        word += 1
    return out


def tuples(book: int) -> list[tuple[int, ...]]:
    """The tuple of each symbol: its digits, the first value being the highest."""
    size, signed, most = SHAPES[book]
    low, base = (-most, 2 * most + 1) if signed else (0, most + 1)
    return [tuple(s // base ** (size - 1 - k) % base + low for k in range(size)) for s in range(base**size)]


def symbol(book: int, values: tuple[int, ...]) -> int:
    """Of values within the book's bound; magnitudes only where signs stand apart."""
    _, signed, most = SHAPES[book]
    low, base = (-most, 2 * most + 1) if signed else (0, most + 1)
    out = 0
    for v in values:
        out = out * base + v - low
    return out


@functools.cache
def by_rule() -> dict[int, Book]:
    """The books of this library: odd ones for steeper, even ones for flatter falls."""
    fall = {1: 1.4, 2: 0.7, 3: 1.1, 4: 0.6, 5: 0.8, 6: 0.45, 7: 0.6, 8: 0.35, 9: 0.4, 10: 0.25, 11: 0.2}
    out = {b: Book(canonical([math.exp(-fall[b] * sum(map(abs, t))) for t in tuples(b)])) for b in SHAPES}
    out[STEPS] = Book(canonical([(1 + abs(k - SAME)) ** -2.5 for k in range(2 * SAME + 1)]))
    return out


def from_rows(rows: Iterable[tuple[int, int, int, int]]) -> dict[int, Book]:
    """Books from (book, symbol, bits, word); book 0 holds the scalefactor steps.  All books must be whole."""
    code: dict[int, dict[int, tuple[int, int]]] = {}
    for book, s, bits, word in rows:
        code.setdefault(book, {})[s] = (word, bits)
    for b in [STEPS, *SHAPES]:
        want = 2 * SAME + 1 if b == STEPS else len(tuples(b))
        if sorted(code.get(b, ())) != list(range(want)):
            raise ValueError(f"book {b} must have the symbols 0 to {want - 1}")
    return {b: Book(c) for b, c in code.items()}
