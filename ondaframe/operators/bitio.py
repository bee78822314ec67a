"""One description of a record serves both ways: a port either reads fields or writes them.

`io.u(n, value)` on a Reader returns the next n bits and looks at no value; on
a Writer it appends value in n bits and returns it.  A layout is a function of
(port, record) that passes its fields through in order.
"""

from __future__ import annotations

from bisect import bisect_right


class Truncated(ValueError):
    """A read past the end."""


class Reader:
    """Bits of a byte string, most significant first."""

    writing = False

    def __init__(self, data: bytes):
        self.whole, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def u(self, n: int, value: int = 0) -> int:
        """The next n bits (at most 64)."""
        if not 0 <= n <= 64:
            raise ValueError(f"{n} bits")
        if self.at + n > self.size:
            raise Truncated(f"{n} bits at {self.at} of {self.size}")
        self.at += n
        return self.whole >> (self.size - self.at) & (1 << n) - 1

    def peek32(self) -> int:
        """32 bits ahead, zeros past the end; the cursor stays."""
        left = self.size - self.at
        ahead = self.whole & (1 << max(left, 0)) - 1
        return ahead >> left - 32 if left >= 32 else ahead << 32 - left

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise Truncated(f"skip of {n} at {self.at} of {self.size}")
        self.at += n

    def align(self, ones: bool = False) -> None:
        """On to the next whole byte."""
        self.at = min(self.size, -(-self.at // 8) * 8)

    def symbol(self, book, value: int = 0) -> int:
        ahead = self.peek32()
        k = bisect_right(book.starts, ahead) - 1
        if k < 0 or ahead >> 32 - book.lengths[k] != book.words[k]:
            raise ValueError("no code word begins like this")
        self.skip(book.lengths[k])
        return book.symbols[k]


class Writer:
    """Collects fields; `bits` is the text of zeros and ones, `data` the bytes."""

    writing = True

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0

    def u(self, n: int, value: int = 0) -> int:
        value = int(value)
        if not 0 <= n <= 64 or value < 0 or value >> n:
            raise ValueError(f"{value} does not fit {n} bits")
        if n:
            self.parts.append(format(value, f"0{n}b"))
            self.size += n
        return value

    def align(self, ones: bool = False) -> None:
        """Zeros, or ones, up to a whole byte."""
        n = -self.size % 8
        self.u(n, (1 << n) - 1 if ones else 0)

    def symbol(self, book, value: int = 0) -> int:
        word, n = book.code[value]
        self.u(n, word)
        return value

    @property
    def bits(self) -> str:
        return "".join(self.parts)

    @property
    def data(self) -> bytes:
        """Whole bytes, the last filled up with zeros."""
        n = -(-self.size // 8)
        return (int(self.bits or "0", 2) << 8 * n - self.size).to_bytes(n, "big")


def field(io, record: dict, name: str, n: int, bias: int = 0) -> int:
    """A field of the record: read into it, or written from it (0 where it is missing)."""
    record[name] = io.u(n, record.get(name, bias) - bias) + bias
    return record[name]


def flag(io, record: dict, name: str) -> bool:
    record[name] = bool(io.u(1, bool(record.get(name))))
    return record[name]


def written(layout, record, *more) -> Writer:
    io = Writer()
    layout(io, record, *more)
    return io
