"""Bit and byte reading for the parsers. A read past the end raises `Short`; `attempt` turns that into None, so a parser
either knows a value or says nothing."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator


class Short(Exception):
    """The data ends before the value does, or holds a value that can't be."""


class Bits:
    """Most significant bit first over a byte string, read as one large integer a window at a time."""

    WINDOW = 256

    def __init__(self, data: bytes):
        self.data, self.at, self.end = bytes(data), 0, 8 * len(data)
        self._from = self._to = self._value = 0

    def u(self, n: int) -> int:
        """n bits as an unsigned number."""
        stop = self.at + n
        if stop > self.end:
            raise Short
        if self.at < self._from or stop > self._to:
            first = self.at // 8
            part = self.data[first : max(first + self.WINDOW, (stop + 7) // 8)]
            self._from, self._to, self._value = 8 * first, 8 * (first + len(part)), int.from_bytes(part, "big")
        self.at = stop
        return self._value >> (self._to - stop) & ((1 << n) - 1)

    def flag(self) -> bool:
        return self.u(1) == 1

    def skip(self, n: int) -> None:
        if self.at + n > self.end:
            raise Short
        self.at += n

    def _zeros(self, most: int) -> int:
        """Zeros before the next one, which is read too."""
        at, width = self.at, min(most + 1, self.end - self.at)
        n = width - self.u(width).bit_length()
        if n == width:
            raise Short
        self.at = at + n + 1
        return n

    def ue(self) -> int:
        """Unsigned Exp-Golomb code."""
        n = self._zeros(31)
        return (1 << n) - 1 + self.u(n)

    def se(self) -> int:
        """Signed Exp-Golomb code."""
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)

    def uvlc(self) -> int:
        """AV1's variant, which saturates at 32 zeros."""
        n = 0
        while not self.flag():
            n += 1
            if n == 32:
                return (1 << 32) - 1
        return (1 << n) - 1 + self.u(n)


def attempt(f: Callable) -> Callable:
    """None where the parser meets the end of its data or anything that breaks it."""

    @functools.wraps(f)
    def safe(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except (Short, IndexError, ValueError, OverflowError, ArithmeticError):
            return None

    return safe


def big(data: bytes, at: int, n: int) -> int:
    """Big-endian field; 0 out of range."""
    return int.from_bytes(data[at : at + n], "big") if 0 <= at and at + n <= len(data) else 0


def little(data: bytes, at: int, n: int) -> int:
    """Little-endian field; 0 out of range."""
    return int.from_bytes(data[at : at + n], "little") if 0 <= at and at + n <= len(data) else 0


def leb128(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place) of a little-endian base-128 number of up to eight bytes."""
    value = 0
    for k in range(8):
        if at >= len(data):
            raise Short
        b = data[at]
        at += 1
        value |= (b & 0x7F) << 7 * k
        if b < 0x80:
            break
    return value, at



def rbsp(data: bytes) -> bytes:
    """Without emulation prevention: a 3 after two zeros goes, and zeros before it do not count again."""
    if b"\x00\x00\x03" not in data:
        return bytes(data)
    out, at = [], 0
    while (hit := data.find(b"\x00\x00\x03", at)) >= 0:
        out.append(data[at : hit + 2])
        at = hit + 3
    out.append(data[at:])
    return b"".join(out)


def annexb(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit between start codes; bytes before the first code are a unit too, zeros at a unit's end
    are not part of it, empty units are none."""
    start = 0
    leading = data[:3] == b"\x00\x00\x01" or data[:4] == b"\x00\x00\x00\x01"
    at = data.find(b"\x00\x00\x01")
    if leading:
        start, at = at + 3, data.find(b"\x00\x00\x01", at + 3)
    while start is not None:
        stop = at if at >= 0 else len(data)
        end = start + len(data[start:stop].rstrip(b"\x00"))
        if end > start:
            yield start, end
        start, at = (at + 3, data.find(b"\x00\x00\x01", at + 3)) if at >= 0 else (None, -1)


def length_prefixed(data: bytes, width: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit behind its length; stops at a zero or impossible length."""
    at = 0
    while at + width <= len(data):
        n = int.from_bytes(data[at : at + width], "big")
        start, at = at + width, at + width + n
        if n == 0 or at > len(data):
            return
        yield start, at


def obus(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(type, start, payload start, end) of each AV1 unit; stops at a forbidden bit or an overrun."""
    at = 0
    while at < len(data):
        head = data[at]
        if head & 0x80:
            return
        body = at + 1 + bool(head & 4)
        try:
            n, body = leb128(data, body) if head & 2 else (max(len(data) - body, 0), body)
        except Short:
            return
        if body + n > len(data):
            return
        yield head >> 3 & 15, at, body, body + n
        at = body + n
