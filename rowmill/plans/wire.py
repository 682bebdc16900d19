"""Primitive encodings, with strict bounds. Positions past the end of a buffer are truncation."""

from __future__ import annotations

import re
from functools import lru_cache

from rowmill.errors import AvroError

#: Most items of one array or map, on read.
MAX_ITEMS = 1 << 26


def read_long(buf: bytes, pos: int) -> tuple[int, int]:
    """A zigzag varint; a tenth byte may only hold the last bit."""
    shift = n = 0
    while True:
        if pos >= len(buf):
            raise AvroError("the data ends within a number", "range")
        b = buf[pos]
        pos += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            break
        shift += 7
        if shift > 63:
            raise AvroError(f"a number has too many bytes before offset {pos}")
    if n >> 64:
        raise AvroError(f"a number is too large before offset {pos}")
    return (n >> 1) ^ -(n & 1), pos


@lru_cache(maxsize=4096)
def _numbers(count: int):
    return re.compile(b"(?:[\x80-\xff]{0,9}+[\x00-\x7f]){%d}" % count, re.S).match


def skip_numbers(buf: bytes, pos: int, count: int) -> int:
    """Step over so many numbers, by one match of a pattern for each 4096 of them."""
    while count:
        part = count if count < 4096 else 4096
        m = _numbers(part)(buf, pos)
        if m is None:
            raise AvroError(f"the data ends within a number after offset {pos}", "range")
        pos, count = m.end(), count - part
    return pos


#: A number, and text or bytes of up to 63 bytes, as patterns; longer ones are stepped over one by one.
NUMBER, SHORT = b"[\x80-\xff]{0,9}+[\x00-\x7f]", b"(?>" + b"|".join(re.escape(bytes([2 * k])) + b".{%d}" % k for k in [16, 8, 4, *(k for k in range(64) if k not in (4, 8, 16))]) + b")"


@lru_cache(maxsize=4096)
def _items(pattern: bytes, count: int):
    return re.compile(b"(?:%s){%d}" % (pattern, count), re.S).match


class Matchers(dict):
    """For so many items of a pattern, the match of all of them at once."""

    def __init__(self, pattern: bytes):
        self.pattern = pattern

    def __missing__(self, count: int):
        self[count] = match = _items(self.pattern, count)
        return match


def skip_items(pattern: bytes, buf: bytes, pos: int, count: int) -> tuple[int, int]:
    """(position, items left) after stepping over items of a pattern, by few matches; items are left from where one does not fit the pattern."""
    while count:
        part = count if count <= 16 else 1 << (min(count, 512).bit_length() - 1)
        m = _items(pattern, part)(buf, pos)
        while m is None and part > 1:
            part //= 2
            m = _items(pattern, part)(buf, pos)
        if m is None:
            return pos, count
        pos, count = m.end(), count - part
    return pos, 0


def write_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def read_bytes(buf: bytes, pos: int) -> tuple[bytes, int]:
    n, pos = read_long(buf, pos)
    if n < 0 or n > len(buf) - pos:
        raise AvroError(f"a length of {n} exceeds the data at offset {pos}", "range")
    return buf[pos : pos + n], pos + n


def write_bytes(out: bytearray, data: bytes) -> None:
    write_long(out, len(data))
    out += data
