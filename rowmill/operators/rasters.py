"""Samples of GIF, with its frames, and of plain TIFF files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from rowmill.errors import AvroError


def _lzw(data: bytes, width: int, need: int, *, reverse: bool) -> bytes:
    """Variable-width LZW. GIF packs codes from the low bit (reverse False); TIFF from the high bit, and widens one code early."""
    clear, end = 1 << width, (1 << width) + 1
    table: list[bytes] = [bytes([k]) for k in range(clear)] + [b"", b""]
    out, size, bits, held, last = bytearray(), width + 1, 0, 0, b""
    early = 1 if reverse else 0
    for byte in data:
        held = (held << 8 | byte) if reverse else held | byte << bits
        bits += 8
        while bits >= size:
            if reverse:
                code = held >> (bits - size) & ((1 << size) - 1)
                held &= (1 << (bits - size)) - 1
            else:
                code = held & ((1 << size) - 1)
                held >>= size
            bits -= size
            if code == clear:
                del table[clear + 2 :]
                size, last = width + 1, b""
                continue
            if code == end or len(out) >= need:
                return bytes(out[:need])
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise AvroError("bad compressed pixels")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            if len(table) + early >= 1 << size and size < 12:
                size += 1
    return bytes(out[:need])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while True:
        n = data[at]
        if n == 0:
            return bytes(out), at + 1
        out += data[at + 1 : at + 1 + n]
        at += n + 1


def gif_frames(data: bytes, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """(RGBA canvas, delay in milliseconds) of every frame, each drawn on what the frames before it left."""
    try:
        yield from _gif_frames(data, limit)
    except (IndexError, struct.error):
        raise AvroError("the gif ends early", "range") from None


def _gif_frames(data: bytes, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height * 4 > limit:
        raise AvroError(f"an image of {width} x {height} exceeds the memory limit")
    at, common = 13, None
    colors = lambda at, flags: np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
    if flags & 0x80:
        common = colors(at, flags)
        at += 3 << (flags & 7) + 1
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, clear, dispose = 0, None, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack("<BHB", data[at + 3 : at + 7])
                dispose, clear = packed >> 2 & 7, index if packed & 1 else None
            _, at = _blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise AvroError("bad gif block")
        x, y, w, h, local = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = common
        if local & 0x80:
            palette = colors(at, local)
            at += 3 << (local & 7) + 1
        if palette is None or x + w > width or y + h > height:
            raise AvroError("bad gif frame")
        code_width = data[at]
        if not 2 <= code_width <= 8:
            raise AvroError("bad gif code width")
        body, at = _blocks(data, at + 1)
        raw = _lzw(body, code_width, w * h, reverse=False)
        if len(raw) < w * h:
            raise AvroError("the gif pixels end early", "range")
        pixels = np.frombuffer(raw, np.uint8).reshape(h, w)
        if local & 0x40:  # interlaced: four passes over the rows
            order = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, b)]
            lines = np.empty_like(pixels)
            lines[order] = pixels
            pixels = lines
        if pixels.max(initial=0) >= len(palette):
            raise AvroError("a pixel is not in the palette")
        before = canvas.copy()
        part = canvas[y : y + h, x : x + w]
        shown = np.ones(pixels.shape, bool) if clear is None else pixels != clear
        part[shown] = np.column_stack([palette, np.full(len(palette), 255, np.uint8)])[pixels[shown]]
        yield canvas.copy(), delay * 10
        if dispose == 2:
            part[:] = 0
        elif dispose == 3:
            canvas = before
        delay, clear, dispose = 0, None, 0


_TIFF_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 11: "f", 12: "d"}


def tiff(data: bytes, limit: int) -> np.ndarray:
    """Samples of the first image of a TIFF in strips, interleaved, plain or packed with PackBits, LZW or deflate; 8 or 16 bits or 32-bit floats.

    An alpha channel that is not premultiplied is multiplied into 8-bit colours; palettes and inverted gray are resolved.
    """
    try:
        return _tiff(data, limit)
    except (IndexError, struct.error, KeyError, zlib.error, ValueError) as e:
        raise AvroError(f"bad tiff: {e}") from None


def _tiff(data: bytes, limit: int) -> np.ndarray:
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in _TIFF_TYPES or count > 1 << 20:
            continue
        form = e + str(count) + _TIFF_TYPES[kind]
        size, spot = struct.calcsize(form), at + 10 + 12 * k
        if size > 4:
            spot = struct.unpack(e + "I", data[spot : spot + 4])[0]
        tags[tag] = struct.unpack(form, data[spot : spot + size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, parts, depth, packing = one(256, 0), one(257, 0), one(277, 1), one(258, 1), one(259, 1)
    floats, meaning = one(339, 1) == 3, one(262, 1)
    if one(284, 1) != 1 or 322 in tags or not width or not height or parts not in (1, 2, 3, 4) or (depth, floats) not in ((8, False), (16, False), (32, True)) or meaning not in (0, 1, 2, 3):
        raise AvroError("this kind of tiff is not decoded")
    if width * height * parts * depth // 8 > limit:
        raise AvroError(f"an image of {width} x {height} exceeds the memory limit")
    row, rows = width * parts * depth // 8, one(278, height)
    out = bytearray()
    for k, (start, size) in enumerate(zip(tags[273], tags[279])):
        strip, need = data[start : start + size], row * min(rows, height - k * rows)
        if packing in (8, 32946):
            strip = zlib.decompressobj().decompress(strip, need)
        elif packing == 5:
            strip = _lzw(strip, 8, need, reverse=True)
        elif packing == 32773:
            strip = _pack_bits(strip, need)
        elif packing != 1:
            raise AvroError(f"tiff compression {packing} is not decoded")
        if len(strip) < need:
            raise AvroError("the tiff pixels end early", "range")
        out += strip[:need]
    kind = e + ("f4" if floats else "u2" if depth == 16 else "u1")
    px = np.frombuffer(bytes(out), kind).reshape(height, width, parts).astype(kind[1:])
    if one(317, 1) == 2 and not floats:
        px = np.cumsum(px, axis=1, dtype=px.dtype)
    if meaning == 3:
        colors = (np.array(tags[320]).reshape(3, -1).T >> 8).astype(np.uint8)
        return colors[px[:, :, 0]]
    if meaning == 0 and not floats:
        px = np.iinfo(px.dtype).max - px
    if one(338, 0) == 2 and depth == 8 and parts in (2, 4):
        px = px.copy()
        px[..., :-1] = (px[..., :-1].astype(np.uint16) * px[..., -1:] + 127) // 255
    return px


def _pack_bits(data: bytes, need: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < need:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)
