"""Image files as rows: metadata of seven formats, samples of PNG, BMP, GIF and TIFF, frames of GIF.

Samples of other formats need decoders that are not at hand; for them `decode` fails and `info` still works.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.errors import AvroError
from rowmill.operators.rasters import gif_frames, tiff

FORMATS = ("png", "jpeg", "gif", "webp", "tiff", "bmp", "ico")
COLORS = {1: "L", 2: "La", 3: "Rgb", 4: "Rgba"}
_PNG = b"\x89PNG\r\n\x1a\n"


def sniff(data: bytes) -> str | None:
    """The format by its first bytes."""
    if data.startswith(_PNG):
        return "png"
    if data.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if data[:2] == b"BM":
        return "bmp"
    return "ico" if data[:4] == b"\0\0\1\0" else None


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise AvroError("the image ends within a chunk", "range")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def png_text(data: bytes) -> list[tuple[str, str]]:
    """(keyword, text) of text chunks before the image data: tEXt, then zTXt, then iTXt. Chunks that cannot be decoded are skipped."""
    found: dict[bytes, list[tuple[str, str]]] = {b"tEXt": [], b"zTXt": [], b"iTXt": []}
    try:
        for kind, body in _chunks(data):
            if kind == b"IDAT":
                break
            if kind not in found:
                continue
            key, _, rest = body.partition(b"\0")
            try:
                if kind == b"tEXt":
                    text = rest.decode("latin-1")
                elif kind == b"zTXt":
                    text = zlib.decompressobj().decompress(rest[1:], 16 << 20).decode("latin-1")
                else:
                    packed, _, rest = rest[0], rest[1], rest[2:]
                    rest = rest.split(b"\0", 2)[2]
                    text = (zlib.decompressobj().decompress(rest, 16 << 20) if packed else rest).decode("utf-8")
            except (zlib.error, ValueError, IndexError):
                continue
            found[kind].append((key.decode("latin-1"), text))
    except AvroError:
        pass
    return [x for k in found.values() for x in k]


def info(data: bytes, force: str | None = None) -> dict:
    """Format, size, colour, depth, palette, animation and embedded metadata; fields that a format or file does not tell are None."""
    kind = force or sniff(data)
    if kind not in FORMATS:
        raise AvroError("no known image format")
    out = dict.fromkeys(("width", "height", "color", "pixel_type", "input_bit_depth", "icc", "exif", "xmp", "iptc"))
    out |= {"format": kind, "is_cmyk": False, "has_palette": False, "is_animated": False, "text": []}
    try:
        _INFO[kind](data, out)
    except (struct.error, IndexError):
        raise AvroError(f"the {kind} image ends within its header", "range") from None
    return out


def _png_info(data: bytes, out: dict) -> None:
    width, height, depth, color = struct.unpack(">IIBB", data[16:26])
    chunks = dict(reversed([(k, b) for k, b in _chunks(data)])) if len(data) > 33 else {}
    alpha = color in (4, 6) or b"tRNS" in chunks
    out |= {"width": width, "height": height, "input_bit_depth": depth, "has_palette": color == 3, "pixel_type": "U16" if depth == 16 else "U8", "is_animated": b"acTL" in chunks}
    out["color"] = ("Rgb" if color in (2, 3, 6) else "L") + ("a" if alpha else "")
    if b"iCCP" in chunks:
        out["icc"] = zlib.decompress(chunks[b"iCCP"].partition(b"\0")[2][1:])
    out["exif"] = chunks.get(b"eXIf")
    out["text"] = png_text(data)
    out["xmp"] = next((t.encode() for k, t in out["text"] if k == "XML:com.adobe.xmp"), None)


def _jpeg_info(data: bytes, out: dict) -> None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise AvroError("bad jpeg marker")
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body.startswith(b"Exif\0\0"):
            out["exif"] = body[6:]
        elif mark == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            out["xmp"] = body[29:]
        elif mark == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            out["icc"] = (out["icc"] or b"") + body[14:]
        elif mark == 0xED and body.startswith(b"Photoshop 3.0\0"):
            out["iptc"] = body[14:]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            out |= {"width": width, "height": height, "input_bit_depth": depth, "is_cmyk": parts == 4, "color": "L" if parts == 1 else "Rgb", "pixel_type": "U8"}
        elif mark == 0xDA:
            return
        at += 2 + size


def _gif_info(data: bytes, out: dict) -> None:
    width, height, flags = struct.unpack("<HHB", data[6:11])
    out |= {"width": width, "height": height, "color": "Rgba", "pixel_type": "U8", "has_palette": True, "input_bit_depth": (flags >> 4 & 7) + 1}
    at, frames = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x2C:
            frames += 1
            local = data[at + 9]
            at += 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1
        else:
            at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    out["is_animated"] = frames > 1


def _webp_info(data: bytes, out: dict) -> None:
    kind = data[12:16]
    out["pixel_type"] = "U8"
    if kind == b"VP8X":
        flags = data[20]
        out |= {"width": int.from_bytes(data[24:27], "little") + 1, "height": int.from_bytes(data[27:30], "little") + 1, "color": "Rgba" if flags & 16 else "Rgb", "is_animated": bool(flags & 2)}
        at = 12
        while at + 8 <= len(data):
            name, size = struct.unpack("<4sI", data[at : at + 8])
            key = {b"ICCP": "icc", b"EXIF": "exif", b"XMP ": "xmp"}.get(name)
            if key:
                out[key] = data[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    elif kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        out |= {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "color": "Rgba" if bits >> 28 & 1 else "Rgb"}
    else:
        width, height = struct.unpack("<HH", data[26:30])
        out |= {"width": width & 0x3FFF, "height": height & 0x3FFF, "color": "Rgb"}


def _tiff_info(data: bytes, out: dict) -> None:
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1}.get(kind, 4) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        raw = data[place : place + size]
        tags[tag] = raw if kind in (1, 2, 7) else struct.unpack(e + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
    parts = tags.get(277, 1)
    out |= {"width": tags.get(256), "height": tags.get(257), "input_bit_depth": tags.get(258, 1), "is_cmyk": tags.get(262) == 5, "has_palette": tags.get(262) == 3, "icc": tags.get(34675), "xmp": tags.get(700), "iptc": tags.get(33723)}
    out |= {"color": "Rgb" if out["is_cmyk"] else COLORS.get(parts), "pixel_type": "F32" if tags.get(339) == 3 else "U16" if tags.get(258, 1) == 16 else "U8"}


def _bmp_info(data: bytes, out: dict) -> None:
    width, height, _, depth = struct.unpack("<iiHH", data[18:30])
    out |= {"width": width, "height": abs(height), "input_bit_depth": depth, "has_palette": depth <= 8, "color": "Rgba" if depth == 32 else "Rgb", "pixel_type": "U8"}


def _ico_info(data: bytes, out: dict) -> None:
    entries = [data[6 + 16 * k : 22 + 16 * k] for k in range(struct.unpack("<H", data[4:6])[0])]
    best = max(entries, key=lambda e: (e[0] or 256) * (e[1] or 256))
    out |= {"width": best[0] or 256, "height": best[1] or 256, "input_bit_depth": struct.unpack("<H", best[6:8])[0] or None, "color": "Rgba", "pixel_type": "U8"}


_INFO = {"png": _png_info, "jpeg": _jpeg_info, "gif": _gif_info, "webp": _webp_info, "tiff": _tiff_info, "bmp": _bmp_info, "ico": _ico_info}


def _unfilter(raw: np.ndarray, rows: int, row_bytes: int, step: int) -> np.ndarray:
    """Undo PNG's row filters; a predicted byte depends on the one `step` before it and on the row above."""
    out = np.zeros((rows + 1, row_bytes), np.uint8)
    for y in range(rows):
        kind, line = raw[y, 0], raw[y, 1:]
        above = out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            lanes = np.zeros(-(-row_bytes // step) * step, np.uint64)
            lanes[:row_bytes] = line
            out[y + 1] = np.cumsum(lanes.reshape(-1, step), axis=0).astype(np.uint8).ravel()[:row_bytes]
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            own, src, up = bytearray(row_bytes), line.tolist(), above.tolist()
            for x in range(row_bytes):
                a, b = (own[x - step] if x >= step else 0), up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                own[x] = (src[x] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(own), np.uint8)
        else:
            raise AvroError(f"{kind} is no row filter")
    return out[1:]


def _unpack(lines: np.ndarray, width: int, depth: int, parts: int) -> np.ndarray:
    if depth == 8:
        return lines[:, : width * parts].reshape(len(lines), width, parts)
    if depth == 16:
        return lines[:, : width * parts * 2].copy().view(">u2").astype(np.uint16).reshape(len(lines), width, parts)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, :, None]


#: The seven passes of interlaced images: first column, first row, and steps.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png(data: bytes, limit: int) -> np.ndarray:
    width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    parts = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if parts is None or not width or not height or depth not in (1, 2, 4, 8, 16):
        raise AvroError("bad png header")
    if width * height * 4 * (2 if depth == 16 else 1) > limit:
        raise AvroError(f"an image of {width} x {height} exceeds the memory limit")
    body, palette, clear = [], None, None
    for kind, chunk in _chunks(data):
        if kind == b"IDAT":
            body.append(chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
    shapes = [(0, 0, 1, 1)] if not interlaced else _PASSES
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in shapes]
    row = lambda w: -(-w * parts * depth // 8)
    need = sum(h * (row(w) + 1) for w, h in sizes if w > 0 and h > 0)
    try:
        raw = zlib.decompressobj().decompress(b"".join(body), need)
    except zlib.error as e:
        raise AvroError(f"bad png data: {e}") from None
    if len(raw) < need:
        raise AvroError("the png data end early", "range")
    out, at = np.zeros((height, width, parts), np.uint16 if depth == 16 else np.uint8), 0
    for (x, y, dx, dy), (w, h) in zip(shapes, sizes):
        if w > 0 and h > 0:
            lines = np.frombuffer(raw, np.uint8, h * (row(w) + 1), at).reshape(h, -1)
            at += h * (row(w) + 1)
            out[y::dy, x::dx] = _unpack(_unfilter(lines, h, row(w), max(1, parts * depth // 8)), w, depth, parts)
    if color == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise AvroError("a pixel is not in the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            palette = np.column_stack([palette, alpha])
        return palette[out[:, :, 0]]
    most = 65535 if depth == 16 else 255
    if clear is not None and color in (0, 2):
        see_through = np.frombuffer(clear, ">u2").astype(out.dtype)
        alpha = np.where((out == see_through).all(axis=2), 0, most).astype(out.dtype)
    if color == 0 and depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    return np.dstack([out, alpha]) if clear is not None and color in (0, 2) else out


def _bmp(data: bytes, limit: int) -> np.ndarray:
    start, size = struct.unpack("<II", data[10:18])
    width, height, _, depth, packing = struct.unpack("<iiHHI", data[18:34])
    if packing not in (0, 3) or depth not in (8, 24, 32) or width <= 0:
        raise AvroError("this kind of bmp is not decoded")
    rows, row = abs(height), -(-width * depth // 32) * 4
    if width * rows * 4 > limit:
        raise AvroError(f"an image of {width} x {rows} exceeds the memory limit")
    lines = np.frombuffer(data, np.uint8, rows * row, start).reshape(rows, row)[:, : width * depth // 8].reshape(rows, width, -1)
    lines = lines[::-1] if height > 0 else lines
    if depth == 8:
        colors = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        return colors[lines[:, :, 0]]
    return lines[:, :, [2, 1, 0, 3][: depth // 8]]


def blend(samples: np.ndarray, background_8: tuple[int, ...], background_16: tuple[int, ...]) -> np.ndarray:
    """Pixels over a background (RGBA); gray images take its green and alpha. Images without alpha stay as they are."""
    if samples.shape[2] not in (2, 4):
        return samples
    most = np.float32(65535 if samples.dtype == np.uint16 else 255)
    color = np.array(background_16 if samples.dtype == np.uint16 else background_8, np.float32)
    color = (color if samples.shape[2] == 4 else color[[1, 3]]) / most
    own = samples.astype(np.float32) / most
    a, b = own[..., -1:], color[-1]
    total = b + a - b * a
    with np.errstate(divide="ignore", invalid="ignore"):
        mixed = (own[..., :-1] * a + color[:-1] * b * (1 - a)) / total
    out = np.concatenate([mixed, total], axis=2)
    out = np.where(a == 0, color, np.where(a == 1, own, np.where(total == 0, color, out)))
    return np.floor(np.clip(out * most + np.float32(1e-3), 0, most)).astype(samples.dtype)


def decode(data: bytes, *, force: str | None = None, limit: int = 512 << 20, background_8: tuple[int, ...] | None = None, background_16: tuple[int, ...] | None = None) -> np.ndarray:
    """Samples as rows x columns x channels, 8-bit, 16-bit or float as the file has them; of a GIF the first frame."""
    kind = force or sniff(data)
    if kind not in _DECODE:
        raise AvroError(f"samples of {kind} are not decoded")
    try:
        out = _DECODE[kind](data, limit)
    except (struct.error, ValueError) as e:
        raise AvroError(f"bad {kind} image: {e}") from None
    return blend(out, background_8 or (0, 0, 0, 0), background_16 or (0, 0, 0, 0)) if background_8 or background_16 else out


def _first_frame(data: bytes, limit: int) -> np.ndarray:
    for frame, _ in gif_frames(data, limit):
        return frame
    raise AvroError("a gif without frames", "range")


_DECODE = {"png": _png, "bmp": _bmp, "gif": _first_frame, "tiff": tiff}


def frames(data: bytes, *, limit: int = 512 << 20) -> list[tuple[np.ndarray, int]]:
    """(samples, delay in milliseconds) of all frames of an animated GIF."""
    if not info(data)["is_animated"] or sniff(data) != "gif":
        raise AvroError("the image is not animated, or not in a format whose frames are decoded", "precondition")
    return list(gif_frames(data, limit))


def encode_png(samples: np.ndarray, text: list[tuple[str, str]] = ()) -> bytes:
    """A PNG of samples, for fixtures and exports."""
    color = {1: 0, 2: 4, 3: 2, 4: 6}[samples.shape[2]]
    deep = samples.dtype == np.uint16
    lines = (samples.astype(">u2") if deep else samples).reshape(len(samples), -1).view(np.uint8)
    body = b"".join(b"\0" + r.tobytes() for r in lines)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", samples.shape[1], samples.shape[0], 16 if deep else 8, color, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in text) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


INFO_SCHEMA = "width long, height long, color string, pixel_type string, input_bit_depth int, icc binary, exif binary, xmp binary, iptc binary, format string, is_cmyk boolean, has_palette boolean, is_animated boolean, text array<struct<keyword:string,text:string>>"


def image_info(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and metadata of images in a binary column; an image that cannot be read has the reason in `error`."""
    names = [x.split()[0] for x in INFO_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types.get(x.split()[1], pa.list_(pa.struct([("keyword", pa.string()), ("text", pa.string())]))) for x in INFO_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    rows.append(info(data) if data is not None else {})
                    errors.append(None if data is not None else "no image")
                except AvroError as e:
                    rows.append({})
                    errors.append(str(e))
            cols = [pa.array([[dict(zip(("keyword", "text"), t)) for t in r[n]] if n == "text" and r.get(n) is not None else r.get(n) for r in rows], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(errors, pa.string())], names=[key, *names, "error"])

    return images.select(key, content).mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, {INFO_SCHEMA}, error string")


#: Samples of a batch of images, about.
BATCH_SAMPLES = 4_000_000


def image_samples(images: DataFrame, key: str, content: str = "content", **options: object) -> DataFrame:
    """key, width, height, channels, bits, strides and samples (rows, columns, channels in order) of images whose format is decoded, as numbers.

    Nulls are left out; an image that cannot be decoded has the reason in `error` and no samples. Images come in batches of
    some four million samples, which pass as numbers of an Arrow list, not one by one.
    """
    names = [key, "width", "height", "channels", "bits", "strides", "samples", "error"]
    stride = pa.struct([(n, pa.int64()) for n in ("width", "height", "channels")])

    def table(keys: list, rows: list[np.ndarray | None], errors: list[str | None], kind: pa.DataType) -> pa.RecordBatch:
        size = lambda k, t: pa.array([None if r is None else r.shape[k] for r in rows], t)
        offsets = pa.array([0, *np.cumsum([0 if r is None else r.size for r in rows])], pa.int32())
        numbers = np.concatenate([np.empty(0), *(r.ravel() for r in rows if r is not None)]).astype(np.float64)
        samples = pa.ListArray.from_arrays(offsets, pa.array(numbers), mask=pa.array([r is None for r in rows]))
        bits = pa.array([None if r is None else r.dtype.itemsize * 8 for r in rows], pa.int32())
        strides = pa.array([None if r is None else {"width": r.shape[2], "height": r.shape[1] * r.shape[2], "channels": 1} for r in rows], stride)
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), size(1, pa.int64()), size(0, pa.int64()), size(2, pa.int32()), bits, strides, samples, pa.array(errors, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, errors, held = [], [], [], 0
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py()
                if data is None:
                    continue
                row, error = None, None
                try:
                    row = decode(data, **options)
                except AvroError as e:
                    error = str(e)
                keys, rows, errors = [*keys, batch.column(0)[at].as_py()], [*rows, row], [*errors, error]
                held += 0 if row is None else row.size
                if held >= BATCH_SAMPLES:
                    yield table(keys, rows, errors, batch.column(0).type)
                    keys, rows, errors, held = [], [], [], 0
            if keys:
                yield table(keys, rows, errors, batch.column(0).type)

    return images.select(key, content).mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, width long, height long, channels int, bits int, strides struct<width:long,height:long,channels:long>, samples array<double>, error string")


def jvm_samples(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels and samples as bytes (rows, columns; red, green, blue, alpha) of a folder of images, by the JVM's decoders, JPEG among them.

    Files that the JVM cannot decode are left out, as Spark's own image source does.
    """
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def turn(data: pa.Array, channels: pa.Array) -> pa.Array:
        out = []
        for d, c in zip(data.to_pylist(), channels.to_pylist()):
            s = np.frombuffer(d, np.uint8).reshape(-1, c)
            out.append((s if c == 1 else s[:, [2, 1, 0, *range(3, c)]]).tobytes())
        return pa.array(out, pa.binary())

    return i.select(F.col("origin").alias("path"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("nChannels").alias("channels"), F.arrow_udf(turn, T.BinaryType())("data", "nChannels").alias("samples"))


def image_frames(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, frame number, delay in milliseconds, width, height and RGBA samples of every frame of animated images; others give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py()
                if data is None or sniff(data) != "gif" or not info(data)["is_animated"]:
                    continue
                for n, (s, delay) in enumerate(gif_frames(data, 512 << 20)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, 1), pa.array([n], pa.int32()), pa.array([delay], pa.int64()), pa.array([s.shape[1]], pa.int64()), pa.array([s.shape[0]], pa.int64()), pa.array([s.tobytes()], pa.binary())],
                        names=[key, "frame", "delay_ms", "width", "height", "samples"],
                    )

    return images.select(key, content).mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, frame int, delay_ms long, width long, height long, samples binary")
