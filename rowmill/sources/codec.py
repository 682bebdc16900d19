"""Block codecs, each with a bound on what it expands to."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa

from rowmill.errors import AvroError

CODECS = ("null", "deflate", "snappy", "zstandard")


def check_codec(name: str) -> str:
    if name not in CODECS:
        raise AvroError(f"codec {name!r} is none of {', '.join(CODECS)}")
    return name


def compress(name: str, data: bytes) -> bytes:
    if name == "null":
        return data
    if name == "deflate":
        z = zlib.compressobj(wbits=-15)
        return z.compress(data) + z.flush()
    if name == "snappy":
        return pa.Codec("snappy").compress(data, asbytes=True) + struct.pack(">I", zlib.crc32(data))
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def decompress(name: str, data: bytes, most: int) -> bytes:
    """The block's data; more than `most` bytes are refused before they are all made."""
    too_large = AvroError(f"a block expands to more than {most} bytes")
    if name == "null":
        if len(data) > most:
            raise too_large
        return data
    if name == "deflate":
        z = zlib.decompressobj(wbits=-15)
        try:
            out = z.decompress(data, most)
            if not z.eof and (z.unconsumed_tail or z.decompress(b"", 1)):
                raise too_large
        except zlib.error as e:
            raise AvroError(f"bad deflate data: {e}") from None
        if not z.eof:
            raise AvroError("deflate data end early", "range")
        return out
    if name == "snappy":
        if len(data) < 5:
            raise AvroError("snappy data end early", "range")
        size = shift = 0
        for k, b in enumerate(data[:5]):
            size |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        if size > most:
            raise too_large
        try:
            out = pa.Codec("snappy").decompress(data[:-4], size, asbytes=True)
        except (pa.ArrowException, OSError) as e:
            raise AvroError(f"bad snappy data: {e}") from None
        if zlib.crc32(out) != struct.unpack(">I", data[-4:])[0]:
            raise AvroError("the checksum of a snappy block is wrong")
        return out
    import zstandard

    try:
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
            out = reader.read(most + 1)
    except zstandard.ZstdError as e:
        raise AvroError(f"bad zstandard data: {e}") from None
    if len(out) > most:
        raise too_large
    return out
