"""Object container files: header, block index, incremental reader, writer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa

from rowmill.errors import AvroError
from rowmill.plans.columns import ColumnEncoder
from rowmill.plans.decode import Decoder, read_value
from rowmill.plans.encode import encoder
from rowmill.plans.project import check_projection, project_paths
from rowmill.plans.wire import read_long, write_bytes, write_long
from rowmill.schema import Schema
from rowmill.sources.codec import check_codec, compress, decompress

MAGIC = b"Obj\x01"
MAX_HEADER = 16 << 20
MAX_BLOCK = 128 << 20
MAX_EXPANDED = 512 << 20
MAX_EMPTY_ROWS = 1 << 20


@dataclass
class Header:
    schema: Schema
    codec: str
    marker: bytes
    size: int  # bytes before the first block
    metadata: dict[str, bytes]


class _More(Exception):
    """The header does not end in the data at hand."""


def parse_header(data: bytes, final: bool = True) -> Header | None:
    """The header at the start of the data; None if it does not end there and more may follow. Of a repeated key the last value counts."""
    if not MAGIC.startswith(data[:4]):
        raise AvroError("no container file")
    try:
        out = _header(data)
    except _More:
        if len(data) > MAX_HEADER:
            raise AvroError(f"the header is longer than {MAX_HEADER} bytes") from None
        if final:
            raise AvroError("the file ends within its header", "range") from None
        return None
    return out


def _header(data: bytes) -> Header:
    def long(pos: int) -> tuple[int, int]:
        try:
            return read_long(data, pos)
        except AvroError as e:
            raise _More if e.code == "range" else e

    def text(pos: int) -> tuple[bytes, int]:
        n, pos = long(pos)
        if not 0 <= n <= MAX_HEADER:
            raise AvroError(f"a length of {n} in the header")
        if pos + n > len(data):
            raise _More
        return data[pos : pos + n], pos + n

    if len(data) < 4:
        raise _More
    pos, meta = 4, {}
    while True:
        n, pos = long(pos)
        if n == 0:
            break
        if n < 0:
            n, (_, pos) = -n, long(pos)
        for _ in range(n):
            key, pos = text(pos)
            value, pos = text(pos)
            meta[key.decode("utf-8", "replace")] = value
    if pos + 16 > len(data):
        raise _More
    if pos + 16 > MAX_HEADER:
        raise AvroError(f"the header is longer than {MAX_HEADER} bytes")
    if "avro.schema" not in meta:
        raise AvroError("the header has no schema")
    codec = check_codec(meta.get("avro.codec", b"null").decode("utf-8", "replace"))
    return Header(Schema.parse(meta["avro.schema"].decode("utf-8")), codec, data[pos : pos + 16], pos + 16, meta)


def read_header(f: BinaryIO) -> Header:
    data = f.read(1 << 16)
    while (header := parse_header(data, final=False)) is None:
        more = f.read(1 << 18)
        if not more:
            return parse_header(data, final=True)
        data += more
    return header


@dataclass(frozen=True)
class Block:
    offset: int  # of the payload
    size: int
    rows: int


def block_index(f: BinaryIO, header: Header, max_block: int = MAX_BLOCK) -> Iterator[Block]:
    """All blocks, found by seeking from one to the next: nothing is decompressed or decoded, and markers are checked."""
    pos = header.size
    while True:
        f.seek(pos)
        head = f.read(20)
        if not head:
            return
        rows, at = read_long(head, 0)
        size, at = read_long(head, at)
        check_block(rows, size, max_block)
        f.seek(pos + at + size)
        marker = f.read(16)
        if len(marker) < 16:
            raise AvroError("the file ends within a block", "range")
        if marker != header.marker:
            raise AvroError(f"wrong marker after the block at offset {pos}")
        yield Block(pos + at, size, rows)
        pos += at + size + 16


def check_block(rows: int, size: int, max_block: int) -> None:
    if rows < 0 or size < 0:
        raise AvroError("a block has a negative count or size")
    if size > max_block:
        raise AvroError(f"a block of {size} bytes exceeds the limit of {max_block}")


def check_rows(rows: int, size: int) -> None:
    """Only rows of no bytes can be more than the bytes of their block; such a block costs nothing to write, so its rows are bounded."""
    if rows > size and rows > MAX_EMPTY_ROWS:
        raise AvroError(f"a block of {size} bytes claims {rows} rows, over {MAX_EMPTY_ROWS}")


class PushReader:
    """Takes bytes as they come and gives rows as soon as they are whole. The first error stays.

    With a wanted schema rows are resolved or projected; columns() gives Arrow batches, next_value() plain values in the writer's schema.
    """

    def __init__(self, wanted: Schema | None = None, projection: Schema | None = None, columns: list[str] | None = None, max_block: int = MAX_BLOCK, max_expanded: int = MAX_EXPANDED):
        if max_block <= 0:
            raise AvroError("the limit of a block must be positive")
        self.wanted, self.projection, self.paths = wanted, projection, columns
        self.max_block, self.max_expanded = max_block, max_expanded
        self.header: Header | None = None
        self.failure: AvroError | None = None
        self._data, self._pos, self._closed = bytearray(), 0, False
        self._block, self._at, self._left = b"", 0, 0
        self._decoder: Decoder | None = None

    def set_max_block(self, n: int) -> None:
        if n <= 0:
            raise AvroError("the limit of a block must be positive")
        self.max_block = n

    def feed(self, data: bytes) -> None:
        if self._closed:
            raise AvroError("the input is closed", "precondition")
        del self._data[: self._pos]
        self._pos = 0
        self._data += data

    def close_input(self) -> None:
        self._closed = True

    @property
    def has_failed(self) -> bool:
        return self.failure is not None

    @property
    def header_ready(self) -> bool:
        return self.header is not None

    @property
    def at_end(self) -> bool:
        return self._closed and not self.failure and self._left == 0 and self.header is not None and self._pos == len(self._data)

    def writer_schema(self) -> Schema:
        if self.header is None:
            raise AvroError("the header has not come yet", "range")
        return self.header.schema

    def next_ready(self) -> bool:
        """Whether a row can be read now; calling it again changes nothing."""
        if self.failure:
            raise self.failure
        try:
            return self._advance()
        except AvroError as e:
            self.failure = e
            raise

    def _advance(self) -> bool:
        if self._left:
            return True
        if self.header is None:
            self.header = parse_header(bytes(self._data), final=self._closed)
            if self.header is None:
                return False
            self._pos = self.header.size
        while True:
            if self._block is not None and self._at != len(self._block):
                raise AvroError("a block has bytes after its last row")
            head = bytes(self._data[self._pos : self._pos + 20])
            if not head:
                return False
            try:
                rows, at = read_long(head, 0)
                size, at = read_long(head, at)
            except AvroError as e:
                if e.code == "range" and not self._closed:
                    return False
                raise
            check_block(rows, size, self.max_block)
            start = self._pos + at
            if start + size + 16 > len(self._data):
                if self._closed:
                    raise AvroError("the file ends within a block", "range")
                return False
            if self._data[start + size : start + size + 16] != self.header.marker:
                raise AvroError("wrong marker after a block")
            self._block = decompress(self.header.codec, bytes(self._data[start : start + size]), self.max_expanded)
            check_rows(rows, len(self._block))
            self._at, self._left = 0, rows
            self._pos = start + size + 16
            if rows:
                return True

    def next_value(self) -> Any:
        """The next row as a plain value of the writer's schema."""
        if not self.next_ready():
            raise AvroError("no row is ready", "range")
        try:
            value, self._at = read_value(self.header.schema, self.header.schema.names, self._block, self._at)
            self._left -= 1
            if not self._left and self._at != len(self._block):
                raise AvroError("a block has bytes after its last row")
        except AvroError as e:
            self.failure = e
            raise
        return value

    def columns(self):
        """All rows of the block at hand as an Arrow batch of the wanted schema, or None."""
        if not self.next_ready():
            return None
        if self._decoder is None:
            w = self.header.schema
            narrow = project_paths(w, self.paths) if self.paths else check_projection(w, self.projection) if self.projection else self.wanted
            self._decoder = Decoder(w, narrow)
        try:
            lists = self._decoder.lists()
            self._at = self._decoder.run(self._block, self._at, self._left, lists)
            self._left = 0
            if self._at != len(self._block):
                raise AvroError("a block has bytes after its last row")
        except AvroError as e:
            self.failure = e
            raise
        return self._decoder.batch(lists)


def read_stream(f: BinaryIO, chunk: int = 1 << 16, **options: Any) -> Iterator[Any]:
    """Rows of any file-like, a chunk at a time, as plain values; memory holds one block."""
    reader = PushReader(**options)
    empty = 0
    while True:
        data = f.read(chunk)
        if data:
            reader.feed(data)
        else:
            reader.close_input()
        while reader.next_ready():
            yield reader.next_value()
        if not data:
            if reader.header is None:
                raise AvroError("the file ends within its header", "range")
            return


def read_batches(f: BinaryIO, chunk: int = 1 << 16, **options: Any) -> Iterator[pa.RecordBatch]:
    """Arrow batches of any file-like, one for each block, resolved or projected as PushReader's options say."""
    reader, data = PushReader(**options), b"-"
    while data:
        data = f.read(chunk)
        if data:
            reader.feed(data)
        else:
            reader.close_input()
        while (batch := reader.columns()) is not None:
            yield batch
    if reader.header is None:
        raise AvroError("the file ends within its header", "range")


class Writer:
    """Encodes rows into blocks of so many rows or bytes, whichever comes first."""

    def __init__(self, schema: Schema, codec: str = "null", marker: bytes | None = None, block_rows: int = 4096, block_bytes: int = 1 << 20, metadata: dict[str, bytes] | None = None):
        schema = schema.self_contained()
        Schema.parse(schema.to_json())  # it must stand alone
        self.schema, self.codec = schema, check_codec(codec)
        self.marker = marker or os.urandom(16)
        self._encode = encoder(schema, schema.names)
        self._rows, self._block, self._block_rows, self._block_bytes = 0, bytearray(), block_rows, block_bytes
        self._finished = self._failed = False
        self._columns: tuple[pa.Schema, ColumnEncoder] | None = None
        self._out = bytearray(MAGIC)
        meta = {"avro.schema": schema.to_json().encode(), "avro.codec": codec.encode(), **(metadata or {})}
        write_long(self._out, len(meta))
        for k, v in meta.items():
            write_bytes(self._out, k.encode())
            write_bytes(self._out, v)
        self._out += b"\0" + self.marker

    @property
    def is_finished(self) -> bool:
        return self._finished

    def append(self, value: Any) -> None:
        """A value that does not fit the schema is refused and leaves no trace."""
        if self._finished or self._failed:
            raise AvroError("the writer has ended", "precondition")
        size = len(self._block)
        try:
            self._encode(self._block, value)
        except Exception:
            del self._block[size:]
            raise
        self._rows += 1
        if self._rows >= self._block_rows or len(self._block) >= self._block_bytes:
            self._flush()

    def append_batch(self, batch: pa.RecordBatch) -> None:
        """All rows of an Arrow batch with the record's fields as columns. A value that does not fit ends the writer."""
        if self._finished or self._failed:
            raise AvroError("the writer has ended", "precondition")
        if self._columns is None or self._columns[0] != batch.schema:
            self._columns = (batch.schema, ColumnEncoder(self.schema, batch.schema))
        enc = self._columns[1]
        columns = enc.columns(batch)
        step = min(256, self._block_rows)
        try:
            for at in range(0, batch.num_rows, step):
                rows = min(step, batch.num_rows - at)
                enc.encode(columns, at, rows, self._block)
                self._rows += rows
                if self._rows + step > self._block_rows or len(self._block) >= self._block_bytes:
                    self._flush()
        except Exception:
            self._failed = True
            raise

    def _flush(self) -> None:
        if not self._rows:
            return
        try:
            data = compress(self.codec, bytes(self._block))
        except Exception:
            self._failed = True
            raise
        write_long(self._out, self._rows)
        write_bytes(self._out, data)
        self._out += self.marker
        self._rows = 0
        self._block.clear()

    def take_bytes(self) -> bytes:
        """What is ready so far, once."""
        out = bytes(self._out)
        self._out.clear()
        return out

    def finish(self) -> bytes:
        if self._finished or self._failed:
            raise AvroError("the writer has ended", "precondition")
        self._flush()
        self._finished = True
        return self.take_bytes()


def to_bytes(schema: Schema, values: list, codec: str = "null", **options: Any) -> bytes:
    w = Writer(schema, codec, **options)
    for v in values:
        w.append(v)
    return w.finish()

