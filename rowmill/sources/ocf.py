"""Spark data source "ocf": batch and stream reads of Avro container files, and writes.

Options of a read: path; readerSchema (JSON: resolve to it), or projection (JSON) or columns (comma-separated dotted
paths) to decode only those fields; splitBytes; maxBlockBytes, maxExpandedBytes; batchRows; pushdown ("true" tests flat
predicates before rows reach the JVM); maxFilesPerTrigger for streams (not with the availableNow trigger, which asks a
source only once how far it goes). A projection is an explicit option because Spark
tells a Python source neither the columns nor the fields that a query needs.

Files are cut into byte ranges. A task looks for the sync marker in its range and takes the blocks that begin there, so
planning costs one directory listing and one header, whatever the size of the files.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from rowmill.errors import AvroError
from rowmill.plans.decode import Decoder, decoder
from rowmill.plans.project import check_projection, project_paths
from rowmill.plans.wire import read_long
from rowmill.schema import Schema
from rowmill.sources.codec import check_codec, decompress
from rowmill.sources.container import MAX_BLOCK, MAX_EXPANDED, Header, Writer, block_index, check_block, check_rows, read_header
from rowmill.sources.files import list_files, open_fs, open_input
from rowmill.types import avro_schema, struct_of

SPLIT = 32 << 20


@dataclass
class Options:
    """Checked options of a read."""

    path: str
    reader: str | None
    projection: str | None
    columns: list[str] | None
    split: int
    max_block: int
    max_expanded: int
    batch_rows: int
    suffix: str

    @staticmethod
    def of(raw) -> Options:
        def number(name: str, default: int) -> int:
            n = int(raw.get(name, default))
            if n <= 0:
                raise AvroError(f"{name} must be positive")
            return n

        path = raw.get("path")
        if not path:
            raise AvroError("no path is given")
        columns = [c.strip() for c in raw["columns"].split(",")] if raw.get("columns") else None
        if sum(x is not None for x in (raw.get("readerSchema"), raw.get("projection"), columns)) > 1:
            raise AvroError("readerSchema, projection and columns exclude each other")
        return Options(path, raw.get("readerSchema"), raw.get("projection"), columns, number("splitBytes", SPLIT), number("maxBlockBytes", MAX_BLOCK), number("maxExpandedBytes", MAX_EXPANDED), number("batchRows", 65_536), raw.get("suffix", ".avro"))

    def first_header(self) -> Header:
        files = list_files(self.path, self.suffix)
        if not files:
            raise AvroError(f"no files at {self.path}", "missing")
        with open_input(self.path, files[0].path) as f:
            return read_header(f)

    def wanted(self, writer: Schema) -> Schema:
        if self.columns:
            return project_paths(writer, self.columns)
        if self.projection:
            return check_projection(writer, Schema.parse(self.projection))
        return Schema.parse(self.reader) if self.reader else writer

    def decoder(self, writer: Schema, first: Schema) -> Decoder:
        """For one file: projected strictly, or resolved to the reader's schema or the first file's."""
        text = writer.to_json()
        if self.columns:
            return decoder(text, columns=tuple(self.columns))
        if self.projection:
            return decoder(text, self.projection, projected=True)
        if self.reader:
            return decoder(text, self.reader)
        return decoder(text) if writer == first else decoder(text, first.to_json())


@dataclass
class Range(ds.InputPartition):
    path: str
    start: int
    end: int
    first_schema: str


def read_range(options: Options, part: Range, keep=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the blocks that begin in a byte range of a file."""
    with open_input(options.path, part.path) as f:
        header = read_header(f)
        decode = options.decoder(header.schema, Schema.parse(part.first_schema))
        pos = _first_block(f, header, part.start, part.end)
        lists, rows = decode.lists(), 0
        while pos is not None and pos < part.end:
            f.seek(pos)
            head = f.read(20)
            if not head:
                break
            count, at = read_long(head, 0)
            size, at = read_long(head, at)
            check_block(count, size, options.max_block)
            f.seek(pos + at)
            payload = f.read(size + 16)
            if len(payload) < size + 16:
                raise AvroError(f"{part.path} ends within a block", "range")
            if payload[size:] != header.marker:
                raise AvroError(f"{part.path}: wrong marker after the block at offset {pos}")
            data = decompress(header.codec, payload[:size], options.max_expanded)
            check_rows(count, len(data))
            if decode.run(data, 0, count, lists) != len(data):
                raise AvroError(f"{part.path}: the block at offset {pos} has bytes after its last row")
            rows += count
            pos += at + size + 16
            if rows >= options.batch_rows:
                yield from _give(decode, lists, keep)
                lists, rows = decode.lists(), 0
        if rows:
            yield from _give(decode, lists, keep)


def _give(decode: Decoder, lists: list, keep) -> Iterator[pa.RecordBatch]:
    batch = decode.batch(lists)
    if keep is not None:
        batch = batch.filter(keep(batch))
    if batch.num_rows:
        yield batch


def _first_block(f, header: Header, start: int, end: int) -> int | None:
    """Where the first block at or after `start` begins: right after a marker."""
    if start <= header.size:
        return header.size
    at, tail = start - 16, b""
    f.seek(at)
    while at < end:
        data = f.read(1 << 20)
        if not data:
            return None
        window = tail + data
        if (k := window.find(header.marker)) >= 0:
            return at - len(tail) + k + 16
        tail = window[-15:]
        at += len(data)
    return None


class OcfReader(ds.DataSourceReader):
    def __init__(self, options: Options):
        self.options = options
        self.tests: list = []

    def partitions(self) -> list[Range]:
        first = self.options.first_header().schema.to_json()
        return ranges(self.options, list_files(self.options.path, self.options.suffix), first)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.options, partition, _tester(self.tests))


def ranges(options: Options, files: list, first: str) -> list[Range]:
    return [Range(f.path, at, min(at + options.split, f.size), first) for f in files for at in range(0, max(f.size, 1), options.split)]


class OcfFilteringReader(OcfReader):
    """Also tests simple predicates on flat columns, keeping every row that Spark would keep. Every filter is handed back, so Spark tests it again."""

    def pushFilters(self, filters):
        for f in filters:
            kind = type(f).__name__
            if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "IsNotNull", "In") and len(f.attribute) == 1:
                self.tests.append((kind, f.attribute[0], getattr(f, "value", None)))
        return filters


_COMPARE = {"EqualTo": pc.equal, "GreaterThan": pc.greater, "GreaterThanOrEqual": pc.greater_equal, "LessThan": pc.less, "LessThanOrEqual": pc.less_equal}


def _test(column: pa.Array, kind: str, value) -> pa.Array:
    """Which values pass. Spark holds NaN equal to itself and above all other numbers, where Arrow holds no comparison with it true."""
    if kind == "IsNotNull":
        return pc.is_valid(column)
    floating = pa.types.is_floating(column.type)
    if kind == "In":
        if not floating:
            return pc.is_in(column, pa.array(list(value), column.type))
        hits = [_test(column, "EqualTo", v) for v in value if v is not None]
        return functools.reduce(pc.or_kleene, hits) if hits else pa.array([False] * len(column))
    if not floating:
        return _COMPARE[kind](column, pa.scalar(value, column.type))
    nan = pc.is_nan(column)
    if value == value:
        hit = _COMPARE[kind](column, pa.scalar(value, column.type))
        return pc.or_kleene(hit, nan) if kind.startswith("Greater") else hit
    if kind == "GreaterThan":
        return pc.and_(nan, False)
    if kind == "LessThan":
        return pc.invert(nan)
    return pc.is_valid(column) if kind == "LessThanOrEqual" else nan


def _tester(tests: list):
    if not tests:
        return None

    def keep(batch: pa.RecordBatch) -> pa.Array:
        out = pa.array([True] * batch.num_rows)
        for kind, name, value in tests:
            try:
                hit = _test(batch.column(name), kind, value)
            except (pa.ArrowException, TypeError, ValueError):
                continue
            out = pc.and_(out, pc.fill_null(hit, False))
        return out

    return keep


def _marks(paths) -> str:
    """A set of paths as text: their sorted 64-bit hashes, packed."""
    return base64.b64encode(zlib.compress(b"".join(sorted(hashlib.blake2b(p.encode(), digest_size=8).digest() for p in paths)))).decode()


def _marked(text: str) -> set[bytes]:
    data = zlib.decompress(base64.b64decode(text))
    return {data[k : k + 8] for k in range(0, len(data), 8)}


class OcfStreamReader(ds.DataSourceStreamReader):
    """Files of a folder, each once, whatever their names and modification times: an offset holds the set of files seen that are still there.

    With maxFilesPerTrigger new files come in the order of their modification times; the first batch after a restart takes all
    that are new, as Spark does not tell a Python source then where it was. An offset has 8 bytes for each file in
    the folder, so move old files away. A file of an offset that is gone before it was read fails the batch.
    """

    def __init__(self, options: Options, per_trigger: int):
        self.options, self.per_trigger = options, per_trigger
        self.seen: set[bytes] | None = None

    def _files(self) -> dict[bytes, object]:
        files = sorted(list_files(self.options.path, self.options.suffix), key=lambda f: (int(f.mtime_ns or 0), f.path))
        return {hashlib.blake2b(f.path.encode(), digest_size=8).digest(): f for f in files}

    def initialOffset(self) -> dict:
        self.seen = set()
        return {"files": _marks([])}

    def latestOffset(self) -> dict:
        files = self._files()
        new = [h for h in files if self.seen is None or h not in self.seen]
        if self.per_trigger and self.seen is not None:
            new = new[: self.per_trigger]
        self.seen = (self.seen or set()) & files.keys() | set(new)
        return {"files": _marks(files[h].path for h in self.seen)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after = _marked(end["files"])
        self.seen = (self.seen or set()) | after
        new, files = after - _marked(start["files"]), self._files()
        if new - files.keys():
            raise AvroError(f"{len(new - files.keys())} files of the batch are gone from {self.options.path}", "missing")
        return ranges(self.options, [f for h, f in files.items() if h in new], self.options.first_header().schema.to_json()) if new else []

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.options, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


@dataclass
class Written(ds.WriterCommitMessage):
    temporary: str
    final: str
    rows: int


class OcfWriter(ds.DataSourceArrowWriter):
    """Each task writes a hidden file; the commit renames them all, and an abort removes them, so that a retried task leaves no rows twice."""

    def __init__(self, raw, schema: T.StructType, overwrite: bool):
        self.path, self.overwrite = raw["path"], overwrite
        self.codec = check_codec(raw.get("codec", "deflate"))
        self.schema = raw.get("avroSchema") or avro_schema(schema, raw.get("recordName", "topLevelRecord"), raw.get("recordNamespace", "")).to_json()
        self.marker = bytes.fromhex(raw["marker"]) if raw.get("marker") else None
        self.block_rows, self.block_bytes = int(raw.get("blockRows", 4096)), int(raw.get("blockBytes", 1 << 20))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = open_fs(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}-{self.job}.avro"
        temporary = f"{root}/.{name}.{task.taskAttemptId()}.tmp"
        writer, rows = Writer(Schema.parse(self.schema), self.codec, self.marker, self.block_rows, self.block_bytes), 0
        with system.open_output_stream(temporary) as out:
            for batch in iterator:
                writer.append_batch(batch)
                rows += batch.num_rows
                out.write(writer.take_bytes())
            out.write(writer.finish())
        return Written(temporary, f"{root}/{name}", rows)

    def commit(self, messages) -> None:
        """New files get their names first, and only then old ones go, so that a crash in between loses no row; file operations run side by side."""
        system, _ = open_fs(self.path)
        done = [m for m in messages if m is not None]
        old = list_files(self.path) if self.overwrite else []
        full = [m for m in done if m.rows] or done[:1]  # a table without rows keeps one file for its schema
        kept = {m.temporary for m in full}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: system.move(m.temporary, m.final), full))
            list(pool.map(system.delete_file, [f.path for f in old] + [m.temporary for m in done if m.temporary not in kept]))

    def abort(self, messages) -> None:
        system, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class OcfDataSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "ocf"

    def schema(self) -> T.StructType:
        options = Options.of(self.options)
        return struct_of(options.wanted(options.first_header().schema))

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        filtering = str(self.options.get("pushdown", "false")).lower() == "true"
        return (OcfFilteringReader if filtering else OcfReader)(Options.of(self.options))

    def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:
        return OcfStreamReader(Options.of(self.options), int(self.options.get("maxFilesPerTrigger", 0)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceArrowWriter:
        return OcfWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OcfDataSource)


def read_ocf(spark: SparkSession, path: str, columns: list[str] | None = None, *, reader_schema: str | None = None, projection: str | None = None, **options: object) -> DataFrame:
    """A DataFrame of container files. columns: dotted paths; only those fields are decoded."""
    register(spark)
    read = spark.read.format("ocf")
    given = {"columns": ",".join(columns) if columns else None, "readerSchema": reader_schema, "projection": projection, **options}
    for k, v in given.items():
        if v is not None:
            read = read.option(k, str(v))
    return read.load(path)


def write_ocf(df: DataFrame, path: str, *, codec: str = "deflate", mode: str = "overwrite", schema: str | None = None, **options: object) -> None:
    register(df.sparkSession)
    out = df.write.format("ocf").mode(mode).option("codec", codec)
    for k, v in {"avroSchema": schema, **options}.items():
        if v is not None:
            out = out.option(k, str(v))
    out.save(path)


def ocf_schema(path: str) -> Schema:
    """The writer's schema of the first file."""
    return Options.of({"path": path}).first_header().schema


def ocf_count(spark: SparkSession, path: str) -> DataFrame:
    """One row, n: rows of all files, from block headers alone; one task for each file, and no payload is read."""
    files = [f.path for f in list_files(path)]

    def count(batches):
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                with open_input(path, p) as f:
                    out.append(sum(b.rows for b in block_index(f, read_header(f))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["rows"])

    listed = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, min(len(files), 10_000)))
    counts = listed.mapInArrow(count, "rows long")
    return counts.selectExpr("coalesce(sum(rows), 0) AS n")

