"""Column functions on single encoded values and on schemas.

Every function takes columns and returns a column; values cross to Python in Arrow batches, and decoders are compiled once
for each worker and pair of schemas.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.errors import AvroError
from rowmill.plans.decode import Decoder, decoder, json_value, read_value
from rowmill.plans.encode import compiled
from rowmill.plans.project import check_projection, project_paths
from rowmill.schema import Schema
from rowmill.types import bare, spark_type


def inlined(schema: str | Schema, schemata: list[str] | None = None) -> Schema:
    """A schema that stands alone; schemata are documents with the named types that it uses."""
    if isinstance(schema, Schema):
        return schema.self_contained()
    if schemata:
        return Schema.parse_list([*schemata, schema])[-1].self_contained()
    return Schema.parse(schema).self_contained()


def _plain(array: pa.Array) -> list:
    return (array.view(pa.binary()) if pa.types.is_string(array.type) else array).to_pylist()


def avro_encode(col: Column, schema: str | Schema, schemata: list[str] | None = None) -> Column:
    """The value's bytes. A null row is null unless the schema takes null. A value that does not fit fails the query."""
    text = inlined(schema, schemata).to_json()

    def encode(values: pa.Array) -> pa.Array:
        parsed, enc = compiled(text)
        takes_null = parsed.kind == "null" or any(b.kind == "null" for b in parsed.branches)
        out = []
        for v in _plain(values):
            if v is None and not takes_null:
                out.append(None)
                continue
            data = bytearray()
            enc(data, v)
            out.append(bytes(data))
        return pa.array(out, pa.binary())

    return F.arrow_udf(encode, T.BinaryType())(col)


def _readable(d: Decoder, data: bytes, limit: int) -> bool:
    """Whether bytes hold exactly one value; nothing is kept of them."""
    try:
        return len(data) <= limit and d.run(data, 0, 1, d.lists()) == len(data)
    except AvroError:
        return False


def avro_decode(col: Column, schema: str | Schema, *, reader: str | Schema | None = None, projection: str | Schema | None = None, columns: list[str] | None = None, schemata: list[str] | None = None, max_value_bytes: int = 512 << 20, permissive: bool = False) -> Column:
    """The value of bytes that hold exactly one, resolved to a reader's schema, or projected. Bytes left over are an error; a null row is null.

    An error fails the query, or makes its row null if permissive (bytes are then read twice).
    """
    writer = inlined(schema, schemata)
    wanted = writer
    if columns is not None:
        wanted = project_paths(writer, columns)
    elif projection is not None:
        wanted = check_projection(writer, inlined(projection, schemata))
    elif reader is not None:
        wanted = inlined(reader, schemata)
    source, paths = writer.to_json(), None if columns is None else tuple(columns)
    narrow = None if projection is None else inlined(projection, schemata).to_json()
    target = narrow or (wanted.to_json() if reader is not None and paths is None else None)

    def decode(values: pa.Array) -> pa.Array:
        d = decoder(source, target, narrow is not None, paths)
        lists, present = d.lists(), []
        for k, data in enumerate(values.to_pylist()):
            if data is None:
                continue
            if permissive and not _readable(d, data, max_value_bytes):
                continue
            if len(data) > max_value_bytes:
                raise AvroError(f"a value of {len(data)} bytes exceeds the limit of {max_value_bytes}")
            if d.run(data, 0, 1, lists) != len(data):
                raise AvroError("there are bytes after the value")
            present.append(k)
        out = d.array(lists)
        if len(present) == len(values):
            return out
        places = [None] * len(values)
        for n, k in enumerate(present):
            places[k] = n
        return out.take(pa.array(places, pa.int64()))

    return F.arrow_udf(decode, bare(spark_type(wanted.resolved(wanted.names), wanted.names)))(col)


def avro_validate(col: Column, schema: str | Schema, schemata: list[str] | None = None) -> Column:
    """Whether a value fits a schema."""
    text = inlined(schema, schemata).to_json()

    def validate(values: pa.Array) -> pa.Array:
        enc, out = compiled(text)[1], []
        for v in _plain(values):
            try:
                enc(bytearray(), v)
            except AvroError:
                out.append(False)
            else:
                out.append(True)
        return pa.array(out)

    return F.arrow_udf(validate, T.BooleanType())(col)


def avro_resolve(col: Column, writer: str | Schema, reader: str | Schema) -> Column:
    """A value of the writer's schema as the reader's: promotions, defaults, fields by name and alias."""
    return avro_decode(avro_encode(col, writer), writer, reader=reader)


def avro_to_json(col: Column, schema: str | Schema, schemata: list[str] | None = None) -> Column:
    """An encoded value as JSON text: unions as their value, bytes and text that is no UTF-8 as lists of numbers; NaN and infinities fail."""
    text = inlined(schema, schemata).to_json()

    def dump(values: pa.Array) -> pa.Array:
        parsed, out = compiled(text)[0], []
        for data in values.to_pylist():
            if data is None:
                out.append(None)
                continue
            value, end = read_value(parsed, parsed.names, data, 0)
            if end != len(data):
                raise AvroError("there are bytes after the value")
            out.append(json.dumps(json_value(value), ensure_ascii=False, separators=(",", ":")))
        return pa.array(out, pa.string())

    return F.arrow_udf(dump, T.StringType())(col)


def _schema_text(col: Column, kind: T.DataType, of) -> Column:
    def run(values: pa.Array) -> pa.Array:
        known: dict = {}
        out = []
        for v in values.to_pylist():
            if v is not None and v not in known:
                known[v] = of(Schema.parse(v))
            out.append(known.get(v))
        return pa.array(out, pa.int64() if isinstance(kind, T.LongType) else pa.string())

    return F.arrow_udf(run, kind)(col)


def schema_canonical(col: Column) -> Column:
    """Parsing canonical form of schemas in a column of JSON."""
    return _schema_text(col, T.StringType(), Schema.canonical)


def schema_rabin(col: Column) -> Column:
    return _schema_text(col, T.LongType(), Schema.rabin)


def schema_rabin_hex(col: Column) -> Column:
    return _schema_text(col, T.StringType(), Schema.rabin_hex)


def schema_md5(col: Column) -> Column:
    return F.md5(schema_canonical(col))


def schema_sha256(col: Column) -> Column:
    return F.sha2(schema_canonical(col), 256)
