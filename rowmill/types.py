"""Avro types as Spark and Arrow types.

Facts that Spark has no place for (enum symbols, fixed size, branch order, full names, units) are in the
metadata of the field that holds the value. Values of recursive types are JSON text; functions.values turns that into variants.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import types as T

from rowmill.errors import AvroError
from rowmill.schema import Schema

_SPARK = {
    "null": T.NullType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
    "enum": T.StringType(),
    "fixed": T.BinaryType(),
    "big-decimal": T.BinaryType(),
    "uuid": T.StringType(),
    "date": T.DateType(),
    "time-millis": T.TimeType(6),  # Arrow knows no coarser one
    "time-micros": T.TimeType(6),
    "timestamp-millis": T.TimestampType(),
    "timestamp-micros": T.TimestampType(),
    "timestamp-nanos": T.LongType(),
    "local-timestamp-millis": T.TimestampNTZType(),
    "local-timestamp-micros": T.TimestampNTZType(),
    "local-timestamp-nanos": T.LongType(),
}
_ARROW = {
    "null": pa.null(),
    "boolean": pa.bool_(),
    "int": pa.int32(),
    "long": pa.int64(),
    "float": pa.float32(),
    "double": pa.float64(),
    "bytes": pa.binary(),
    "string": pa.string(),
    "enum": pa.string(),
    "fixed": pa.binary(),
    "big-decimal": pa.binary(),
    "uuid": pa.string(),
    "date": pa.date32(),
    "time-millis": pa.time64("ns"),
    "time-micros": pa.time64("ns"),
    "timestamp-millis": pa.timestamp("us", "UTC"),
    "timestamp-micros": pa.timestamp("us", "UTC"),
    "timestamp-nanos": pa.int64(),
    "local-timestamp-millis": pa.timestamp("us"),
    "local-timestamp-micros": pa.timestamp("us"),
    "local-timestamp-nanos": pa.int64(),
}
DURATION = ("months", "days", "millis")


def is_recursive(schema: Schema, names: dict[str, Schema]) -> bool:
    """Whether a named type contains itself."""

    def reach(s: Schema, target: str, seen: frozenset[str]) -> bool:
        if s.kind == "ref":
            if s.full_name == target:
                return True
            if s.full_name in seen:
                return False
            return reach(s.resolved(names), target, seen | {s.full_name})
        inner = [f.schema for f in s.fields] + s.branches + ([s.items] if s.items else [])
        return any(reach(i, target, seen) for i in inner)

    return schema.kind == "record" and any(reach(f.schema, schema.full_name, frozenset()) for f in schema.fields)


def nullable_of(schema: Schema) -> Schema | None:
    """T of a union of null and T."""
    if schema.kind == "union" and len(schema.branches) == 2:
        rest = [b for b in schema.branches if b.kind != "null"]
        if len(rest) == 1:
            return rest[0]
    return None


def spark_type(schema: Schema, names: dict[str, Schema]) -> T.DataType:
    schema = schema.resolved(names)
    if inner := nullable_of(schema):
        return spark_type(inner, names)
    if schema.kind == "union":
        members = [T.StructField(f"member{k}", spark_type(b, names), True, facts(b, names)) for k, b in enumerate(schema.branches) if b.kind != "null"]
        return T.StructType([T.StructField("branch", T.IntegerType(), True), *members])
    if schema.type == "decimal":
        return T.DecimalType(schema.precision, schema.scale) if schema.precision <= 38 else T.BinaryType()
    if schema.type == "duration":
        return T.StructType([T.StructField(n, T.LongType()) for n in DURATION])
    if schema.kind == "record":
        if is_recursive(schema, names):
            return T.StringType()
        return T.StructType([T.StructField(f.name, spark_type(f.schema, names), True, facts(f.schema, names)) for f in schema.fields])
    if schema.kind == "array":
        return T.ArrayType(spark_type(schema.items, names))
    if schema.kind == "map":
        return T.MapType(T.StringType(), spark_type(schema.items, names))
    return _SPARK[schema.type]


def facts(schema: Schema, names: dict[str, Schema]) -> dict:
    """Metadata of a field: what the Spark type does not tell."""
    schema = schema.resolved(names)
    inner = (nullable_of(schema) or schema).resolved(names)
    out: dict = {"avro.type": inner.type}
    if inner.full_name:
        out["avro.name"] = inner.full_name
    if inner.kind == "enum":
        out["avro.symbols"] = inner.symbols
    elif inner.kind == "fixed":
        out["avro.size"] = inner.size
    elif inner.kind == "union":
        out["avro.branches"] = [b.full_name or b.type for b in inner.branches]
    elif inner.kind == "record" and is_recursive(inner, names):
        out["avro.recursive"] = True
    return out


def bare(kind: T.DataType) -> T.DataType:
    """The type without metadata, as results of Python functions must have it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, bare(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(bare(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, bare(kind.valueType), kind.valueContainsNull)
    return kind


def struct_of(schema: Schema) -> T.StructType:
    """Columns of a file: a record's fields, or one column named value."""
    top = schema.resolved(schema.names)
    if top.kind == "record" and not is_recursive(top, schema.names):
        return spark_type(top, schema.names)
    return T.StructType([T.StructField("value", spark_type(top, schema.names), True, facts(top, schema.names))])


def arrow_type(schema: Schema, names: dict[str, Schema]) -> pa.DataType:
    return _arrow_of(spark_type(schema, names), schema, names)


def _arrow_of(kind: T.DataType, schema: Schema, names: dict[str, Schema]) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow_of(f.dataType, schema, names)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", _arrow_of(kind.elementType, schema, names)))
    if isinstance(kind, T.MapType):
        return pa.map_(pa.string(), pa.field("value", _arrow_of(kind.valueType, schema, names)))
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    return next(_ARROW[k] for k, v in _SPARK.items() if v == kind)


def avro_schema(struct: T.StructType, name: str = "topLevelRecord", namespace: str = "") -> Schema:
    """The Avro schema of Spark columns, for writing; metadata that facts() made is honoured."""

    def of(kind: T.DataType, path: str, meta: dict) -> object:
        said = meta.get("avro.type")
        if isinstance(kind, T.StructType):
            return {"type": "record", "name": path, "fields": fields(kind, path)}
        if isinstance(kind, T.ArrayType):
            inner = of(kind.elementType, path + "_item", {})
            return {"type": "array", "items": ["null", inner] if kind.containsNull else inner}
        if isinstance(kind, T.MapType):
            inner = of(kind.valueType, path + "_value", {})
            return {"type": "map", "values": ["null", inner] if kind.valueContainsNull else inner}
        if isinstance(kind, T.StringType):
            if said == "enum":
                return {"type": "enum", "name": path, "symbols": meta["avro.symbols"]}
            return {"type": "string", "logicalType": "uuid"} if said == "uuid" else "string"
        if isinstance(kind, T.BinaryType):
            return {"type": "fixed", "name": path, "size": meta["avro.size"]} if said == "fixed" else "bytes"
        if isinstance(kind, T.DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
        if isinstance(kind, T.TimeType):
            return {"type": "long", "logicalType": "time-micros"}
        simple = {
            T.NullType: "null",
            T.BooleanType: "boolean",
            T.ByteType: "int",
            T.ShortType: "int",
            T.IntegerType: "int",
            T.LongType: "long",
            T.FloatType: "float",
            T.DoubleType: "double",
            T.DateType: {"type": "int", "logicalType": "date"},
            T.TimestampType: {"type": "long", "logicalType": "timestamp-micros"},
            T.TimestampNTZType: {"type": "long", "logicalType": "local-timestamp-micros"},
        }
        if type(kind) not in simple:
            raise AvroError(f"{path}: {kind.simpleString()} has no Avro type")
        return simple[type(kind)]

    def fields(struct: T.StructType, path: str) -> list:
        out = []
        for f in struct.fields:
            inner = of(f.dataType, f"{path}_{f.name}", f.metadata or {})
            out.append({"name": f.name, "type": ["null", inner] if f.nullable and inner != "null" else inner})
        return out

    raw: dict = {"type": "record", "name": name, "fields": fields(struct, name)}
    if namespace:
        raw["namespace"] = namespace
    return Schema.parse(json.dumps(raw))
