"""Encoders from Arrow columns: one generated function for a record schema and the columns' types.

Flat columns are written out in the function; a column whose type needs more (nested values, unions of several types, decimals) goes
through the encoder of single values.
"""

from __future__ import annotations

import struct
from typing import Any

import pyarrow as pa

from rowmill.errors import AvroError
from rowmill.plans.encode import encoder
from rowmill.schema import Schema
from rowmill.types import nullable_of

_INTEGERS = (pa.int8(), pa.int16(), pa.int32(), pa.int64())


def _number(d: str, value: str) -> list[str]:
    """Source that appends a zigzag varint."""
    return [f"{d}n = ({value} << 1) ^ ({value} >> 63)", f"{d}while n > 127: add(n & 127 | 128); n >>= 7", f"{d}add(n)"]


def _flat(s: Schema, kind: pa.DataType, v: str, d: str, env: dict[str, Any], k: int) -> list[str] | None:
    """Source that appends one value that is not null, or None if the pair of types is not flat."""
    if s.kind in ("int", "long") and (kind in _INTEGERS or pa.types.is_date32(kind) or pa.types.is_timestamp(kind)):
        if pa.types.is_date32(kind) != (s.type == "date") or pa.types.is_timestamp(kind) != ("timestamp" in s.type and "nanos" not in s.type):
            return None
        check = [] if s.kind == "long" or kind != pa.int64() else [f"{d}if not -2147483648 <= {v} <= 2147483647: raise AvroError(f'{{{v}}} is out of the range of int', 'precondition')"]
        return check + _number(d, v)
    if s.kind == "boolean" and pa.types.is_boolean(kind):
        return [f"{d}add({v})"]
    if s.kind in ("float", "double") and pa.types.is_floating(kind):
        return [f"{d}out += pack_{s.kind}({v})"]
    if s.type in ("string", "bytes") and (pa.types.is_string(kind) or pa.types.is_binary(kind)):
        return [f"{d}n = len({v}) << 1", f"{d}while n > 127: add(n & 127 | 128); n >>= 7", f"{d}add(n)", f"{d}out += {v}"]
    if s.kind == "enum" and pa.types.is_string(kind):
        env[f"place{k}"] = {x.encode(): i for i, x in enumerate(s.symbols)}
        return [f"{d}if {v} not in place{k}: raise AvroError(f'{{{v}!r}} is no symbol of {s.full_name}', 'precondition')", f"{d}i = place{k}[{v}]", *_number(d, "i")]
    return None


def _values(s: Schema, column: pa.Array) -> list:
    """A column as plain Python values, times as numbers and text as bytes."""
    kind = column.type
    if pa.types.is_date32(kind):
        return column.view(pa.int32()).to_pylist()
    if pa.types.is_timestamp(kind) and kind.unit == "us":
        out = column.view(pa.int64()).to_pylist()
        return [None if x is None else x // 1000 for x in out] if s.type.endswith("millis") else out
    return (column.view(pa.binary()) if pa.types.is_string(kind) else column).to_pylist()


class ColumnEncoder:
    """encode(batch, first, rows, out) appends so many rows of a batch whose columns are the record's fields, in any order."""

    def __init__(self, schema: Schema, columns: pa.Schema):
        if schema.kind != "record":
            raise AvroError("rows are records", "precondition")
        env: dict[str, Any] = {"AvroError": AvroError, "pack_float": struct.Struct("<f").pack, "pack_double": struct.Struct("<d").pack}
        self.fields: list[tuple[str, Schema]] = []
        body: list[str] = []
        for k, f in enumerate(schema.fields):
            s = f.schema.resolved(schema.names)
            inner = (nullable_of(s) or s).resolved(schema.names)
            at = columns.get_field_index(f.name)
            if at < 0:
                if not f.has_default:
                    raise AvroError(f"no column {f.name}", "precondition")
                record, env[f"skip{k}"] = Schema("record", full_name="x", fields=[f]), bytearray()
                encoder(record, schema.names)(env[f"skip{k}"], {})
                body.append(f"        out += skip{k}")
                continue
            self.fields.append((f.name, inner))
            v = f"v{k}"
            nullable = nullable_of(s) is not None
            source = _flat(inner, columns.field(at).type, v, " " * (12 if nullable else 8), env, k) if s.kind != "union" or nullable else None
            if source is None:
                env[f"enc{k}"] = encoder(s, schema.names, f"$.{f.name}")
                body.append(f"        enc{k}(out, {v})")
            elif nullable:
                null = next(i for i, b in enumerate(s.branches) if b.kind == "null")
                body += [f"        if {v} is None: add({null << 1})", "        else:", f"            add({(1 - null) << 1})", *source]
            else:
                body += [f"        if {v} is None: raise AvroError('$.{f.name}: null', 'precondition')", *source]
        names = [f"v{k}" for k, f in enumerate(schema.fields) if columns.get_field_index(f.name) >= 0]
        loop = f"    for {', '.join(names)}, in zip(*columns):" if names else "    for _ in range(rows):"
        exec(compile("\n".join(["def encode(columns, rows, out):", "    add = out.append", loop, *body, "        pass"]), "<encoder>", "exec"), env)  # noqa: S102  made of checked names and numbers only
        self._encode = env["encode"]

    def columns(self, batch: pa.RecordBatch) -> list[list]:
        return [_values(s, batch.column(batch.schema.get_field_index(n))) for n, s in self.fields]

    def encode(self, columns: list[list], first: int, rows: int, out: bytearray) -> None:
        self._encode([c[first : first + rows] for c in columns], rows, out)
