"""Encoders compiled from schemas, and validation of plain values."""

from __future__ import annotations

import datetime as dt
import decimal
import struct
import uuid
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from rowmill.errors import AvroError
from rowmill.plans.wire import write_bytes, write_long
from rowmill.schema import Schema
from rowmill.types import nullable_of

Encode = Callable[[bytearray, Any], None]
#: Arrays and maps of more items than this are written with their size in bytes, so that a projection steps over them in one jump.
SIZED_FROM = 3
_EPOCH = dt.datetime(1970, 1, 1)
_DAY = dt.date(1970, 1, 1)


def _fail(path: str, value: Any, kind: str):
    raise AvroError(f"{path}: {type(value).__name__} is no {kind}", "precondition")


def _number(value: Any, kind: str, path: str, unit: int = 1) -> int:
    """The integer that a date, time or number is on the wire."""
    if isinstance(value, bool):
        _fail(path, value, kind)
    if isinstance(value, int):
        return value
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if isinstance(value, dt.datetime):
        naive = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        return (naive - _EPOCH) // dt.timedelta(microseconds=1) // unit
    if isinstance(value, dt.date):
        return (value - _DAY).days
    if isinstance(value, dt.time):
        return (((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond) // unit
    _fail(path, value, kind)


def encoder(schema: Schema, names: dict[str, Schema], path: str = "$", seen: dict | None = None) -> Encode:
    """A function that appends one value. Records take dicts; unions take a value of a branch, or (branch, value), or the struct that unions decode to."""
    seen = {} if seen is None else seen
    schema = schema.resolved(names)
    kind, logical = schema.kind, schema.type
    if schema.full_name in seen and kind == "record":
        return lambda out, v: seen[schema.full_name](out, v)
    if kind == "null":

        def enc(out, v):
            if v is not None:
                _fail(path, v, "null")
    elif kind == "boolean":

        def enc(out, v):
            if not isinstance(v, bool):
                _fail(path, v, "boolean")
            out.append(v)
    elif kind in ("int", "long"):
        low, high = (-(1 << 31), (1 << 31) - 1) if kind == "int" else (-(1 << 63), (1 << 63) - 1)
        unit = 1000 if logical.endswith("millis") else 1

        def enc(out, v):
            if type(v) is not int:
                v = _number(v, logical, path, unit)
            if not low <= v <= high:
                raise AvroError(f"{path}: {v} is out of the range of {kind}", "precondition")
            write_long(out, v)
    elif kind in ("float", "double"):
        pack = struct.Struct("<f" if kind == "float" else "<d").pack

        def enc(out, v):
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                _fail(path, v, kind)
            out += pack(v)
    elif logical == "decimal":

        def enc(out, v):
            if isinstance(v, decimal.Decimal):
                scaled = v.scaleb(schema.scale, decimal.Context(prec=100))
                if scaled != scaled.to_integral_value():
                    raise AvroError(f"{path}: {v} has more than {schema.scale} decimal places", "precondition")
                n = int(scaled)
                if abs(n) >= 10**schema.precision:
                    raise AvroError(f"{path}: {v} has more than {schema.precision} digits", "precondition")
                size = schema.size if kind == "fixed" else n.bit_length() // 8 + 1
                v = n.to_bytes(size, "big", signed=True)
            if not isinstance(v, (bytes, bytearray)) or (kind == "fixed" and len(v) != schema.size):
                _fail(path, v, logical)
            if kind == "fixed":
                out += v
            else:
                write_bytes(out, v)
    elif logical == "uuid":

        def enc(out, v):
            try:
                u = v if isinstance(v, uuid.UUID) else uuid.UUID(bytes=bytes(v)) if isinstance(v, (bytes, bytearray)) and len(v) == 16 else uuid.UUID(v.decode() if isinstance(v, bytes) else v)
            except (ValueError, AttributeError, TypeError):
                _fail(path, v, "uuid")
            if kind == "fixed":
                out += u.bytes
            else:
                write_bytes(out, str(u).encode() if kind == "string" else u.bytes)
    elif logical == "duration":

        def enc(out, v):
            parts = v if isinstance(v, (tuple, list)) else tuple(v[n] for n in ("months", "days", "millis")) if isinstance(v, dict) else _fail(path, v, "duration")
            try:
                out += struct.pack("<III", *parts)
            except struct.error:
                raise AvroError(f"{path}: a part of a duration is no unsigned 32-bit number", "precondition") from None
    elif kind in ("bytes", "string"):

        def enc(out, v):
            if isinstance(v, str):
                v = v.encode("utf-8", "surrogatepass") if kind == "string" else _fail(path, v, "bytes")
            elif not isinstance(v, (bytes, bytearray)):
                _fail(path, v, kind)
            write_bytes(out, v)
    elif kind == "fixed":

        def enc(out, v):
            if not isinstance(v, (bytes, bytearray)) or len(v) != schema.size:
                _fail(path, v, f"fixed of {schema.size} bytes")
            out += v
    elif kind == "enum":
        place = {s: k for k, s in enumerate(schema.symbols)}

        def enc(out, v):
            if isinstance(v, bytes):
                v = v.decode("utf-8", "replace")
            if v not in place:
                raise AvroError(f"{path}: {v!r} is no symbol of {schema.full_name}", "precondition")
            write_long(out, place[v])
    elif kind == "array":
        item = encoder(schema.items, names, path + "[]", seen)

        def enc(out, v):
            if not isinstance(v, (list, tuple)):
                _fail(path, v, "array")
            if len(v) > SIZED_FROM:
                block = bytearray()
                for x in v:
                    item(block, x)
                write_long(out, -len(v))
                write_bytes(out, block)
            elif v:
                write_long(out, len(v))
                for x in v:
                    item(out, x)
            out.append(0)
    elif kind == "map":
        item = encoder(schema.items, names, path + "{}", seen)

        def enc(out, v):
            pairs = list(v.items()) if isinstance(v, dict) else v
            if not isinstance(pairs, (list, tuple)) or not all(isinstance(p, tuple) and len(p) == 2 for p in pairs):
                _fail(path, v, "map")
            if len({k for k, _ in pairs}) < len(pairs):
                raise AvroError(f"{path}: a map has a key twice")
            if pairs:
                block = bytearray()
                for k, x in sorted(pairs, key=lambda p: p[0]):  # sorted, so that equal maps are equal bytes
                    write_bytes(block, k.encode())
                    item(block, x)
                if len(pairs) > SIZED_FROM:
                    write_long(out, -len(pairs))
                    write_long(out, len(block))
                else:
                    write_long(out, len(pairs))
                out += block
            out.append(0)
    elif kind == "union":
        members = [encoder(b, names, f"{path}<{k}>", seen) for k, b in enumerate(schema.branches)]
        null = next((k for k, b in enumerate(schema.branches) if b.kind == "null"), None)
        single = schema.branches.index(nullable_of(schema)) if nullable_of(schema) else None

        def enc(out, v):
            if v is None and null is not None:
                write_long(out, null)
                return
            if single is not None and not isinstance(v, tuple):
                write_long(out, single)
                members[single](out, v)
                return
            if isinstance(v, tuple) and len(v) == 2 and isinstance(v[0], int) and 0 <= v[0] < len(members):
                write_long(out, v[0])
                members[v[0]](out, v[1])
                return
            if isinstance(v, dict) and isinstance(v.get("branch"), int) and all(k == "branch" or k.startswith("member") for k in v):
                write_long(out, v["branch"])
                members[v["branch"]](out, v.get(f"member{v['branch']}"))
                return
            for k, member in enumerate(members):
                trial = bytearray()
                try:
                    member(trial, v)
                except AvroError:
                    continue
                write_long(out, k)
                out += trial
                return
            raise AvroError(f"{path}: no branch takes {type(v).__name__}", "precondition")
    else:
        parts: list[tuple[str, Encode, Any]] = []

        def enc(out, v):
            if not isinstance(v, dict):
                _fail(path, v, schema.full_name)
            for name, part, missing in parts:
                if name in v:
                    part(out, v[name])
                elif missing is not None:
                    out += missing
                else:
                    raise AvroError(f"{path}: no field {name}", "precondition")

        seen[schema.full_name] = enc
        for f in schema.fields:
            part = encoder(f.schema, names, f"{path}.{f.name}", seen)
            missing = None
            if f.has_default:
                missing = bytearray()
                part(missing, default_value(f.schema, f.default, names))
            parts.append((f.name, part, missing))
    return enc


def default_value(schema: Schema, value: Any, names: dict[str, Schema]) -> Any:
    """A default from JSON as a plain value."""
    schema = schema.resolved(names)
    if schema.kind == "union":
        return (0, default_value(schema.branches[0], value, names)) if schema.branches[0].kind != "null" or value is None else (1, default_value(schema.branches[1], value, names))
    if schema.kind in ("bytes", "fixed"):
        return value.encode("iso-8859-1")
    if schema.kind == "array":
        return [default_value(schema.items, v, names) for v in value]
    if schema.kind == "map":
        return {k: default_value(schema.items, v, names) for k, v in value.items()}
    if schema.kind == "record":
        return {f.name: default_value(f.schema, value[f.name] if f.name in value else f.default, names) for f in schema.fields}
    return value


@lru_cache(maxsize=64)
def compiled(schema: str) -> tuple[Schema, Encode]:
    parsed = Schema.parse(schema)
    return parsed, encoder(parsed, parsed.names)


def encode_value(schema: Schema, value: Any) -> bytes:
    out = bytearray()
    encoder(schema, schema.names)(out, value)
    return bytes(out)


def is_valid(schema: str, value: Any) -> bool:
    try:
        compiled(schema)[1](bytearray(), value)
    except AvroError:
        return False
    return True
