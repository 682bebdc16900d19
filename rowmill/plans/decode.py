"""Decoders compiled from schemas.

A pair of schemas, the writer's and the wanted one, becomes the source of one Python function that walks encoded rows
with all offsets, branches and skips written out, and appends leaves to one list for each leaf column. Lists then become
Arrow arrays at once, so no row or nested value exists as an object. What is not wanted is stepped over; sized blocks of
arrays and maps in one jump.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from dataclasses import dataclass, field
from decimal import Decimal
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa

from rowmill.errors import AvroError
from rowmill.plans.project import check_projection, project_paths
from rowmill.plans.wire import MAX_ITEMS, NUMBER, SHORT, Matchers, read_bytes, read_long, skip_items, skip_numbers
from rowmill.schema import PROMOTIONS, Schema, can_read
from rowmill.types import arrow_type, is_recursive, nullable_of

MAX_DEPTH = 256


@dataclass
class Node:
    """A column under construction: its own list is number `slot`, holding values, validity, or lengths of items."""

    kind: str  # leaf, struct, list, map
    slot: int
    schema: Schema
    children: list[Node] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


# --- single values, for recursive types, JSON and validation -----------------------------------------------
def read_value(schema: Schema, names: dict[str, Schema], buf: bytes, pos: int, depth: int = 0) -> tuple[Any, int]:
    """One value as plain Python data: records and maps as dicts, unions as (branch, value), text that is no UTF-8 as bytes."""
    if depth > MAX_DEPTH:
        raise AvroError(f"values are nested deeper than {MAX_DEPTH}")
    schema = schema.resolved(names)
    kind = schema.kind
    if kind == "null":
        return None, pos
    if kind == "boolean":
        if pos >= len(buf):
            raise AvroError("the data ends within a value", "range")
        if buf[pos] > 1:
            raise AvroError(f"{buf[pos]} is no boolean")
        return buf[pos] == 1, pos + 1
    if kind in ("int", "long"):
        n, pos = read_long(buf, pos)
        if kind == "int" and not -(1 << 31) <= n < 1 << 31:
            raise AvroError(f"{n} is out of the range of int")
        return n, pos
    if kind in ("float", "double"):
        size = 4 if kind == "float" else 8
        if pos + size > len(buf):
            raise AvroError("the data ends within a value", "range")
        return struct.unpack_from("<f" if size == 4 else "<d", buf, pos)[0], pos + size
    if kind in ("bytes", "string"):
        data, pos = read_bytes(buf, pos)
        if kind == "string":
            try:
                return data.decode("utf-8"), pos
            except UnicodeDecodeError:
                return data, pos
        return data, pos
    if kind == "fixed":
        if pos + schema.size > len(buf):
            raise AvroError("the data ends within a value", "range")
        return buf[pos : pos + schema.size], pos + schema.size
    if kind == "enum":
        n, pos = read_long(buf, pos)
        if not 0 <= n < len(schema.symbols):
            raise AvroError(f"{n} is no symbol of {schema.full_name}")
        return schema.symbols[n], pos
    if kind == "union":
        n, pos = read_long(buf, pos)
        if not 0 <= n < len(schema.branches):
            raise AvroError(f"{n} is no branch")
        value, pos = read_value(schema.branches[n], names, buf, pos, depth + 1)
        return (n, value), pos
    if kind == "record":
        out = {}
        for f in schema.fields:
            out[f.name], pos = read_value(f.schema, names, buf, pos, depth + 1)
        return out, pos
    items: list = []
    while True:
        n, pos = read_long(buf, pos)
        if n == 0:
            break
        if n < 0:
            n, (_, pos) = -n, read_long(buf, pos)
        if n + len(items) > MAX_ITEMS:
            raise AvroError(f"{n} items are too many")
        for _ in range(n):
            if kind == "map":
                key, pos = read_bytes(buf, pos)
                try:
                    key = key.decode("utf-8")
                except UnicodeDecodeError:
                    raise AvroError("a map key is no UTF-8") from None
            value, pos = read_value(schema.items, names, buf, pos, depth + 1)
            items.append((key, value) if kind == "map" else value)
    if kind == "array":
        return items, pos
    out = dict(items)
    if len(out) < len(items):
        twice = next(k for i, (k, _) in enumerate(items) if k in {x for x, _ in items[:i]})
        raise AvroError(f"a map has the key {twice!r} twice")
    return out, pos


def json_value(value: Any) -> Any:
    """A value as JSON data: a union is its value, bytes are lists of numbers. Numbers that JSON lacks are an error."""
    if isinstance(value, tuple):
        return json_value(value[1])
    if isinstance(value, bytes):
        return list(value)
    if isinstance(value, dict):
        return {k: json_value(v) for k, v in value.items()}
    if isinstance(value, list):
        return [json_value(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        raise AvroError("JSON has no such number")
    return value


def _recursive_json(schema: Schema, names: dict[str, Schema]):
    def read(buf: bytes, pos: int) -> tuple[bytes, int]:
        value, pos = read_value(schema, names, buf, pos)
        return json.dumps(json_value(value), ensure_ascii=False).encode(), pos

    return read


def _skip_recursive(schema: Schema, names: dict[str, Schema]):
    return lambda buf, pos: read_value(schema, names, buf, pos)[1]


def _uuid(data: bytes) -> str:
    if len(data) == 16:
        return str(uuid.UUID(bytes=data))
    try:
        return str(uuid.UUID(data.decode("utf-8")))
    except ValueError:
        raise AvroError("a uuid is neither 16 bytes nor its text") from None


# --- compilation -------------------------------------------------------------------------------------------
class Compiler:
    def __init__(self, writer: Schema, wanted: Schema):
        self.writer, self.wanted = writer, wanted
        self.lines: list[str] = []
        self.slots = self.vars = 0
        self.env: dict[str, Any] = {"read_long": read_long, "skip_numbers": skip_numbers, "skip_items": skip_items, "AvroError": AvroError, "unpack_f": struct.Struct("<f").unpack_from, "unpack_d": struct.Struct("<d").unpack_from, "uuid_text": _uuid, "dec": Decimal}
        self.used: set[int] = set()

    # columns
    def node(self, s: Schema) -> Node:
        s = s.resolved(self.wanted.names)
        if inner := nullable_of(s):
            return self.node(inner)
        slot = self.slots
        self.slots += 1
        if s.kind == "union":
            out = Node("struct", slot, s)
            branch = Node("leaf", self.slots, Schema("int"))
            self.slots += 1
            out.children, out.names = [branch], ["branch"]
            for k, b in enumerate(s.branches):
                if b.kind != "null":
                    out.children.append(self.node(b))
                    out.names.append(f"member{k}")
            return out
        if s.kind == "record" and not is_recursive(s, self.wanted.names):
            out = Node("struct", slot, s)
            out.children, out.names = [self.node(f.schema) for f in s.fields], [f.name for f in s.fields]
            return out
        if s.kind == "array":
            return Node("list", slot, s, [self.node(s.items)])
        if s.kind == "map":
            key = Node("leaf", self.slots, Schema("string"))
            self.slots += 1
            return Node("map", slot, s, [key, self.node(s.items)])
        if s.logical == "duration":
            return Node("duration", slot, s)
        return Node("leaf", slot, s)

    # source
    def put(self, depth: int, *lines: str) -> None:
        self.lines += ["    " * depth + line for line in lines]

    def fresh(self, stem: str) -> str:
        self.vars += 1
        return f"{stem}{self.vars}"

    def append(self, node: Node) -> str:
        self.used.add(node.slot)
        return f"a{node.slot}"

    def varint(self, d: int, var: str) -> None:
        self.put(d, "b = buf[pos]", "if b < 128:", f"    {var} = (b >> 1) ^ -(b & 1); pos += 1", "elif (c := buf[pos + 1]) < 128:", f"    b = (b & 127) | (c << 7); {var} = (b >> 1) ^ -(b & 1); pos += 2", "else:", f"    {var}, pos = read_long(buf, pos)")

    def length(self, d: int) -> None:
        self.varint(d, "n")
        self.put(d, "end = pos + n", "if n < 0 or end > size: raise AvroError(f'a length of {n} exceeds the data at offset {pos}', 'range')")

    def null(self, d: int, node: Node) -> None:
        """Append a null to a column and, where lists must keep step, to what is in it."""
        if node.kind == "struct":
            self.put(d, f"{self.append(node)}(False)")
            for c in node.children:
                self.null(d, c)
        else:
            self.put(d, f"{self.append(node)}(None)")

    def blocks(self, d: int, body) -> str:
        """The loop over the blocks of an array or map; returns the variable that counts items."""
        total, n, k = self.fresh("t"), self.fresh("n"), self.fresh("k")
        self.put(d, f"{total} = 0", "while True:")
        self.varint(d + 1, n)
        self.put(d + 1, f"if {n} == 0: break", f"if {n} < 0:", f"    {n} = -{n}")
        self.varint(d + 2, "n")
        self.put(d + 1, f"{total} += {n}", f"if {total} > {MAX_ITEMS}: raise AvroError(f'{{{total}}} items are too many')", f"for {k} in range({n}):")
        body(d + 2)
        return total

    def skip(self, d: int, w: Schema) -> None:
        w = w.resolved(self.writer.names)
        kind = w.kind
        if kind == "null":
            self.put(d, "pass")
        elif kind == "boolean":
            self.put(d, "pos += 1")
        elif kind in ("int", "long", "enum"):
            self.put(d, "while buf[pos] > 127: pos += 1", "pos += 1")
        elif kind in ("float", "double", "fixed"):
            self.put(d, f"pos += {4 if kind == 'float' else 8 if kind == 'double' else w.size}")
        elif kind in ("bytes", "string"):
            self.length(d)
            self.put(d, "pos = end")
        elif kind == "record":
            if is_recursive(w, self.writer.names):
                name = self.fresh("skip_")
                self.env[name] = _skip_recursive(w, self.writer.names)
                self.put(d, f"pos = {name}(buf, pos)")
            else:
                self.put(d, "pass")
                for f in w.fields:
                    self.skip(d, f.schema)
        elif kind == "union":
            n = self.fresh("u")
            self.varint(d, n)
            for k, b in enumerate(w.branches):
                self.put(d, f"{'el' * (k > 0)}if {n} == {k}:")
                self.skip(d + 1, b)
            self.put(d, f"else: raise AvroError(f'{{{n}}} is no branch')")
        else:
            n, k = self.fresh("n"), self.fresh("k")
            self.put(d, "while True:")
            self.varint(d + 1, n)
            self.put(d + 1, f"if {n} == 0: break", f"if {n} < 0:")
            self.length(d + 2)
            self.put(d + 2, "pos = end", "continue")
            self.put(d + 1, f"if {n} > {MAX_ITEMS}: raise AvroError(f'{{{n}}} items are too many')")
            numbers = self.numbers(w.items) if kind == "array" else None
            pattern = self.pattern(w.items, kind == "map")
            if self.width(w) == 0:
                self.put(d + 1, "pass")
                return
            if pattern:  # a few items by one match, more by some
                name = self.fresh("items_")
                self.env[name], self.env[f"match_{name}"] = pattern, Matchers(pattern)
                self.put(d + 1, f"m = match_{name}[{n}](buf, pos) if {n} <= 64 else None", "if m is not None:", "    pos = m.end()")
                self.put(d + 2, "if pos < size and buf[pos] == 0:", "    pos += 1; break", "continue")
            if numbers:
                self.put(d + 1, f"pos = skip_numbers(buf, pos, {n} * {numbers})")
                return
            if pattern:
                self.put(d + 1, f"pos, {n} = skip_items({name}, buf, pos, {n})")
            self.put(d + 1, f"for {k} in range({n}):")
            if kind == "map":
                self.length(d + 2)
                self.put(d + 2, "pos = end")
            self.skip(d + 2, w.items)

    def numbers(self, w: Schema) -> int | None:
        """How many numbers a value is, if it is nothing else."""
        w = w.resolved(self.writer.names)
        if w.kind in ("int", "long", "enum"):
            return 1
        if w.kind == "record" and not is_recursive(w, self.writer.names):
            parts = [self.numbers(f.schema) for f in w.fields]
            return sum(parts) if parts and None not in parts else None
        return None

    def pattern(self, w: Schema, keyed: bool = False) -> bytes | None:
        """A pattern of the bytes of most values, if there is one: numbers, short texts, fixed widths, and records and nullable unions of these."""
        if keyed:
            value = self.pattern(w)
            return None if value is None else SHORT + value
        w = w.resolved(self.writer.names)
        kind = w.kind
        if kind in ("int", "long", "enum"):
            return NUMBER
        if kind in ("bytes", "string"):
            return SHORT
        if kind in ("null", "boolean", "float", "double", "fixed"):
            return b".{%d}" % (w.size if kind == "fixed" else {"null": 0, "boolean": 1, "float": 4, "double": 8}[kind])
        if kind == "record" and not is_recursive(w, self.writer.names):
            parts = [self.pattern(f.schema) for f in w.fields]
            return None if None in parts else b"".join(parts)
        if kind == "union" and len(w.branches) <= 8:
            parts = [self.pattern(b) for b in w.branches]
            return None if None in parts else b"(?>" + b"|".join(re.escape(bytes([2 * k])) + p for k, p in enumerate(parts)) + b")"
        return None

    def width(self, w: Schema) -> int:
        """0 if the items of an array take no bytes."""
        if w.kind == "map":
            return 1
        item = w.items.resolved(self.writer.names)
        return 0 if item.kind == "null" or (item.kind == "fixed" and item.size == 0) or (item.kind == "record" and not item.fields) else 1

    def reads(self, w: Schema, r: Schema) -> bool:
        r, w = self.whole(r, self.wanted), self.whole(w, self.writer)
        return can_read(r, w) is None

    @staticmethod
    def whole(s: Schema, root: Schema) -> Schema:
        s = s.resolved(root.names)
        out = Schema(**{k: getattr(s, k) for k in s.__dataclass_fields__})
        out.names = root.names
        return out

    def emit(self, d: int, w: Schema, r: Schema, node: Node) -> None:
        w, r = w.resolved(self.writer.names), r.resolved(self.wanted.names)
        inner = nullable_of(r)
        if w.kind == "union":
            n = self.fresh("u")
            self.varint(d, n)
            for k, b in enumerate(w.branches):
                self.put(d, f"{'el' * (k > 0)}if {n} == {k}:")
                b = b.resolved(self.writer.names)
                if inner is not None:
                    if b.kind == "null":
                        self.null(d + 1, node)
                    else:
                        self.checked(d + 1, b, inner, node)
                elif r.kind == "union":
                    self.into_union(d + 1, b, r, node, k if len(r.branches) == len(w.branches) else None)
                else:
                    self.checked(d + 1, b, r, node)
            self.put(d, f"else: raise AvroError(f'{{{n}}} is no branch')")
            return
        if inner is not None:
            if w.kind == "null":
                self.null(d, node)
            else:
                self.checked(d, w, inner, node)
            return
        if r.kind == "union":
            self.into_union(d, w, r, node, None)
            return
        self.same(d, w, r, node)

    def checked(self, d: int, w: Schema, r: Schema, node: Node) -> None:
        if r.resolved(self.wanted.names).kind == "union" or self.reads(w, r):
            self.emit(d, w, r, node)
        else:
            self.put(d, f"raise AvroError('{w.type} cannot be read as {r.resolved(self.wanted.names).type}')")

    def into_union(self, d: int, w: Schema, r: Schema, node: Node, prefer: int | None) -> None:
        order = ([prefer] if prefer is not None else []) + list(range(len(r.branches)))
        exact = [k for k in order if r.branches[k].resolved(self.wanted.names).kind == w.kind and self.reads(w, r.branches[k])]
        fits = exact or [k for k in order if self.reads(w, r.branches[k])]
        if not fits:
            self.put(d, f"raise AvroError('no branch takes {w.type}')")
            return
        self.put(d, f"{self.append(node)}(True)", f"{self.append(node.children[0])}({fits[0]})")
        for child, name in zip(node.children[1:], node.names[1:]):
            if name == f"member{fits[0]}":
                self.emit(d, w, r.branches[fits[0]], child)
            else:
                self.null(d, child)

    def same(self, d: int, w: Schema, r: Schema, node: Node) -> None:
        kind, add = w.kind, self.append(node)
        if kind != r.kind and kind not in PROMOTIONS.get(r.kind, ()):
            self.put(d, f"raise AvroError('{w.type} cannot be read as {r.type}')")
        elif kind == "null":
            self.put(d, f"{add}(None)")
        elif kind == "boolean":
            self.put(d, "b = buf[pos]; pos += 1", "if b > 1: raise AvroError(f'{b} is no boolean')", f"{add}(b == 1)")
        elif kind in ("int", "long"):
            self.varint(d, "n")
            if kind == "int":
                self.put(d, "if not -2147483648 <= n <= 2147483647: raise AvroError(f'{n} is out of the range of int')")
            scale = {"timestamp-millis": 1000, "local-timestamp-millis": 1000, "time-millis": 1_000_000, "time-micros": 1000}.get(r.type, 1)
            self.put(d, f"{add}({'float(n)' if r.kind in ('float', 'double') else f'n * {scale}' if scale > 1 else 'n'})")
        elif kind in ("float", "double"):
            self.put(d, f"{add}(unpack_{kind[0]}(buf, pos)[0]); pos += {4 if kind == 'float' else 8}")
        elif kind in ("bytes", "string", "fixed"):
            if kind == "fixed":
                self.put(d, f"end = pos + {w.size}", "if end > size: raise AvroError('the data ends within a value', 'range')")
            else:
                self.length(d)
            if r.type == "uuid":
                self.put(d, f"{add}(uuid_text(buf[pos:end]))")
            elif r.type == "decimal" and r.precision <= 38:
                self.put(d, f"{add}(dec(int.from_bytes(buf[pos:end], 'big', signed=True)).scaleb({-r.scale}))")
            elif r.type == "duration":
                self.put(d, f"{add}(buf[pos:end])")
            else:
                self.put(d, f"{add}(buf[pos:end])")
            self.put(d, "pos = end")
        elif kind == "enum":
            table = self.fresh("e")
            self.env[table] = [s if s in r.symbols else r.default for s in w.symbols]
            self.varint(d, "n")
            self.put(d, f"if not 0 <= n < {len(w.symbols)}: raise AvroError(f'{{n}} is no symbol of {w.full_name}')", f"n = {table}[n]", f"if n is None: raise AvroError('the reader lacks a symbol of {w.full_name}')", f"{add}(n.encode())")
        elif kind == "array":
            self.put(d, f"{add}({self.blocks(d, lambda d: self.emit(d, w.items, r.items, node.children[0]))})")
        elif kind == "map":
            seen = self.fresh("s")

            def entry(d: int) -> None:
                self.length(d)
                self.put(d, "key = buf[pos:end]; pos = end", "if not key.isascii(): key.decode()", f"if key in {seen}: raise AvroError(f'a map has the key {{key.decode()!r}} twice')", f"{seen}.add(key)", f"{self.append(node.children[0])}(key)")
                self.emit(d, w.items, r.items, node.children[1])

            self.put(d, f"{seen} = set()")
            self.put(d, f"{add}({self.blocks(d, entry)})")
        elif is_recursive(w, self.writer.names):
            name = self.fresh("read_")
            self.env[name] = _recursive_json(w, self.writer.names)
            self.put(d, f"n, pos = {name}(buf, pos)", f"{add}(n)")
        else:
            self.put(d, f"{add}(True)")
            mine = {n: (f, c) for f, c in zip(r.fields, node.children) for n in reversed((f.name, *f.aliases))}
            exact = {f.name for f in r.fields}
            done = set()
            for f in w.fields:
                hit = mine.get(f.name)
                if hit is None or hit[0].name in done or (f.name not in exact and hit[0].name in {x.name for x in w.fields}):
                    self.skip(d, f.schema)
                else:
                    done.add(hit[0].name)
                    self.emit(d, f.schema, hit[0].schema, hit[1])
            for f, c in zip(r.fields, node.children):
                if f.name not in done:
                    if not f.has_default:
                        self.put(d, f"raise AvroError('the writer lacks {f.name} and it has no default')")
                    else:
                        self.default(d, f.schema, f.default, c)

    def default(self, d: int, r: Schema, value: Any, node: Node) -> None:
        """Append a default from JSON; a union's default is of its first branch that takes it."""
        r = r.resolved(self.wanted.names)
        if inner := nullable_of(r):
            if value is None:
                self.null(d, node)
            else:
                self.default(d, inner, value, node)
            return
        add = self.append(node)
        if r.kind == "union":
            self.put(d, f"{add}(True)", f"{self.append(node.children[0])}(0)")
            for child, name in zip(node.children[1:], node.names[1:]):
                if name == "member0":
                    self.default(d, r.branches[0], value, child)
                else:
                    self.null(d, child)
        elif node.kind == "struct":
            self.put(d, f"{add}(True)")
            for f, c in zip(r.fields, node.children):
                self.default(d, f.schema, value[f.name] if f.name in value else f.default, c)
        elif r.kind == "array":
            for v in value:
                self.default(d, r.items, v, node.children[0])
            self.put(d, f"{add}({len(value)})")
        elif r.kind == "map":
            for k, v in value.items():
                self.put(d, f"{self.append(node.children[0])}({k.encode()!r})")
                self.default(d, r.items, v, node.children[1])
            self.put(d, f"{add}({len(value)})")
        else:
            if r.kind in ("bytes", "fixed"):
                value = value.encode("iso-8859-1")
            elif r.kind in ("string", "enum"):
                value = value.encode()
            elif r.kind in ("float", "double"):
                value = float(value)
            if r.type == "decimal" and r.precision <= 38:
                value = Decimal(int.from_bytes(value, "big", signed=True)).scaleb(-r.scale)
            elif r.type == "uuid":
                value = _uuid(value)
            elif r.kind in ("int", "long"):
                value *= {"timestamp-millis": 1000, "local-timestamp-millis": 1000, "time-millis": 1_000_000, "time-micros": 1000}.get(r.type, 1)
            name = self.fresh("d")
            self.env[name] = value
            self.put(d, f"{add}({name})")

    def compile(self):
        root = self.node(self.wanted)
        self.put(2, "pass")
        self.emit(2, self.writer, self.wanted, root)
        body = self.lines
        head = ["def decode(buf, pos, rows, lists):", "    size = len(buf)", *(f"    a{k} = lists[{k}].append" for k in sorted(self.used)), "    for _ in range(rows):"]
        source = "\n".join([*head, *body, "    return pos"])
        exec(compile(source, "<decoder>", "exec"), self.env)  # noqa: S102  the source is made of checked names and numbers only
        return root, self.env["decode"], source


class Decoder:
    """Decodes rows of one writer schema into Arrow columns of a wanted schema."""

    def __init__(self, writer: Schema, wanted: Schema | None = None):
        self.writer, self.wanted = writer, wanted or writer
        compiler = Compiler(self.writer, self.wanted)
        self.root, self._decode, self.source = compiler.compile()
        self.slots = compiler.slots
        self.flat = self.root.kind == "struct" and self.root.schema.kind == "record"
        self.type = arrow_type(self.wanted, self.wanted.names)

    def lists(self) -> list[list]:
        return [[] for _ in range(self.slots)]

    def run(self, buf: bytes, pos: int, rows: int, lists: list[list]) -> int:
        """Append so many rows from the buffer; returns the position after them."""
        try:
            pos = self._decode(buf, pos, rows, lists)
        except (IndexError, struct.error):
            raise AvroError("the data ends within a value", "range") from None
        except UnicodeDecodeError:
            raise AvroError("a map key is no UTF-8") from None
        if pos > len(buf):
            raise AvroError("the data ends within a value", "range")
        return pos

    def array(self, lists: list[list]) -> pa.Array:
        return _assemble(self.root, self.type, lists)

    def batch(self, lists: list[list]) -> pa.RecordBatch:
        """A record's fields as columns; any other value as one column."""
        out = self.array(lists)
        if self.flat:
            if not out.type.num_fields:
                return pa.RecordBatch.from_struct_array(out)
            return pa.RecordBatch.from_arrays([out.field(k) for k in range(out.type.num_fields)], schema=pa.schema(list(out.type)))
        return pa.RecordBatch.from_arrays([out], names=["value"])


def _assemble(node: Node, kind: pa.DataType, lists: list[list]) -> pa.Array:
    own = lists[node.slot]
    if node.kind == "struct":
        children = [_assemble(c, kind.field(k).type, lists) for k, c in enumerate(node.children)]
        valid = np.fromiter(own, bool, len(own))
        if not children:
            return pa.array([{} if v else None for v in own], kind)
        return pa.StructArray.from_arrays(children, fields=list(kind), mask=None if valid.all() else pa.array(~valid))
    if node.kind == "duration":
        parts = [None if v is None else dict(zip(("months", "days", "millis"), struct.unpack("<III", v))) for v in own]
        return pa.array(parts, kind)
    if node.kind in ("list", "map"):
        none = [n is None for n in own] if None in own else None
        sizes = np.array([n or 0 for n in own] if none else own, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if ends[-1] >= 1 << 31:
            raise AvroError("a batch has too many items", "range")
        offsets = pa.array(ends.astype(np.int32), mask=np.array([*none, False])) if none else pa.array(ends.astype(np.int32))
        if node.kind == "list":
            return pa.ListArray.from_arrays(offsets, _assemble(node.children[0], kind.value_type, lists), type=kind)
        return pa.MapArray.from_arrays(offsets, _assemble(node.children[0], pa.string(), lists), _assemble(node.children[1], kind.item_type, lists), type=kind)
    if pa.types.is_string(kind):
        wire = pa.array([v.encode() if isinstance(v, str) else v for v in own] if node.schema.logical == "uuid" else own, pa.binary())
        return pa.Array.from_buffers(pa.string(), len(wire), wire.buffers(), wire.null_count)  # bytes stay as they are, also where they are no UTF-8
    if pa.types.is_date(kind):
        return pa.array(own, pa.int32()).view(kind)
    if pa.types.is_timestamp(kind) or pa.types.is_time(kind):
        return pa.array(own, pa.int64()).view(kind)
    if pa.types.is_decimal(kind):
        try:
            return pa.array(own, kind)
        except pa.ArrowInvalid as e:
            raise AvroError(f"a decimal does not fit: {e}") from None
    return pa.array(own, kind)


@lru_cache(maxsize=64)
def decoder(writer: str, wanted: str | None = None, projected: bool = False, columns: tuple[str, ...] | None = None) -> Decoder:
    """Compiled once for each worker and pair of schemas; columns are dotted paths of a projection."""
    w = Schema.parse(writer)
    if columns is not None:
        return Decoder(w, project_paths(w, list(columns)))
    if wanted is None:
        return Decoder(w)
    r = Schema.parse(wanted)
    return Decoder(w, check_projection(w, r) if projected else r)
