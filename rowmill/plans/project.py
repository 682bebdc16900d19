"""Projections: a subset of a writer's schema, strict in types, at any depth."""

from __future__ import annotations

from rowmill.errors import AvroError
from rowmill.schema import Field, Schema
from rowmill.types import is_recursive


def check_projection(writer: Schema, projection: Schema) -> Schema:
    """The projected schema in the writer's order, or an error that names the place where it is no subset.

    Records may keep fewer fields, also inside arrays, maps and unions; everything else must be as the writer has it:
    names, symbols, sizes, decimals, and all branches of a union. There are no promotions, aliases or defaults.
    """

    def fail(path: str, why: str):
        raise AvroError(f"projection at {path}: {why}")

    def walk(w: Schema, p: Schema, path: str) -> Schema:
        w, p = w.resolved(writer.names), p.resolved(projection.names or writer.names)
        if w.kind != p.kind or w.logical != p.logical:
            fail(path, f"the writer has {w.type}, not {p.type}")
        if w.full_name != p.full_name:
            fail(path, f"the writer's name is {w.full_name}, not {p.full_name}")
        if w.kind == "enum" and w.symbols != p.symbols:
            fail(path, "the symbols differ")
        if w.kind == "fixed" and w.size != p.size:
            fail(path, "the sizes differ")
        if w.logical == "decimal" and (w.precision, w.scale) != (p.precision, p.scale):
            fail(path, "the decimals differ")
        if w.kind == "record":
            if is_recursive(w, writer.names):
                if {f.name for f in w.fields} != {f.name for f in p.fields}:
                    fail(path, "a recursive type cannot be narrowed")
                return w
            wanted = {f.name: f for f in p.fields}
            for name in wanted:
                if name not in {f.name for f in w.fields}:
                    fail(path, f"the writer has no field {name}")
            out = Schema("record", full_name=w.full_name)
            out.fields = [Field(f.name, walk(f.schema, wanted[f.name].schema, f"{path}.{f.name}")) for f in w.fields if f.name in wanted]
            return out
        if w.kind in ("array", "map"):
            return Schema(w.kind, items=walk(w.items, p.items, path + ("[]" if w.kind == "array" else "{}")))
        if w.kind == "union":
            if len(w.branches) != len(p.branches):
                fail(path, "a union cannot be narrowed")
            return Schema("union", branches=[walk(a, b, f"{path}<{k}>") for k, (a, b) in enumerate(zip(w.branches, p.branches))])
        return w

    out = walk(writer, projection, "$")
    out.names = writer.names
    return out


def project_paths(writer: Schema, paths: list[str]) -> Schema:
    """A projection from dotted field paths; arrays, maps and unions on the way are passed through: items.key keeps one field of each item."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def walk(s: Schema, want: dict, path: str) -> Schema:
        s = s.resolved(writer.names)
        if not want:
            return s
        if s.kind == "record":
            lost = [n for n in want if n not in {f.name for f in s.fields}]
            if lost:
                raise AvroError(f"{path} has no field {lost[0]}", "missing")
            out = Schema("record", full_name=s.full_name)
            out.fields = [Field(f.name, walk(f.schema, want[f.name], f"{path}.{f.name}")) for f in s.fields if f.name in want]
            return out
        if s.kind in ("array", "map"):
            return Schema(s.kind, items=walk(s.items, want, path))
        if s.kind == "union":
            return Schema("union", branches=[b if b.resolved(writer.names).kind in ("null",) else walk(b, want, path) for b in s.branches])
        raise AvroError(f"{path} has no fields", "missing")

    out = walk(writer, tree, "$")
    out.names = writer.names
    return out
