"""Paths into nested values, as Catalyst expressions: items[3].count, tags["a"]."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.errors import AvroError

_STEP = re.compile(r"""\.?([A-Za-z_]\w*)|\[(\d+)\]|\[(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')\]""")


@dataclass
class AvroPath:
    """Steps are (kind, value) with kind field, index or key."""

    steps: list[tuple[str, str | int]] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> AvroPath:
        out, at = AvroPath(), 0
        while at < len(text):
            m = _STEP.match(text, at)
            if not m or (at == 0 and text.startswith(".")) or (at and m[1] and text[at] != "."):
                raise AvroError(f"bad path {text!r} at {at}")
            if m[1]:
                out.push_field(m[1])
            elif m[2]:
                out.push_index(int(m[2]))
            else:
                out.push_key(re.sub(r"\\(.)", r"\1", m[3] if m[3] is not None else m[4]))
            at = m.end()
        return out

    def push_field(self, name: str) -> AvroPath:
        self.steps.append(("field", name))
        return self

    def push_index(self, index: int) -> AvroPath:
        if index < 0:
            raise AvroError("an index is negative")
        self.steps.append(("index", index))
        return self

    def push_key(self, key: str) -> AvroPath:
        self.steps.append(("key", key))
        return self

    def pop(self) -> AvroPath:
        if not self.steps:
            raise AvroError("the path is empty", "precondition")
        self.steps.pop()
        return self

    def set_last_index(self, index: int) -> AvroPath:
        if not self.steps or self.steps[-1][0] != "index":
            raise AvroError("the last step is no index", "precondition")
        self.steps[-1] = ("index", index)
        return self

    def clear(self) -> AvroPath:
        self.steps.clear()
        return self

    def __len__(self) -> int:
        return len(self.steps)

    @property
    def is_empty(self) -> bool:
        return not self.steps

    def __str__(self) -> str:
        out = ""
        for kind, value in self.steps:
            out += (f".{value}" if out else str(value)) if kind == "field" else f"[{value}]" if kind == "index" else '["' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"]'
        return out


#: Types that a typed leaf read takes.
LEAVES = {"boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": (T.StringType, T.BinaryType), "bytes": (T.BinaryType, T.StringType)}

#: What a typed leaf read gives.
RESULTS = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}


def _is_union(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and bool(kind.fields) and kind.fields[0].name == "branch" and all(f.name.startswith("member") for f in kind.fields[1:])


Way = tuple[Column, Column, T.DataType]


def _walk(col: Column, kind: T.DataType, path: AvroPath, strict: bool) -> tuple[list[Way], list[Column]]:
    """(condition, value, type) for each way the path can go: one, or one for each union branch that fits the steps; and the conditions of branches that do not."""
    ways, lost = [(F.lit(True), col, kind)], []
    for n, (step, value) in enumerate([*path.steps, ("leaf", "")]):
        flat = []
        for cond, c, k in ways:  # unions are transparent on the way
            if _is_union(k):
                flat += [(cond & (c["branch"] == int(f.name[6:])), c[f.name], f.dataType) for f in k.fields[1:]]
            else:
                flat.append((cond, c, k))
        if step == "leaf":
            return flat, lost
        ways = []
        for cond, c, k in flat:
            failure = F.raise_error(F.lit(f"path {path}: nothing at step {n} ({value})"))
            if step == "field" and isinstance(k, T.StructType) and value in k.names:
                ways.append((cond, c[value], k[value].dataType))
            elif step == "index" and isinstance(k, T.ArrayType):
                got = F.get(c, F.lit(value))
                ways.append((cond, F.when(F.size(c) <= value, failure.cast(k.elementType)).otherwise(got) if strict else got, k.elementType))
            elif step == "key" and isinstance(k, T.MapType):
                got = F.try_element_at(c, F.lit(value))
                ways.append((cond, F.when(~F.map_contains_key(c, F.lit(value)), failure.cast(k.valueType)).otherwise(got) if strict else got, k.valueType))
            else:
                lost.append(cond)
        if not ways:
            raise AvroError(f"path {path}: step {n} ({value}) does not fit the type", "missing")
    return ways, lost


class PathReader:
    """Reads of one column of a DataFrame. Missing steps fail (strict) or give null."""

    def __init__(self, schema: T.StructType, column: str, strict: bool = True):
        self.kind, self.col, self.strict = schema[column].dataType, F.col(column), strict

    def _ways(self, path: str | AvroPath) -> tuple[list[Way], list[Column]]:
        return _walk(self.col, self.kind, path if isinstance(path, AvroPath) else AvroPath.parse(path), self.strict)

    def _choose(self, path: str | AvroPath, good: list[tuple[Column, Column]], lost: list[Column], kind: T.DataType) -> Column:
        """The value of the way that a row goes; in strict mode a row whose union branch does not fit the path fails."""
        if len(good) == 1 and not lost:
            return good[0][1]
        out = None
        for cond, value in good:
            out = F.when(cond, value) if out is None else out.when(cond, value)
        if self.strict:
            for cond in lost:
                out = out.when(cond, F.raise_error(F.lit(f"path {path}: the union's branch does not fit")).cast(kind))
        return out

    def _leaf(self, path: str | AvroPath, fits, make, otherwise: str, result: T.DataType) -> Column:
        ways, lost = self._ways(path)
        good = [(cond, make(c, k)) for cond, c, k in ways if fits(k)]
        if not good:
            raise AvroError(f"path {path}: {ways[0][2].simpleString()} is no {otherwise}", "missing")
        return self._choose(path, good, lost + [cond for cond, _, k in ways if not fits(k)], result)

    def get(self, path: str | AvroPath, kind: str) -> Column:
        """A typed leaf: boolean, int, long, float, double, string or bytes."""
        cast = {"string": "string", "bytes": "binary"}.get(kind)
        return self._leaf(path, lambda k: isinstance(k, LEAVES[kind]), lambda c, k: c.cast(cast) if cast else c, kind, RESULTS[kind])

    def value(self, path: str | AvroPath) -> Column:
        """Whatever stands at the path; a union stays one."""
        p = path if isinstance(path, AvroPath) else AvroPath.parse(path)
        if not p.steps:
            return self.col
        parents, lost = _walk(self.col, self.kind, AvroPath(p.steps[:-1]), self.strict)
        out, kind = [], None
        for cond, c, k in parents:
            step, v = p.steps[-1]
            failure = F.raise_error(F.lit(f"path {p}: nothing at the last step ({v})"))
            if step == "field" and isinstance(k, T.StructType) and not _is_union(k) and v in k.names:
                got, own = c[v], k[v].dataType
            elif step == "index" and isinstance(k, T.ArrayType):
                got, own = F.get(c, F.lit(v)), k.elementType
                got = F.when(F.size(c) <= v, failure.cast(own)).otherwise(got) if self.strict else got
            elif step == "key" and isinstance(k, T.MapType):
                got, own = F.try_element_at(c, F.lit(v)), k.valueType
                got = F.when(~F.map_contains_key(c, F.lit(v)), failure.cast(own)).otherwise(got) if self.strict else got
            else:
                lost.append(cond)
                continue
            if kind is not None and own != kind:
                raise AvroError(f"path {p}: union branches give {kind.simpleString()} and {own.simpleString()}", "missing")
            out, kind = [*out, (cond, got)], own
        if not out:
            raise AvroError(f"path {p}: the last step does not fit the type", "missing")
        return self._choose(p, out, lost, kind)

    def is_null(self, path: str | AvroPath) -> Column:
        return ~F.coalesce(*(F.when(cond & c.isNotNull(), F.lit(True)) for cond, c, _ in self._ways(path)[0]), F.lit(False))

    def type_name(self, path: str | AvroPath) -> str:
        """The type at a path, or the types of a union's branches."""
        return "|".join(k.simpleString() for _, _, k in self._ways(path)[0])

    def array_len(self, path: str | AvroPath) -> Column:
        return self._leaf(path, lambda k: isinstance(k, T.ArrayType), lambda c, k: F.size(c), "array", T.IntegerType())

    def map_len(self, path: str | AvroPath) -> Column:
        return self._leaf(path, lambda k: isinstance(k, T.MapType), lambda c, k: F.size(c), "map", T.IntegerType())

    def map_keys(self, path: str | AvroPath) -> Column:
        return self._leaf(path, lambda k: isinstance(k, T.MapType), lambda c, k: F.array_sort(F.map_keys(c)), "map", T.ArrayType(T.StringType()))

    def record_len(self, path: str | AvroPath) -> Column:
        return self._leaf(path, lambda k: isinstance(k, T.StructType), lambda c, k: F.when(c.isNotNull(), F.lit(len(k.fields))), "record", T.IntegerType())

    def record_field_names(self, path: str | AvroPath) -> Column:
        return self._leaf(path, lambda k: isinstance(k, T.StructType), lambda c, k: F.when(c.isNotNull(), F.array(*map(F.lit, k.names))), "record", T.ArrayType(T.StringType()))


def avro_path(df, column: str, path: str, kind: str, strict: bool = True) -> Column:
    """One typed leaf of a column."""
    return PathReader(df.schema, column, strict).get(path, kind)
