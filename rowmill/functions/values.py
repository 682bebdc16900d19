"""Constructors, getters and edits of values as Catalyst expressions, so that they cost no Python."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.errors import AvroError

# --- constructors ------------------------------------------------------------------------------------------
_LITERALS = {"null": "void", "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "bytes": "binary", "string": "string"}


def create(kind: str, value: object = None) -> Column:
    """A literal of a primitive type."""
    if kind not in _LITERALS:
        raise AvroError(f"{kind!r} is no primitive type")
    return F.lit(value).cast(_LITERALS[kind])


def create_record(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def create_array(*items: Column) -> Column:
    return F.array(*items)


def create_map(**entries: Column) -> Column:
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v)))


def create_enum(symbols: list[str], position: int) -> Column:
    if not 0 <= position < len(symbols):
        raise AvroError(f"{position} is no symbol")
    return F.lit(symbols[position])


def create_fixed(data: bytes, size: int) -> Column:
    if len(data) != size:
        raise AvroError(f"{len(data)} bytes are no fixed of {size}")
    return F.lit(data)


def create_union(branch: int, types: list[str], value: Column) -> Column:
    """The struct that unions are: the branch's number and one nullable member for each branch but null, typed by Spark type names."""
    members = [(value if k == branch else F.lit(None)).cast(t).alias(f"member{k}") for k, t in enumerate(types) if t != "void"]
    return F.struct(F.lit(branch).alias("branch"), *members)


def create_decimal(unscaled: bytes, precision: int, scale: int) -> Column:
    return F.lit(f"{int.from_bytes(unscaled, 'big', signed=True)}e-{scale}").cast(f"decimal({precision},{scale})")


def create_uuid(data: bytes | str) -> Column:
    try:
        return F.lit(str(uuid.UUID(bytes=data) if isinstance(data, bytes) else uuid.UUID(data)))
    except ValueError:
        raise AvroError("a uuid is neither 16 bytes nor its text") from None


def create_date(days: Column) -> Column:
    return F.date_from_unix_date(days)


def create_time(number: Column, unit: str = "micros") -> Column:
    """A time of day from milliseconds or microseconds after midnight; sessions have expressions on times with spark.sql.timeType.enabled."""
    micros = number.cast("bigint") * (1000 if unit == "millis" else 1)
    text = F.concat_ws(":", *(F.lpad(F.floor(micros / d % m).cast("string"), 2, "0") for d, m in ((3_600_000_000, 24), (60_000_000, 60))), F.format_string("%09.6f", (micros % 60_000_000) / 1e6))
    return text.cast(f"time({3 if unit == 'millis' else 6})")


def create_timestamp(number: Column, unit: str = "micros") -> Column:
    return F.timestamp_millis(number) if unit == "millis" else F.timestamp_micros(number)


def create_local_timestamp(number: Column, unit: str = "micros") -> Column:
    """A timestamp without a zone: the same digits everywhere."""
    micros = number.cast("bigint") * (1000 if unit == "millis" else 1)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def create_duration(months: int, days: int, millis: int) -> Column:
    for n in (months, days, millis):
        if not 0 <= n < 1 << 32:
            raise AvroError(f"{n} is no unsigned 32-bit number")
    return F.struct(*(F.lit(n).cast("bigint").alias(k) for k, n in (("months", months), ("days", days), ("millis", millis))))


# --- getters -----------------------------------------------------------------------------------------------
def enum_position(col: Column, symbols: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, symbols)), col).cast("int") - 1


def union_branch(col: Column) -> Column:
    return col["branch"]


def union_value(col: Column, branch: int) -> Column:
    return F.when(col["branch"] == branch, col[f"member{branch}"])


def decimal_bytes(col: Column, scale: int) -> Column:
    """Unscaled number of a decimal, big-endian two's complement in as few bytes as hold it."""
    def run(values: pa.Array) -> pa.Array:
        numbers = [None if v is None else int(v.scaleb(scale)) for v in values.to_pylist()]
        return pa.array([None if n is None else n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True) for n in numbers], pa.binary())

    return F.arrow_udf(run, T.BinaryType())(col)


def array_item(col: Column, index: int, strict: bool = True) -> Column:
    """0-based; beyond the end it fails (strict) or is null."""
    return F.when(F.size(col) <= index, F.raise_error(F.lit(f"no item {index}"))).otherwise(F.get(col, F.lit(index))) if strict else F.get(col, F.lit(index))


def map_keys(col: Column) -> Column:
    return F.array_sort(F.map_keys(col))


def map_value(col: Column, key: str, strict: bool = True) -> Column:
    got = F.try_element_at(col, F.lit(key))
    return F.when(~F.map_contains_key(col, F.lit(key)), F.raise_error(F.lit(f"no key {key}"))).otherwise(got) if strict else got


def map_has_key(col: Column, key: str) -> Column:
    return F.map_contains_key(col, F.lit(key))


def map_length(col: Column) -> Column:
    return F.size(col)


def type_name(col: Column) -> Column:
    """The Spark type's name; of a union, see union_branch."""
    return F.typeof(col)


def is_null(col: Column) -> Column:
    return col.isNull()


# --- edits -------------------------------------------------------------------------------------------------
def record_put(col: Column, name: str, value: Column) -> Column:
    return col.withField(name, value)


def array_push(col: Column, value: Column) -> Column:
    return F.array_append(col, value)


def map_put(col: Column, key: Column, value: Column) -> Column:
    """Sets a key; one that is there is replaced."""
    return F.map_concat(F.map_filter(col, lambda k, _: k != key), F.create_map(key, value))


# --- equality ----------------------------------------------------------------------------------------------
def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def equal_bytes(a: Column, b: Column) -> Column:
    """Text equals its bytes."""
    return a.cast("binary").eqNullSafe(b.cast("binary"))


def _as_bytes(col: Column, kind: T.DataType) -> Column:
    """Text as its bytes at any depth, and maps as entries sorted by key, so that values of both can be compared."""
    if isinstance(kind, T.StringType):
        return col.cast("binary")
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _as_bytes(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*(_as_bytes(col[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        return F.transform(F.array_sort(F.map_keys(col)), lambda k: F.struct(_as_bytes(k, kind.keyType).alias("key"), _as_bytes(F.element_at(col, k), kind.valueType).alias("value")))
    return col


def equal_deep(a: Column, kind_a: T.DataType, b: Column, kind_b: T.DataType) -> Column:
    """Equality at any depth, where text equals its bytes and maps are equal in any order of their entries; the kinds are the columns' types."""
    return _as_bytes(a, kind_a).eqNullSafe(_as_bytes(b, kind_b))


def recursive_to_variant(col: Column) -> Column:
    """Values of recursive types, which are read as JSON text, as variants."""
    return F.parse_json(col)
