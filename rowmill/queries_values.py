"""Registered queries over schemas, paths, values and images, with their SQL."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions import datum, paths, values
from rowmill.operators import images
from rowmill.registry import as_ocf, query, table
from rowmill.schema import Schema, can_read, mutual_read
from rowmill.sources.container import PushReader, read_batches
from rowmill.sources.ocf import read_ocf
from rowmill.types import avro_schema

# --- schemas -----------------------------------------------------------------------------------------------
_CANON = """'{"name":"shop.P' || p_partkey || '","type":"record","fields":[{"name":"size","type":"int"},{"name":"tags","type":{"type":"array","items":"string"}}]}'"""


@query(f"SELECT p_partkey, {_CANON} AS canonical, md5({_CANON}) AS md5, sha256({_CANON}) AS sha256, true AS again FROM part")
def schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema of its own for each part, written with a namespace, documentation and defaults, which the canonical form leaves out."""
    head, tail = '{"doc":"a part","namespace":"shop","type":"record","name":"P', '","aliases":["Q"],"fields":[{"type":"int","name":"size","default":3},{"name":"tags","doc":"x","type":{"items":{"type":"string"},"type":"array"}}]}'
    js = F.concat(F.lit(head), F.col("p_partkey").cast("string"), F.lit(tail))
    df = table(spark, sf_dir, "part").select("p_partkey", js.alias("js")).withColumn("canonical", datum.schema_canonical(F.col("js")))
    same = datum.schema_rabin(F.col("canonical")) == datum.schema_rabin(F.col("js"))
    return df.select("p_partkey", "canonical", datum.schema_md5(F.col("js")).alias("md5"), datum.schema_sha256(F.col("js")).alias("sha256"), same.alias("again"))


_KINDS = ["null", "boolean", "int", "long", "float", "double", "bytes", "string"]


@query(
    """WITH k AS (SELECT unnest(['null', 'boolean', 'int', 'long', 'float', 'double', 'bytes', 'string']) AS t), ok AS (SELECT a.t AS writer, b.t AS reader, a.t = b.t OR (a.t = 'int' AND b.t IN ('long', 'float', 'double'))
OR (a.t = 'long' AND b.t IN ('float', 'double')) OR (a.t = 'float' AND b.t = 'double') OR (a.t = 'string' AND b.t = 'bytes') OR (a.t = 'bytes' AND b.t = 'string') AS forward FROM k a CROSS JOIN k b)
SELECT x.writer, x.reader, x.forward, x.forward AND y.forward AS mutual FROM ok x JOIN ok y ON x.writer = y.reader AND x.reader = y.writer"""
)
def schema_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all pairs of primitive types read each other, and both ways, as items of an array in a record."""
    s = lambda t: Schema.parse(json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": {"type": "array", "items": t}}]}))
    rows = [(w, r, can_read(s(r), s(w)) is None, mutual_read(s(r), s(w)) is None) for w in _KINDS for r in _KINDS]
    return spark.createDataFrame(rows, "writer string, reader string, forward boolean, mutual boolean")


# --- bytes that are no text, and hostile ones --------------------------------------------------------------
@query("SELECT n_nationkey, 'FFFE' || hex(encode(n_name)) AS kept FROM nation")
def text_that_is_no_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes read as a string keep every byte, UTF-8 or not."""
    writer = {"type": "record", "name": "n", "fields": [{"name": "n_nationkey", "type": "int"}, {"name": "raw", "type": "bytes"}]}
    reader = {"type": "record", "name": "n", "fields": [{"name": "n_nationkey", "type": "int"}, {"name": "raw", "type": "string"}]}
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), F.concat(F.unhex(F.lit("FFFE")), F.col("n_name").cast("binary")).alias("raw"))
    r = read_ocf(spark, as_ocf(spark, df, "raw", schema=json.dumps(writer)), reader_schema=json.dumps(reader))
    return r.select("n_nationkey", F.hex(F.col("raw").cast("binary")).alias("kept"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name END AS name, p_partkey % 4 = 0 AS good FROM part")
def datum_hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cut short, with bytes left over, or with a length beyond the data are refused, row by row."""
    schema = '{"type":"record","name":"p","fields":[{"name":"p_partkey","type":"long"},{"name":"p_name","type":"string"}]}'
    data = datum.avro_encode(F.struct("p_partkey", "p_name"), schema)
    broken = [F.col("d"), F.expr("substring(d, 1, length(d) - 1)"), F.concat("d", F.unhex(F.lit("00"))), F.concat(F.unhex(F.lit("02FEFFFFFF0F")), "d")]
    df = table(spark, sf_dir, "part").select("p_partkey", data.alias("d"))
    k = F.col("p_partkey") % 4
    df = df.select("p_partkey", F.when(k == 0, broken[0]).when(k == 1, broken[1]).when(k == 2, broken[2]).otherwise(broken[3]).alias("d"))
    v = df.select("p_partkey", datum.avro_decode(F.col("d"), schema, permissive=True).alias("v"))
    return v.select("p_partkey", F.col("v.p_name").alias("name"), F.col("v").isNotNull().alias("good"))


@query("SELECT c_custkey, CASE WHEN length(c_name) + length(c_custkey::VARCHAR) * 0 < 19 THEN c_name END AS name FROM customer")
def datum_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of more bytes than allowed is refused: one byte of length and those of the name."""
    value = datum.avro_encode(F.col("c_name"), '"string"')
    return table(spark, sf_dir, "customer").select("c_custkey", datum.avro_decode(value, '"string"', max_value_bytes=19, permissive=True).alias("name"))


# --- files as bytes, pushed in pieces ----------------------------------------------------------------------
@query("SELECT count(*) AS n, sum(s_suppkey)::BIGINT AS keys, round(sum(s_acctbal), 2) AS balance FROM supplier")
def push_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container files fed to a reader in pieces of 97 bytes."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for rows in read_batches(io.BytesIO(data), 97, columns=["s_suppkey", "s_acctbal"]):
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(rows.columns, (pa.int64(), pa.float64()))], names=["k", "b"])

    path = as_ocf(spark, table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "push", blockRows=7)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").load(path).select("content")
    return files.mapInArrow(run, "k long, b double").agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.round(F.sum("b"), 2).alias("balance"))


@query("SELECT count(*) AS n, true AS waits, true AS ended, 's_suppkey' AS first_field FROM supplier")
def push_reader_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader says of itself: nothing ready before the header, the writer's schema, the end."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                r = PushReader()
                waits = not r.next_ready() and not r.header_ready and not r.at_end
                r.feed(data)
                r.close_input()
                n = 0
                while r.next_ready():
                    r.next_value()
                    n += 1
                yield pa.RecordBatch.from_pylist([{"n": n, "waits": waits, "ended": r.at_end and not r.has_failed, "first_field": r.writer_schema().fields[0].name}])

    path = as_ocf(spark, table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "state")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").load(path).select("content")
    return files.mapInArrow(run, "n long, waits boolean, ended boolean, first_field string").groupBy("first_field").agg(F.sum("n").alias("n"), F.every("waits").alias("waits"), F.every("ended").alias("ended"))


# --- paths -------------------------------------------------------------------------------------------------
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record with every kind of leaf, an array of records, a map and a union, as read from container files."""
    leaf = F.struct(
        (F.col("p_size") > 25).alias("large"), F.col("p_size").cast("int").alias("size"), F.col("p_partkey").alias("key"), F.col("p_size").cast("float").alias("f"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name"), F.col("p_name").cast("binary").alias("raw")
    )
    even = F.col("p_partkey") % 2 == 0
    either = F.struct(F.when(even, 0).otherwise(1).alias("branch"), F.when(even, F.struct(F.col("p_size").cast("int").alias("x"))).alias("member0"), F.when(~even, F.struct((F.col("p_size") + 100).cast("int").alias("x"))).alias("member1"))
    whole = F.struct(leaf.alias("leaf"), F.array(leaf, leaf).alias("list"), F.create_map(F.lit("a b"), F.col("p_partkey"), F.lit("none"), F.lit(None).cast("bigint")).alias("m"), either.alias("either"), F.when(even, F.col("p_name")).alias("maybe"))
    leaf_type = {"type": "record", "name": "leaf", "fields": [{"name": n, "type": t} for n, t in (("large", "boolean"), ("size", "int"), ("key", "long"), ("f", "float"), ("price", "double"), ("name", "string"), ("raw", "bytes"))]}
    branch = lambda n: {"type": "record", "name": n, "fields": [{"name": "x", "type": "int"}]}
    fields = [{"name": "leaf", "type": leaf_type}, {"name": "list", "type": {"type": "array", "items": "leaf"}}, {"name": "m", "type": {"type": "map", "values": ["null", "long"]}}, {"name": "either", "type": [branch("one"), branch("two")]}, {"name": "maybe", "type": ["null", "string"]}]
    schema = {"type": "record", "name": "t", "fields": [{"name": "p_partkey", "type": "long"}, {"name": "r", "type": {"type": "record", "name": "whole", "fields": fields}}]}
    return read_ocf(spark, as_ocf(spark, table(spark, sf_dir, "part").select("p_partkey", whole.alias("r")), "leaves", schema=json.dumps(schema)))


@query("SELECT p_partkey, p_size > 25 AS large, p_size::INT AS size, p_partkey AS key, p_size::FLOAT AS f, p_retailprice AS price, p_name AS name, hex(encode(p_name)) AS raw, p_name AS second FROM part")
def path_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    r = paths.PathReader(df.schema, "r")
    kinds = [("large", "boolean"), ("size", "int"), ("key", "long"), ("f", "float"), ("price", "double"), ("name", "string"), ("raw", "bytes")]
    return df.select("p_partkey", *((F.hex(r.get(f"leaf.{n}", k)) if k == "bytes" else r.get(f"leaf.{n}", k)).alias(n) for n, k in kinds), r.get("list[1].name", "string").alias("second"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 100 END::INT AS x, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 100 END::INT AS same, p_partkey AS by_key, NULL::BIGINT AS nothing, p_partkey AS whole FROM part")
def path_unions_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a union whichever branch it holds, through map keys, and past what is missing where that is allowed."""
    df = _nested(spark, sf_dir)
    r, loose = paths.PathReader(df.schema, "r"), paths.PathReader(df.schema, "r", strict=False)
    return df.select("p_partkey", r.get("either.x", "int").alias("x"), r.value("either.x").alias("same"), r.get('m["a b"]', "long").alias("by_key"), loose.get('m["zz"]', "long").alias("nothing"), r.value('m["a b"]').alias("whole"))


@query("SELECT p_partkey, p_partkey % 2 = 1 AS no_name, true AS no_value, false AS no_leaf, 2 AS n_map, 2 AS n_list, 7 AS n_fields, 'a b;none' AS keys, 'large,size,key,f,price,name,raw' AS names, 'string' AS kind FROM part")
def path_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    r = paths.PathReader(df.schema, "r")
    return df.select(
        "p_partkey",
        r.is_null("maybe").alias("no_name"),
        r.is_null('m["none"]').alias("no_value"),
        r.is_null("leaf").alias("no_leaf"),
        r.map_len("m").alias("n_map"),
        r.array_len("list").alias("n_list"),
        r.record_len("leaf").alias("n_fields"),
        F.concat_ws(";", r.map_keys("m")).alias("keys"),
        F.concat_ws(",", r.record_field_names("leaf")).alias("names"),
        F.lit(r.type_name("leaf.name")).alias("kind"),
    )


@query("SELECT p_partkey, p_name AS a, p_size::INT AS b, p_partkey AS c FROM part")
def path_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths built step by step, and changed at their end."""
    df = _nested(spark, sf_dir)
    r = paths.PathReader(df.schema, "r")
    p = paths.AvroPath().push_field("list").push_index(0).set_last_index(1).push_field("name")
    a = r.get(p, "string")
    b = r.get(p.pop().push_field("size"), "int")
    c = r.get(paths.AvroPath.parse(str(p.clear().push_field("m").push_key("a b"))), "long")
    return df.select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c"))


# --- values ------------------------------------------------------------------------------------------------
@query("SELECT p_partkey, 'b' AS symbol, hex(encode('xyz')) AS fixed, 1 AS branch, p_size::INT AS member, CAST('-1.50' AS DECIMAL(9,2))::VARCHAR AS dec, '00112233-4455-6677-8899-aabbccddeeff' AS id, (DATE '1970-01-01' + p_size::INT)::VARCHAR AS day, TIMESTAMP '1970-01-01 00:00:00.001' AS at, 3::BIGINT AS months FROM part")
def value_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = values.create_union(1, ["string", "int"], F.col("p_size"))
    df = table(spark, sf_dir, "part").select(
        "p_partkey",
        values.create_enum(["a", "b"], 1).alias("symbol"),
        F.hex(values.create_fixed(b"xyz", 3)).alias("fixed"),
        values.union_branch(either).alias("branch"),
        values.union_value(either, 1).alias("member"),
        values.create_decimal((-150).to_bytes(2, "big", signed=True), 9, 2).cast("string").alias("dec"),
        values.create_uuid(bytes.fromhex("00112233445566778899aabbccddeeff")).alias("id"),
        values.create_date(F.col("p_size").cast("int")).cast("string").alias("day"),
        values.create_local_timestamp(F.lit(1), "millis").alias("at"),
        values.create_duration(3, 2, 1)["months"].alias("months"),
    )
    return df


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_us(o_orderdate) AS micros, epoch_ms(o_orderdate) AS millis, (o_orderkey % 7)::BIGINT AS months, 2::BIGINT AS days, o_orderkey % 100 AS ms FROM orders")
def logical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical types through container files and back as numbers: dates, timestamps of both units, fixed durations."""
    logical = lambda n, t, k: {"name": n, "type": {"type": t, "logicalType": k}}
    fields = [{"name": "o_orderkey", "type": "long"}, logical("day", "int", "date"), logical("micros", "long", "timestamp-micros"), logical("millis", "long", "timestamp-millis"), {"name": "d", "type": {"type": "fixed", "name": "dur", "size": 12, "logicalType": "duration"}}]
    span = F.struct((F.col("o_orderkey") % 7).cast("bigint").alias("months"), F.lit(2).cast("bigint").alias("days"), (F.col("o_orderkey") % 100).alias("millis"))
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), values.create_timestamp(micros).alias("micros"), values.create_timestamp(F.floor(micros / 1000).cast("bigint"), "millis").alias("millis"), span.alias("d"))
    r = read_ocf(spark, as_ocf(spark, df, "times", schema=json.dumps({"type": "record", "name": "o", "fields": fields})))
    return r.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.unix_micros("micros").alias("micros"), F.unix_millis("millis").alias("millis"), F.col("d.months").alias("months"), F.col("d.days").alias("days"), F.col("d.millis").alias("ms"))


@query("SELECT p_partkey, p_size = 7 AS same, true AS text_and_bytes, true AS nulls, 2::INT AS n_map, true AS has, false AS lacks FROM part")
def value_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = values.create_map(a=F.col("p_size"), b=F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        values.equal(F.struct(F.col("p_size").cast("int").alias("x")), F.struct(F.lit(7).alias("x"))).alias("same"),
        values.equal_bytes(F.col("p_name"), F.col("p_name").cast("binary")).alias("text_and_bytes"),
        values.equal(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("nulls"),
        values.map_length(m).alias("n_map"),
        values.map_has_key(m, "a").alias("has"),
        values.map_has_key(m, "c").alias("lacks"),
    )


@query("SELECT p_partkey, true AS same, p_size % 2 = 0 AS often, false AS never FROM part")
def value_deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in records, arrays and maps against the same bytes; maps with their entries in another order."""
    text, raw = F.col("p_name"), F.col("p_name").cast("binary")
    nested = lambda x, k, flip: F.struct(F.array(F.struct(x.alias("t"), k.alias("k"))).alias("list"), F.create_map(*([F.lit("b"), x, F.lit("a"), x] if flip else [F.lit("a"), x, F.lit("b"), x])).alias("m"))
    size = F.col("p_size").cast("int")
    df = table(spark, sf_dir, "part").select("p_partkey", nested(text, size, False).alias("x"), nested(raw, size, True).alias("y"), nested(raw, (size - size % 2).cast("int"), True).alias("z"))
    deep = lambda a, b: values.equal_deep(F.col(a), df.schema[a].dataType, F.col(b), df.schema[b].dataType)
    none = df.withColumn("none", F.lit(None).cast(df.schema["x"].dataType))
    return none.select("p_partkey", deep("x", "y").alias("same"), deep("x", "z").alias("often"), values.equal_deep(F.col("x"), df.schema["x"].dataType, F.col("none"), df.schema["x"].dataType).alias("never"))


_UNION_READER = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS branch, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE END AS number, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE ['red', 'green', 'blue'][c_custkey % 3 + 1] END AS color, c_custkey AS inner_key FROM customer"


@query(_UNION_READER)
def resolve_unions_enums_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union resolved branch by branch with promotion, an enum with a default for unknown symbols, and aliases inside a nested record."""
    enum = lambda symbols, **more: {"type": "enum", "name": "color", "symbols": symbols, **more}
    inner = lambda **field: {"type": "record", "name": "inner", "fields": [{"type": "long", **field}]}
    record = lambda *fields: {"type": "record", "name": "c", "fields": [{"name": "c_custkey", "type": "long"}, *fields]}
    writer = record({"name": "either", "type": ["long", "string"]}, {"name": "color", "type": enum(["red", "green", "blue"])}, {"name": "deep", "type": inner(name="key")})
    reader = record({"name": "deep", "type": inner(name="inner_key", aliases=["key"])}, {"name": "color", "type": enum(["green", "blue", "other"], default="other")}, {"name": "either", "type": ["double", "string"]})
    even = F.col("c_custkey") % 2 == 0
    either = F.struct(F.when(even, 0).otherwise(1).alias("branch"), F.when(even, F.col("c_custkey")).alias("member0"), F.when(~even, F.col("c_name")).alias("member1"))
    color = F.element_at(F.array(*map(F.lit, ("red", "green", "blue"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    df = table(spark, sf_dir, "customer").select("c_custkey", either.alias("either"), color.alias("color"), F.struct(F.col("c_custkey").alias("key")).alias("deep"))
    r = read_ocf(spark, as_ocf(spark, df, "resolve-deep", schema=json.dumps(writer)), reader_schema=json.dumps(reader))
    return r.select("c_custkey", F.col("either.branch").alias("branch"), F.col("either.member0").alias("number"), F.col("either.member1").alias("name"), "color", F.col("deep.inner_key").alias("inner_key"))


@query("SELECT n_nationkey, true AS same FROM nation")
def schema_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's schema as JSON, parsed back and compared: equal to itself, and not to another."""
    text = avro_schema(table(spark, sf_dir, "nation").schema).to_json()
    same = Schema.parse(text) == Schema.parse(Schema.parse(text).to_json()) and Schema.parse(text) != Schema.parse('"int"')
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lit(same).alias("same"))


# --- images ------------------------------------------------------------------------------------------------
def _images(spark: SparkSession, sf_dir: str, channels: int, deep: bool) -> DataFrame:
    """An image for each part, p_size % 5 + 2 wide and 3 high, with other samples everywhere: the key + 3 row + 5 column + 7 channel, in 256 or 65536 values."""

    def make(batches):
        for batch in batches:
            out = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y, x, c = np.indices((3, size % 5 + 2, channels))
                value = key * (301 if deep else 1) + 3 * y + 5 * x + 7 * c
                out.append(images.encode_png((value % (65536 if deep else 256)).astype(np.uint16 if deep else np.uint8), [("part", str(key))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["p_partkey", "content"])

    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int")).mapInArrow(make, "p_partkey long, content binary")


@query("SELECT p_partkey, (p_size % 5 + 2)::BIGINT AS width, 3::BIGINT AS height, 'Rgb' AS color, 'png' AS format, 8 AS depth, false AS palette, p_partkey::VARCHAR AS note FROM part")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = images.image_info(_images(spark, sf_dir, 3, False), "p_partkey")
    return r.select("p_partkey", "width", "height", "color", "format", F.col("input_bit_depth").alias("depth"), F.col("has_palette").alias("palette"), F.col("text")[0]["text"].alias("note"))


def _pixel_sql(channels: int, factor: int, most: int) -> str:
    return f"""SELECT p_partkey, count(*)::INT AS n, sum((p_partkey * {factor} + 3 * y + 5 * x + 7 * c) % {most})::BIGINT AS total, max(CASE WHEN y = 2 AND x = 1 AND c = {channels - 1} THEN (p_partkey * {factor} + 3 * y + 5 * x + 7 * c) % {most} END)::BIGINT AS one
FROM part, range(0, 3) t(y), range(0, 6) u(x), range(0, {channels}) v(c) WHERE x < p_size % 5 + 2 GROUP BY p_partkey"""


def _pixels(channels: int, deep: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = images.image_samples(_images(spark, sf_dir, channels, deep), "p_partkey")
        place = (2 * F.col("width") + 1) * channels + channels - 1
        return r.select("p_partkey", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("total"), F.get("samples", place.cast("int")).cast("bigint").alias("one"))

    return run


query(_pixel_sql(1, 1, 256), "image_pixels_gray")(_pixels(1, False))
query(_pixel_sql(3, 1, 256), "image_pixels_rgb")(_pixels(3, False))
query(_pixel_sql(4, 301, 65536), "image_pixels_rgba_16")(_pixels(4, True))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS failed, CASE WHEN p_partkey % 3 <> 0 THEN 3::BIGINT END AS height FROM part")
def image_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images cut short have an error and no samples; the others are read."""
    df = _images(spark, sf_dir, 1, False).withColumn("content", F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(content, 1, 40)")).otherwise(F.col("content")))
    return images.image_samples(df, "p_partkey").select("p_partkey", F.col("error").isNotNull().alias("failed"), "height")


@query("SELECT p_partkey, '255,0,0,255' AS clear, '0,255,0,255' AS full_green FROM part")
def image_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels over a red background: a clear one becomes red, an opaque one stays."""
    two = images.encode_png(np.array([[[1, 2, 3, 0], [0, 255, 0, 255]]], np.uint8))
    df = table(spark, sf_dir, "part").select("p_partkey", F.lit(bytearray(two)).alias("content"))
    s = F.transform("samples", lambda x: x.cast("bigint").cast("string"))
    return images.image_samples(df, "p_partkey", background_8=(255, 0, 0, 255), background_16=(0, 0, 0, 0)).select("p_partkey", F.concat_ws(",", F.slice(s, 1, 4)).alias("clear"), F.concat_ws(",", F.slice(s, 5, 4)).alias("full_green"))
