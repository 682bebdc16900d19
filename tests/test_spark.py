"""The source, the functions and the registered queries on a session, with the JVM's Avro library as a second implementation."""

import decimal
import io
import json
import os

import pytest
from conftest import rows_of
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

import rowmill.queries
import rowmill.queries_tables
import rowmill.queries_values  # noqa: F401
from rowmill import registry
from rowmill.errors import AvroError
from rowmill.functions import datum, paths, values
from rowmill.schema import Schema
from rowmill.sources.container import read_stream, to_bytes
from rowmill.sources.ocf import ocf_count, ocf_schema, read_ocf, write_ocf
from rowmill.streaming.windows import stream_ocf

NESTED = Schema.parse(
    '{"type":"record","name":"N","fields":[{"name":"id","type":"long"},{"name":"name","type":"string"},{"name":"items","type":{"type":"array","items":{"type":"record","name":"I","fields":[{"name":"key","type":"string"},{"name":"count","type":"int"}]}}},'
    '{"name":"tags","type":{"type":"map","values":"long"}},{"name":"maybe","type":["null","double"]},{"name":"kind","type":{"type":"enum","name":"K","symbols":["A","B"]}},{"name":"raw","type":{"type":"fixed","name":"X","size":3}}]}'
)
VALUES = [{"id": k * 10**9, "name": "é" * (k % 3), "items": [{"key": f"i{j}", "count": j - 2} for j in range(k % 7)], "tags": {f"t{j}": j for j in range(k % 5)}, "maybe": k / 2 if k % 2 else None, "kind": "AB"[k % 2], "raw": bytes([k % 256] * 3)} for k in range(200)]


def plain(v):
    return {**v, "maybe": (0, None) if v["maybe"] is None else (1, v["maybe"])}


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstandard"])
def test_the_jvm_reads_and_writes_the_same_files(spark, tmp_path, codec):
    jvm = spark.sparkContext._jvm
    ours, theirs = str(tmp_path / "ours.avro"), str(tmp_path / "theirs.avro")
    open(ours, "wb").write(to_bytes(NESTED, VALUES, codec, block_rows=50))
    reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(ours), jvm.org.apache.avro.generic.GenericDatumReader())
    factory = getattr(jvm.org.apache.avro.file.CodecFactory, "fromString")(codec)
    writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter()).setCodec(factory)
    writer.create(reader.getSchema(), jvm.java.io.File(theirs))
    n = 0
    while reader.hasNext():
        row = reader.next()
        if n < 3:
            assert row.get("id") == VALUES[n]["id"] and str(row.get("name")) == VALUES[n]["name"]
        writer.append(row)
        n += 1
    writer.close()
    assert n == len(VALUES)
    with open(theirs, "rb") as f:
        assert list(read_stream(f)) == [plain(v) for v in VALUES]
    got = read_ocf(spark, theirs).orderBy("id").collect()
    assert [r["items"] for r in got[:8]] == [[Row(key=i["key"], count=i["count"]) for i in v["items"]] for v in VALUES[:8]]
    assert [r["tags"] for r in got] == [v["tags"] for v in VALUES]


def test_fingerprints_equal_the_jvms(spark):
    jvm = spark.sparkContext._jvm
    for s in (NESTED, Schema.parse('["null",{"type":"array","items":"int"}]'), Schema.parse('{"type":"record","name":"a","namespace":"b.c","fields":[{"name":"x","type":"bytes","doc":"d"}]}')):
        parsed = jvm.org.apache.avro.Schema.Parser().parse(s.to_json())
        assert jvm.org.apache.avro.SchemaNormalization.toParsingForm(parsed) == s.canonical()
        assert jvm.org.apache.avro.SchemaNormalization.parsingFingerprint64(parsed) == s.rabin()


def test_ranges_give_each_row_once(spark, sf_dir, tmp_path):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").coalesce(1)
    write_ocf(line, str(tmp_path / "t"), blockRows=37)
    for split in (4096, 70_000):
        got = read_ocf(spark, str(tmp_path / "t"), ["l_orderkey", "l_linenumber"], splitBytes=split)
        assert got.count() == line.count() and line.select(got.columns).exceptAll(got).isEmpty()
    assert ocf_count(spark, str(tmp_path / "t")).first()["n"] == line.count()


def test_one_type_narrowed_in_two_ways(spark, tmp_path):
    schema = Schema.parse('{"type":"record","name":"T","fields":[{"name":"a","type":{"type":"record","name":"R","fields":[{"name":"x","type":"int"},{"name":"y","type":"int"}]}},{"name":"b","type":"R"}]}')
    value = {"a": {"x": 1, "y": 2}, "b": {"x": 3, "y": 4}}
    (tmp_path / "t.avro").write_bytes(to_bytes(schema, [value]))
    assert read_ocf(spark, str(tmp_path), ["a.x", "b.y"]).first() == Row(a=Row(x=1), b=Row(y=4))
    df = read_ocf(spark, str(tmp_path)).select(F.struct("a", "b").alias("v"))
    got = df.select(datum.avro_decode(datum.avro_encode(F.col("v"), schema), schema, columns=["a.y", "b.x"]).alias("v")).first()[0]
    assert got == Row(a=Row(y=2), b=Row(x=3))


def test_overwrite_append_and_empty(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.range(10).repartition(3)
    write_ocf(df, at)
    write_ocf(df, at, mode="append")
    assert read_ocf(spark, at).count() == 20
    write_ocf(df, at)
    assert read_ocf(spark, at).count() == 10
    write_ocf(df.limit(0), at)
    assert read_ocf(spark, at).count() == 0 and ocf_schema(at).kind == "record"
    assert not [f for f in os.listdir(at) if f.startswith(".")]
    with pytest.raises(Exception, match="codec"):
        write_ocf(df, at, codec="lzma")


def test_a_corrupt_block_fails_the_query(spark, tmp_path):
    at = tmp_path / "x.avro"
    data = bytearray(to_bytes(NESTED, VALUES, "deflate"))
    data[len(data) // 2] ^= 0xFF
    at.write_bytes(bytes(data))
    with pytest.raises(Exception):
        read_ocf(spark, str(at)).count()


def test_bytes_that_are_no_text(spark, tmp_path):
    at = tmp_path / "x.avro"
    at.write_bytes(to_bytes(Schema.parse('{"type":"record","name":"r","fields":[{"name":"s","type":"string"},{"name":"a","type":{"type":"array","items":"string"}}]}'), [{"s": b"\xff", "a": [b"\xfe", "x"]}, {"s": "ÿ", "a": []}]))
    df = read_ocf(spark, str(at))
    got = [r[0] for r in df.select(F.hex(F.col("s").cast("binary"))).collect()]
    assert got == ["FF", "C3BF"] and df.select("s").distinct().count() == 2
    assert df.select(F.hex(F.col("a")[0].cast("binary"))).first()[0] == "FE" if df.where("size(a) > 0").count() else True
    write_ocf(df.select("s"), str(tmp_path / "again"))
    assert sorted(r[0] for r in read_ocf(spark, str(tmp_path / "again")).select(F.hex(F.col("s").cast("binary"))).collect()) == ["C3BF", "FF"]


def test_files_of_other_schemas_are_resolved_to_the_first(spark, tmp_path):
    one = Schema.parse('{"type":"record","name":"r","fields":[{"name":"a","type":"long"},{"name":"b","type":"string","default":"d"}]}')
    two = Schema.parse('{"type":"record","name":"r","fields":[{"name":"a","type":"int"}]}')
    (tmp_path / "1.avro").write_bytes(to_bytes(one, [{"a": 1, "b": "x"}]))
    (tmp_path / "2.avro").write_bytes(to_bytes(two, [{"a": 2}]))
    assert sorted(map(tuple, read_ocf(spark, str(tmp_path)).collect())) == [(1, "x"), (2, "d")]


def test_pushed_filters_change_nothing(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        write_ocf(line, str(tmp_path / "t"))
        where = "l_quantity > 20 AND l_returnflag IN ('A', 'R') AND l_orderkey <= 900 AND l_shipdate IS NOT NULL"
        assert read_ocf(spark, str(tmp_path / "t"), pushdown="true").where(where).count() == line.where(where).count()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_a_stream_takes_new_files_once(spark, tmp_path):
    at, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write_ocf(spark.range(10), at)
    query = lambda: stream_ocf(spark, at).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query().awaitTermination()
    write_ocf(spark.range(10, 15), at, mode="append")
    query().awaitTermination()
    query().awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(15))


def test_datum_errors_and_nulls(spark):
    s = '{"type":"record","name":"r","fields":[{"name":"a","type":"int"}]}'
    df = spark.createDataFrame([(1,), (None,)], "a int").select(F.when(F.col("a").isNotNull(), F.struct("a")).alias("v"))
    back = df.select(datum.avro_decode(datum.avro_encode(F.col("v"), s), s).alias("v"))
    assert [r[0] for r in back.collect()] == [Row(a=1), None]
    extra = spark.createDataFrame([(b"\x02\x00",)], "d binary").select(datum.avro_decode(F.col("d"), s))
    with pytest.raises(Exception, match="bytes after"):
        extra.collect()
    with pytest.raises(Exception, match="limit"):
        spark.createDataFrame([(b"\x02",)], "d binary").select(datum.avro_decode(F.col("d"), s, max_value_bytes=0)).collect()


def test_logical_types_cross(spark):
    fields = [("d", "int", "date"), ("tm", "int", "time-millis"), ("tu", "long", "time-micros"), ("m", "long", "timestamp-millis"), ("u", "long", "timestamp-micros"), ("n", "long", "timestamp-nanos"), ("lm", "long", "local-timestamp-millis")]
    raw = {"type": "record", "name": "r", "fields": [{"name": n, "type": {"type": t, "logicalType": k}} for n, t, k in fields]}
    raw["fields"] += [{"name": "dec", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}, {"name": "id", "type": {"type": "string", "logicalType": "uuid"}}, {"name": "dur", "type": {"type": "fixed", "name": "Dur", "size": 12, "logicalType": "duration"}}]
    from rowmill.plans.encode import encode_value

    data = encode_value(Schema.parse(json.dumps(raw)), {"d": 20630, "tm": 3_600_000, "tu": 1, "m": 1_753_000_000_000, "u": -1, "n": 5, "lm": 7, "dec": decimal.Decimal("12.34"), "id": "00112233-4455-6677-8899-aabbccddeeff", "dur": (1, 2, 4_000_000_000)})
    v = spark.createDataFrame([(data,)], "b binary").select(datum.avro_decode(F.col("b"), json.dumps(raw)).alias("v")).select("v.*")
    kinds = dict(v.dtypes)
    assert kinds["tm"] == "time(6)" and kinds["m"] == "timestamp" and kinds["lm"] == "timestamp_ntz" and kinds["dec"] == "decimal(9,2)"
    got = v.select(*(F.col(c).cast("string") for c in ("d", "tm", "tu", "m", "u", "n", "lm", "dec", "id")), "dur.millis").first()
    assert list(got) == ["2026-06-26", "01:00:00", "00:00:00.000001", "2025-07-20 08:26:40", "1969-12-31 23:59:59.999999", "5", "1970-01-01 00:00:00.007", "12.34", "00112233-4455-6677-8899-aabbccddeeff", 4_000_000_000]


def test_paths(spark):
    schema = T._parse_datatype_string("struct<items:array<struct<key:string,count:bigint>>,tags:map<string,bigint>,u:struct<branch:int,member0:bigint,member1:string>>")
    df = spark.createDataFrame([({"items": [{"key": "k", "count": 3}], "tags": {"a": 7}, "u": {"branch": 1, "member0": None, "member1": "s"}},)], T.StructType([T.StructField("v", schema)]))
    r, soft = paths.PathReader(df.schema, "v"), paths.PathReader(df.schema, "v", strict=False)
    one = lambda c: df.select(c).first()[0]
    assert one(r.get("items[0].count", "long")) == 3 and one(r.get('tags["a"]', "long")) == 7
    assert one(r.get("u", "string")) == "s" and one(r.get("u", "bytes")) == b"s"
    assert one(r.array_len("items")) == 1 and one(r.map_keys("tags")) == ["a"] and one(r.record_field_names("items[0]")) == ["key", "count"]
    assert one(r.value("u"))["branch"] == 1 and one(r.is_null("u")) is False
    assert one(soft.get("items[5].count", "long")) is None and one(soft.get('tags["z"]', "long")) is None
    for bad in ("items[5].count", 'tags["z"]'):
        with pytest.raises(Exception, match="path"):
            one(r.get(bad, "long"))
    for bad in ("nothing", "items.key", "tags[0]"):
        with pytest.raises(AvroError):
            r.get(bad, "long")
    with pytest.raises(AvroError):
        r.get("items[0].key", "long")
    p = paths.AvroPath.parse('a[3]["x\\"y"].b')
    assert len(p) == 4 and str(paths.AvroPath.parse(str(p))) == str(p)
    assert p.pop().pop().set_last_index(9).steps[-1] == ("index", 9) and p.clear().is_empty


def test_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(values.create_decimal(b"\x04\xd2", 9, 2)) == decimal.Decimal("12.34")
    assert one(values.decimal_bytes(F.lit(decimal.Decimal("12.34")), 2)) == b"\x04\xd2"
    assert one(values.create_time(F.lit(3_600_000), "millis").cast("string")) == "01:00:00"
    assert one(values.create_local_timestamp(F.lit(1_500), "millis").cast("string")) == "1970-01-01 00:00:01.5"
    assert one(values.create_timestamp(F.lit(-1)).cast("string")) == "1969-12-31 23:59:59.999999"
    assert one(values.create_date(F.lit(1)).cast("string")) == "1970-01-02"
    assert one(values.create_uuid(bytes(16))) == "00000000-0000-0000-0000-000000000000"
    assert one(values.create_union(1, ["void", "bigint"], F.lit(5)))["member1"] == 5
    assert one(values.create_duration(1, 2, 3))["days"] == 2
    assert one(values.create_enum(["A", "B"], 1)) == "B" and one(values.enum_position(F.lit("B"), ["A", "B"])) == 1
    assert one(values.map_put(values.create_map(a=F.lit(1)), F.lit("b"), F.lit(2))) == {"a": 1, "b": 2}
    assert one(values.equal_bytes(F.lit("a"), F.lit(b"a"))) is True and one(values.equal(values.create("null"), values.create("null"))) is True
    for bad in (lambda: values.create_fixed(b"ab", 3), lambda: values.create_enum(["A"], 1), lambda: values.create_uuid("x"), lambda: values.create_duration(-1, 0, 0), lambda: values.create("number", 1)):
        with pytest.raises(AvroError):
            bad()
    with pytest.raises(Exception, match="no item"):
        one(values.array_item(F.array(F.lit(1)), 1))
    with pytest.raises(Exception, match="no key"):
        one(values.map_value(values.create_map(a=F.lit(1)), "b"))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_equal_their_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got), "a query without rows shows nothing"
    assert rows_of(got) == rows_of(duck.execute(registry.ORACLE[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_of_any_file_like():
    assert list(read_stream(io.BytesIO(to_bytes(NESTED, VALUES[:3])))) == [plain(v) for v in VALUES[:3]]
