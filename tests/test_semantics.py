"""Where Spark's meaning and the files' differ from a careless reading: NaN in filters, late files, strict paths, commits, empty rows."""

import io
import os

import pytest
from pyspark.sql import functions as F

from rowmill.errors import AvroError
from rowmill.functions.paths import PathReader
from rowmill.plans.wire import write_long
from rowmill.sources import container
from rowmill.sources.ocf import OcfWriter, Options, OcfStreamReader, read_ocf, write_ocf

NAN = float("nan")


@pytest.mark.parametrize("where", ["x > 20", "x >= 20", "x < 20", "x <= 20", "x = 20", "x = double('NaN')", "x > double('NaN')", "x >= double('NaN')", "x < double('NaN')", "x <= double('NaN')", "x in (1, double('NaN'), 0)", "x is not null", "not x > 20", "f > 20", "s = 'b'", "s in ('a', null)"])
def test_pushed_filters_keep_what_spark_keeps(spark, tmp_path, where):
    rows = [(1.0, 1.0, "a"), (NAN, NAN, "b"), (50.0, 50.0, None), (None, None, "b"), (-0.0, 0.0, "a"), (20.0, 20.0, "")]
    df = spark.createDataFrame(rows, "x double, f float, s string")
    write_ocf(df, str(tmp_path))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read_ocf(spark, str(tmp_path), pushdown="true").where(where).collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(map(str, got)) == sorted(map(str, df.where(where).collect()))


def test_streams_read_files_that_come_late(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(n, name, mtime):
        write_ocf(spark.range(n).coalesce(1), str(tmp_path / "one"))
        os.makedirs(path, exist_ok=True)
        (file,) = [f for f in os.listdir(tmp_path / "one") if f.endswith(".avro")]
        os.rename(tmp_path / "one" / file, f"{path}/{name}.avro")
        os.utime(f"{path}/{name}.avro", (mtime, mtime))

    def run(**options):
        read = spark.readStream.format("ocf")
        for k, v in options.items():
            read = read.option(k, v)
        read.load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    add(3, "m", 2_000_000_000)
    assert run() == 3
    add(5, "z", 1_000_000_000)
    add(7, "a", 2_000_000_000)
    assert run() == 15
    assert run() == 15
    os.remove(f"{path}/m.avro")
    add(2, "n", 1_500_000_000)
    assert run() == 17


def test_stream_offsets(tmp_path, spark):
    for k in range(5):
        write_ocf(spark.range(k + 1).coalesce(1), str(tmp_path / str(k)))
    reader = OcfStreamReader(Options.of({"path": str(tmp_path)}), 2)
    start, sizes = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        sizes.append(len(reader.partitions(start, end)))
        start = end
    assert sizes == [2, 2, 1]
    again = OcfStreamReader(Options.of({"path": str(tmp_path)}), 2)
    assert again.latestOffset() == start
    (gone,) = [p for p in tmp_path.glob("0/*.avro")]
    gone.unlink()
    with pytest.raises(AvroError):
        again.partitions(reader.initialOffset(), start)


def test_strict_paths_fail(spark):
    df = spark.createDataFrame([({"a": 1}, [1])], "m map<string,int>, l array<int>")
    for column, path in (("m", '["b"]'), ("l", "[3]")):
        strict, loose = PathReader(df.schema, column), PathReader(df.schema, column, strict=False)
        for read in (lambda r, p=path: r.value(p), lambda r, p=path: r.get(p, "int")):
            assert df.select(read(loose)).first()[0] is None
            with pytest.raises(Exception, match="nothing at"):
                df.select(read(strict)).collect()


def test_strict_paths_fail_on_a_branch_that_does_not_fit(spark):
    union = "u struct<branch:int,member0:bigint,member1:struct<x:int>>"
    df = spark.createDataFrame([((1, None, (7,)),), (None,)], union)
    assert [r[0] for r in df.select(PathReader(df.schema, "u").get("x", "int")).collect()] == [7, None]
    other = spark.createDataFrame([((0, 5, None),)], union)
    for read in (lambda r: r.get("x", "int"), lambda r: r.value("x")):
        assert other.select(read(PathReader(other.schema, "u", strict=False))).first()[0] is None
        with pytest.raises(Exception, match="does not fit"):
            other.select(read(PathReader(other.schema, "u"))).collect()
    assert other.select(PathReader(other.schema, "u").get("", "long")).first()[0] == 5
    with pytest.raises(Exception, match="does not fit"):
        df.select(PathReader(df.schema, "u").get("", "long")).collect()


def test_overwrite_moves_before_it_deletes(spark, tmp_path, monkeypatch):
    write_ocf(spark.range(10), str(tmp_path))
    assert read_ocf(spark, str(tmp_path)).count() == 10
    write_ocf(spark.range(3).withColumn("id", F.col("id") + 50), str(tmp_path))
    assert sorted(r[0] for r in read_ocf(spark, str(tmp_path)).collect()) == [50, 51, 52]

    class Broken:
        def __init__(self, system):
            self.system = system

        def move(self, a, b):
            raise OSError("disk full")

        def delete_file(self, path):
            raise AssertionError("nothing may be deleted before the moves")

    from rowmill.sources import ocf

    monkeypatch.setattr(ocf, "open_fs", lambda path: (Broken(None), path))
    writer = OcfWriter({"path": str(tmp_path)}, spark.range(1).schema, True)
    with pytest.raises(OSError):
        writer.commit([ocf.Written(f"{tmp_path}/.t", f"{tmp_path}/new.avro", 1)])
    assert read_ocf(spark, str(tmp_path)).count() == 3


def test_blocks_of_rows_without_bytes_are_bounded(tmp_path, spark):
    schema = '{"type":"record","name":"nothing","fields":[]}'
    w = container.Writer(container.Schema.parse(schema), "null", b"m" * 16)
    head = w.finish()
    header = head[: head.index(b"m" * 16) + 16]
    for rows, good in ((1000, True), (1 << 26, False)):
        block = bytearray()
        write_long(block, rows)
        write_long(block, 0)
        data = header + bytes(block) + b"m" * 16
        if good:
            assert sum(1 for _ in container.read_stream(io.BytesIO(data))) == rows
        else:
            with pytest.raises(AvroError, match="claims"):
                list(container.read_stream(io.BytesIO(data)))
