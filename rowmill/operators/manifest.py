"""Table manifests as container files: build, plan, measure and prune.

A manifest entry describes one data file: its path, row count, size, and for each column the number of values, nulls and
bytes and the smallest and largest value. A planner needs few of these fields, which is what projection is for.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.sources.ocf import read_ocf, write_ocf

#: Fixed values of the public table-format specification: of each map in an entry its number and those of its keys and values, and the values' type.
MAPS = {
    "column_sizes": (108, 117, 118, "long"),
    "value_counts": (109, 119, 120, "long"),
    "null_value_counts": (110, 121, 122, "long"),
    "nan_value_counts": (137, 138, 139, "long"),
    "lower_bounds": (125, 126, 127, "bytes"),
    "upper_bounds": (128, 129, 130, "bytes"),
}


def manifest_schema(partition: dict[str, str]) -> str:
    """The specification's schema of a manifest's entries (version 2) for a table partitioned by these fields (name and Avro type)."""
    field = lambda name, number, kind, **more: {"name": name, "type": kind, "field-id": number, **more}
    maybe = lambda name, number, kind: field(name, number, ["null", kind], default=None)

    def pairs(key: int, value: int, kind: str) -> dict:
        return {"type": "array", "logicalType": "map", "items": {"type": "record", "name": f"k{key}_v{value}", "fields": [field("key", key, "int"), field("value", value, kind)]}}

    parts = {"type": "record", "name": "r102", "fields": [maybe(n, 1000 + k, t) for k, (n, t) in enumerate(partition.items())]}
    many = lambda number, kind: {"type": "array", "items": kind, "element-id": number}
    file = [field("content", 134, "int"), field("file_path", 100, "string"), field("file_format", 101, "string"), field("partition", 102, parts), field("record_count", 103, "long"), field("file_size_in_bytes", 104, "long")]
    file += [maybe(name, number, pairs(key, value, kind)) for name, (number, key, value, kind) in MAPS.items()]
    file += [maybe("key_metadata", 131, "bytes"), maybe("split_offsets", 132, many(133, "long")), maybe("equality_ids", 135, many(136, "int")), maybe("sort_order_id", 140, "int")]
    entry = [field("status", 0, "int"), maybe("snapshot_id", 1, "long"), maybe("sequence_number", 3, "long"), maybe("file_sequence_number", 4, "long"), field("data_file", 2, {"type": "record", "name": "r2", "fields": file})]
    return json.dumps({"type": "record", "name": "manifest_entry", "fields": entry})


#: What an entry says of its file.
EXISTING, ADDED, DELETED = 0, 1, 2
#: What planning reads.
PLANNED = ["status", "data_file.content", "data_file.file_path", "data_file.record_count", "data_file.file_size_in_bytes"]


def _bytes(c: Column) -> Column:
    """A number not below zero as eight big-endian bytes, so that bytes sort as numbers do."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))


def number(c: Column) -> Column:
    """The number of _bytes()."""
    return F.conv(F.hex(c), 16, 10).cast("bigint")


def build(rows: DataFrame, by: dict[str, Column], measured: dict[int, Column], width: int = 8) -> DataFrame:
    """Entries, one for each group of rows: what a writer of data files partitioned like that would have recorded. Columns are measured in whole numbers."""
    keys = [c.alias(n) for n, c in by.items()]
    agg = [F.count("*").alias("n")]
    for k, c in measured.items():
        agg += [F.count(c).alias(f"c{k}"), F.min(c.cast("bigint")).alias(f"lo{k}"), F.max(c.cast("bigint")).alias(f"hi{k}")]
    g = rows.groupBy(*keys).agg(*agg)
    pairs = lambda of: F.array(*(F.struct(F.lit(k).alias("key"), of(k).alias("value")) for k in measured))
    path = F.concat_ws("/", F.lit("data"), *(F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in by), F.lit("0.parquet"))
    file = F.struct(
        F.lit(0).alias("content"),
        path.alias("file_path"),
        F.lit("PARQUET").alias("file_format"),
        F.struct(*by).alias("partition"),
        F.col("n").alias("record_count"),
        (F.col("n") * width * len(measured)).alias("file_size_in_bytes"),
        pairs(lambda k: F.col("n") * width).alias("column_sizes"),
        pairs(lambda k: F.col(f"c{k}")).alias("value_counts"),
        pairs(lambda k: F.col("n") - F.col(f"c{k}")).alias("null_value_counts"),
        pairs(lambda k: F.lit(0).cast("bigint")).alias("nan_value_counts"),
        pairs(lambda k: _bytes(F.col(f"lo{k}"))).alias("lower_bounds"),
        pairs(lambda k: _bytes(F.col(f"hi{k}"))).alias("upper_bounds"),
        F.lit(None).cast("binary").alias("key_metadata"),
        F.array(F.lit(4).cast("bigint")).alias("split_offsets"),
        F.lit(None).cast("array<int>").alias("equality_ids"),
        F.lit(0).alias("sort_order_id"),
    )
    one = F.lit(1).cast("bigint")
    return g.select(F.lit(ADDED).alias("status"), one.alias("snapshot_id"), one.alias("sequence_number"), one.alias("file_sequence_number"), file.alias("data_file"))


def delete_entries(entries: DataFrame, content: int, sequence: int, equality_ids: list[int] | None = None) -> DataFrame:
    """For each entry that of a file of deletes in its partition, by position (content 1) or by equality of columns (content 2)."""
    file = F.col("data_file").withField("content", F.lit(content)).withField("file_path", F.concat("data_file.file_path", F.lit(f".deletes-{sequence}"))).withField("record_count", F.lit(1).cast("bigint"))
    ids = F.array(*map(F.lit, equality_ids)) if equality_ids else F.lit(None)
    number = F.lit(sequence).cast("bigint")
    return entries.withColumns({"data_file": file.withField("equality_ids", ids.cast("array<int>")), "sequence_number": number, "file_sequence_number": number})


def write(entries: DataFrame, path: str, codec: str = "deflate") -> None:
    """Entries as a manifest; the partition's fields, which may be of any primitive type, are taken from the entries."""
    kinds = {"string": "string", "bigint": "long", "int": "int", "double": "double", "boolean": "boolean"}
    parts = {f.name: kinds[f.dataType.simpleString()] for f in entries.schema["data_file"].dataType["partition"].dataType}
    write_ocf(entries, path, codec=codec, schema=manifest_schema(parts))


def plan(spark: SparkSession, path: str) -> DataFrame:
    """file_path, record_count, file_size of live data files; only these fields are decoded."""
    m = read_ocf(spark, path, PLANNED).where(f"status != {DELETED} AND data_file.content = 0")
    return m.select("data_file.file_path", "data_file.record_count", F.col("data_file.file_size_in_bytes").alias("file_size"))


def plan_with_deletes(spark: SparkSession, path: str) -> DataFrame:
    """file_path, record_count and the paths of the delete files that a reader of each live data file must apply, sorted.

    A file of position deletes applies to data files of its partition that are not younger, one of equality deletes to those
    that are older. The join is by partition, so files of deletes, which are few, meet their own partition's data only.
    """
    live = read_ocf(spark, path, [*PLANNED, "sequence_number", "data_file.partition"]).where(f"status != {DELETED}")
    live = live.select("sequence_number", "data_file.content", "data_file.file_path", "data_file.record_count", F.col("data_file.partition").alias("part"))
    data = live.where("content = 0")
    deletes = live.where("content != 0").select(F.col("part").alias("of"), F.col("sequence_number").alias("since"), F.col("content").alias("how"), F.col("file_path").alias("delete_path"))
    meets = F.col("part").eqNullSafe(F.col("of")) & ((F.col("sequence_number") < F.col("since")) | ((F.col("how") == 1) & (F.col("sequence_number") == F.col("since"))))
    joined = data.join(deletes, meets, "left").groupBy("file_path", "record_count").agg(F.array_sort(F.collect_list("delete_path")).alias("deletes"))
    return joined


def full_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all columns of all files: key, files, values, nulls, bytes, lowest and highest value."""
    m = read_ocf(spark, path).where(f"status != {DELETED} AND data_file.content = 0").select("data_file.*")
    zipped = F.arrays_zip("value_counts", "null_value_counts", "column_sizes", "lower_bounds", "upper_bounds")
    z = m.select(F.explode(zipped).alias("z")).select(
        F.col("z.value_counts.key").alias("key"), F.col("z.value_counts.value").alias("v"), F.col("z.null_value_counts.value").alias("u"), F.col("z.column_sizes.value").alias("b"), number(F.col("z.lower_bounds.value")).alias("lo"), number(F.col("z.upper_bounds.value")).alias("hi")
    )
    return z.groupBy("key").agg(F.count("*").alias("files"), F.sum("v").alias("n_values"), F.sum("u").alias("n_nulls"), F.sum("b").alias("n_bytes"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))


def prune(spark: SparkSession, path: str, column: int, low: int, high: int) -> DataFrame:
    """Files that may hold values of a column between low and high, by their bounds."""
    m = read_ocf(spark, path, [*PLANNED, "data_file.lower_bounds", "data_file.upper_bounds"]).where(f"status != {DELETED} AND data_file.content = 0").select("data_file.*")
    bound = lambda c: number(F.filter(c, lambda b: b["key"] == column)[0]["value"])
    b = m.select("file_path", "record_count", F.col("file_size_in_bytes").alias("file_size"), bound("lower_bounds").alias("low"), bound("upper_bounds").alias("high"))
    return b.where((F.col("low") <= high) & (F.col("high") >= low))
