"""The library's registered queries over container files, single values and manifests, with their SQL; more are in queries_values and queries_tables.

Each writes its input to container files in a scratch folder, reads them back lazily through one capability, and returns a
DataFrame with the columns of its SQL.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmill.functions import datum, paths, values
from rowmill.functions.containers import ocf_decode
from rowmill.operators import images, manifest
from rowmill.registry import ORACLE, QUERIES, query
from rowmill.registry import as_ocf as _as_ocf
from rowmill.registry import table as _table
from rowmill.sources.ocf import ocf_count, read_ocf
from rowmill.sources.scratch import scratch
from rowmill.streaming.windows import run_to_table, stream_ocf, tumbling
from rowmill.types import avro_schema

# --- scans, codecs, counts ---------------------------------------------------------------------------------
def _scan(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, table), table))

    return run


for _t in ("nation", "orders", "lineitem"):
    query(f"SELECT * FROM {_t}", f"ocf_scan_{_t}")(_scan(_t))


def _codec(codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _as_ocf(spark, _table(spark, sf_dir, "customer"), codec, codec=codec)
        return read_ocf(spark, path, ["c_custkey", "c_name", "c_acctbal"])

    return run


for _c in ("null", "deflate", "snappy", "zstandard"):
    query("SELECT c_custkey, c_name, c_acctbal FROM customer", f"ocf_codec_{_c}")(_codec(_c))


@query("SELECT count(*) AS n FROM lineitem")
def ocf_count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocf_count(spark, _as_ocf(spark, _table(spark, sf_dir, "lineitem"), "count"))


@query("SELECT c_custkey, c_name FROM customer")
def ocf_decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files as values of a binary column."""
    df = _table(spark, sf_dir, "customer")
    path = _as_ocf(spark, df, "bytes")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").load(path)
    return ocf_decode(files, "path", "content", avro_schema(df.schema), columns=["c_custkey", "c_name"]).drop("path")


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def ocf_split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small blocks and small ranges, so that most ranges begin within a block."""
    path = _as_ocf(spark, _table(spark, sf_dir, "lineitem").coalesce(1), "split", blockRows=100)
    return read_ocf(spark, path, ["l_orderkey", "l_linenumber"], splitBytes=64 << 10)


# --- projection --------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def ocf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, "lineitem"), "projection"), ["l_orderkey", "l_extendedprice"])


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines: an order has a handful of lines, whatever the scale."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))
    return _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "items")


@query("SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def ocf_nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _as_ocf(spark, _nested_orders(spark, sf_dir), "nested")
    return read_ocf(spark, path, ["o_orderkey", "items.l_partkey"]).select("o_orderkey", F.explode("items.l_partkey").alias("l_partkey"))


@query("SELECT n_nationkey, n_name FROM nation")
def ocf_projection_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "nation")
    wanted = json.loads(avro_schema(df.schema).to_json())
    wanted["fields"] = [f for f in wanted["fields"] if f["name"] != "n_regionkey"]
    return read_ocf(spark, _as_ocf(spark, df, "narrow"), projection=json.dumps(wanted))


# --- resolution and types ----------------------------------------------------------------------------------
@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS label, 'd' AS b FROM nation")
def ocf_resolve_promote_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = {"type": "record", "name": "topLevelRecord", "fields": [{"name": "n_nationkey", "type": ["null", "long"]}, {"name": "label", "type": ["null", "string"], "aliases": ["n_name"]}, {"name": "b", "type": "string", "default": "d"}]}
    return read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, "nation"), "resolve"), reader_schema=json.dumps(reader))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS branch, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS number, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS name FROM customer")
def ocf_union_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nullable union as a nullable column, and a union of two types as a struct of its branches."""
    schema = {"type": "record", "name": "c", "fields": [{"name": "c_custkey", "type": "long"}, {"name": "balance", "type": ["null", "double"]}, {"name": "either", "type": ["long", "string"]}]}
    even = F.col("c_custkey") % 2 == 0
    either = F.struct(F.when(even, 0).otherwise(1).alias("branch"), F.when(even, F.col("c_custkey")).alias("member0"), F.when(~even, F.col("c_name")).alias("member1"))
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), either.alias("either"))
    r = read_ocf(spark, _as_ocf(spark, df, "union", schema=json.dumps(schema)))
    return r.select("c_custkey", "balance", values.union_branch(F.col("either")).alias("branch"), values.union_value(F.col("either"), 0).alias("number"), values.union_value(F.col("either"), 1).alias("name"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, o_orderdate AS at, o_totalprice::DECIMAL(12,2)::VARCHAR AS price, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status FROM orders")
def ocf_logical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = ["F", "O", "P"]
    schema = {
        "type": "record",
        "name": "o",
        "fields": [
            {"name": "o_orderkey", "type": "long"},
            {"name": "day", "type": {"type": "int", "logicalType": "date"}},
            {"name": "at", "type": {"type": "long", "logicalType": "local-timestamp-micros"}},
            {"name": "price", "type": {"type": "bytes", "logicalType": "decimal", "precision": 12, "scale": 2}},
            {"name": "status", "type": {"type": "enum", "name": "status", "symbols": symbols}},
        ],
    }
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderstatus").alias("status"))
    r = read_ocf(spark, _as_ocf(spark, df, "logical", schema=json.dumps(schema)))
    return r.withColumns({"status": values.enum_position(F.col("status"), symbols), "day": F.col("day").cast("string"), "price": F.col("price").cast("string")})


@query("SELECT event_id, user_id, length(event_type) AS n_type, 2::INT AS n_keys, event_type AS first_tag, (user_id + 1)::BIGINT AS second FROM events")
def ocf_map_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("type"), F.col("event_type"), F.lit("kind"), F.lit("event"))
    df = _table(spark, sf_dir, "events").select("event_id", "user_id", tags.alias("tags"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("ids"))
    r = read_ocf(spark, _as_ocf(spark, df, "maps"))
    return r.select("event_id", "user_id", F.length(values.map_value(F.col("tags"), "type")).cast("bigint").alias("n_type"), F.size(values.map_keys(F.col("tags"))).alias("n_keys"), values.map_value(F.col("tags"), "type").alias("first_tag"), values.array_item(F.col("ids"), 1).alias("second"))


@query("SELECT vec_id, len(embedding)::INT AS n, embedding[1] AS first, label FROM embeddings")
def ocf_embeddings_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, "embeddings"), "vectors"))
    return r.select("vec_id", F.size("embedding").alias("n"), F.col("embedding")[0].alias("first"), "label")


@query("SELECT o_orderkey, 2::BIGINT AS depth FROM orders")
def ocf_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive type is JSON text, and from there a variant."""
    node = {"type": "record", "name": "Node", "fields": [{"name": "value", "type": "long"}, {"name": "next", "type": ["null", "Node"]}]}
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.lit(1).cast("bigint").alias("value"), F.struct(F.lit(2).cast("bigint").alias("value"), F.lit(None).cast("struct<value:bigint>").alias("next")).alias("next")).alias("node"))
    schema = {"type": "record", "name": "r", "fields": [{"name": "o_orderkey", "type": "long"}, {"name": "node", "type": node}]}
    r = read_ocf(spark, _as_ocf(spark, df, "nodes", schema=json.dumps(schema)))
    v = values.recursive_to_variant(F.col("node"))
    return r.select("o_orderkey", F.variant_get(v, "$.next.value", "bigint").alias("depth"))


# --- single values -----------------------------------------------------------------------------------------
_PART = {"type": "record", "name": "part", "fields": [{"name": "p_partkey", "type": "long"}, {"name": "p_name", "type": "string"}, {"name": "p_size", "type": "int"}, {"name": "p_retailprice", "type": "double"}]}


def _encoded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f["name"] for f in _PART["fields"]]
    return _table(spark, sf_dir, "part").select(datum.avro_encode(F.struct(*names), json.dumps(_PART)).alias("data"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def datum_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_parts(spark, sf_dir).select(datum.avro_decode(F.col("data"), json.dumps(_PART)).alias("v")).select("v.*")


@query("SELECT p_partkey, p_size FROM part")
def datum_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_parts(spark, sf_dir).select(datum.avro_decode(F.col("data"), json.dumps(_PART), columns=["p_partkey", "p_size"]).alias("v")).select("v.*")


@query("SELECT p_partkey, p_size::BIGINT AS p_size, 'none' AS note FROM part")
def datum_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = {"type": "record", "name": "part", "fields": [{"name": "p_partkey", "type": "long"}, {"name": "p_size", "type": "long"}, {"name": "note", "type": "string", "default": "none"}]}
    return _encoded_parts(spark, sf_dir).select(datum.avro_decode(F.col("data"), json.dumps(_PART), reader=json.dumps(reader)).alias("v")).select("v.*")


@query("SELECT s_suppkey, s_acctbal AS amount, 'USD' AS currency FROM supplier")
def datum_schemata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema that names a type of another document."""
    money = '{"type":"record","name":"Money","namespace":"shop","fields":[{"name":"amount","type":"double"},{"name":"currency","type":{"type":"enum","name":"Currency","symbols":["EUR","USD"]}}]}'
    account = '{"type":"record","name":"Account","namespace":"shop","fields":[{"name":"holder","type":"long"},{"name":"balance","type":"Money"}]}'
    value = F.struct(F.col("s_suppkey").alias("holder"), F.struct(F.col("s_acctbal").alias("amount"), F.lit("USD").alias("currency")).alias("balance"))
    data = _table(spark, sf_dir, "supplier").select(datum.avro_encode(value, account, [money]).alias("data"))
    v = data.select(datum.avro_decode(F.col("data"), account, schemata=[money]).alias("v"))
    return v.select(F.col("v.holder").alias("s_suppkey"), "v.balance.amount", "v.balance.currency")


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS js FROM nation")
def datum_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = '{"type":"record","name":"n","fields":[{"name":"n_nationkey","type":"int"},{"name":"n_name","type":"string"}]}'
    return _table(spark, sf_dir, "nation").select("n_nationkey", datum.avro_to_json(datum.avro_encode(F.struct("n_nationkey", "n_name"), schema), schema).alias("js"))


@query("SELECT c_custkey, c_acctbal >= 0 AS ok FROM customer")
def value_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative balances are made text, which is no double."""
    schema = '{"type":"record","name":"c","fields":[{"name":"balance","type":"double"}]}'
    good, bad = F.struct(F.col("c_acctbal").alias("balance")), F.struct(F.col("c_name").alias("balance"))
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", datum.avro_validate(good, schema).alias("a"), datum.avro_validate(bad, schema).alias("b"))
    return df.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("a")).otherwise(F.col("b")).alias("ok"))


@query("SELECT s_suppkey, s_suppkey::DOUBLE AS key2, 0 AS rank FROM supplier")
def value_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    writer = '{"type":"record","name":"s","fields":[{"name":"s_suppkey","type":"long"}]}'
    reader = '{"type":"record","name":"s","fields":[{"name":"key2","aliases":["s_suppkey"],"type":"double"},{"name":"rank","type":"int","default":0}]}'
    v = _table(spark, sf_dir, "supplier").select("s_suppkey", datum.avro_resolve(F.struct("s_suppkey"), writer, reader).alias("v"))
    return v.select("s_suppkey", "v.key2", "v.rank")


# --- paths and edits ---------------------------------------------------------------------------------------
@query("SELECT o_orderkey, (SELECT min(l_partkey) FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_linenumber = (SELECT min(l_linenumber) FROM lineitem k WHERE k.l_orderkey = o_orderkey)) AS part, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o_orderkey)::INT AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_ocf(spark, _as_ocf(spark, _nested_orders(spark, sf_dir), "paths"))
    items = paths.PathReader(df.schema, "items")
    return df.select("o_orderkey", items.get("[0].l_partkey", "long").alias("part"), items.array_len("").alias("n"))


@query("SELECT p_partkey, p_size + 1 AS p_size, 'x' AS extra FROM part")
def record_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values.record_put(values.record_put(F.struct("p_partkey", "p_size"), "p_size", F.col("p_size") + 1), "extra", F.lit("x"))
    return _table(spark, sf_dir, "part").select(v.alias("v")).select("v.*")


@query("SELECT p_partkey, 3::INT AS n, p_size AS last FROM part")
def array_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values.array_push(values.create_array(values.create("int", 1), values.create("int", 2)), F.col("p_size"))
    return _table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", F.size("v").alias("n"), values.array_item(F.col("v"), 2).alias("last"))


@query("SELECT p_partkey, 2::INT AS n, p_size AS a FROM part")
def map_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values.map_put(values.create_map(a=F.lit(0), b=F.lit(1)), F.lit("a"), F.col("p_size"))
    return _table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", F.size("v").alias("n"), values.map_value(F.col("v"), "a").alias("a"))


# --- manifests ---------------------------------------------------------------------------------------------
_ENTRY = """SELECT 'data/flag=' || l_returnflag || '/month=' || strftime(l_shipdate, '%Y-%m') || '/0.parquet' AS file_path, count(*) AS record_count, count(*) * 24 AS file_size,
min(round(l_quantity)::BIGINT) AS low, max(round(l_quantity)::BIGINT) AS high FROM lineitem GROUP BY l_returnflag, strftime(l_shipdate, '%Y-%m')"""


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    rows = _table(spark, sf_dir, "lineitem")
    by = {"flag": F.col("l_returnflag"), "month": F.date_format("l_shipdate", "yyyy-MM")}
    measured = {1: F.round("l_quantity"), 2: F.round(F.col("l_discount") * 100), 3: F.col("l_linenumber")}
    path = scratch(spark, "manifest")
    manifest.write(manifest.build(rows, by, measured), path)
    return path


@query(f"SELECT file_path, record_count, file_size FROM ({_ENTRY})")
def manifest_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.plan(spark, _manifest(spark, sf_dir))


@query("""WITH m AS (SELECT l_returnflag AS f, strftime(l_shipdate, '%Y-%m') AS t, round(l_quantity)::BIGINT AS q, round(l_discount * 100)::BIGINT AS d, l_linenumber::BIGINT AS n FROM lineitem),
g AS (SELECT count(DISTINCT f || t) AS files, count(*) AS rows FROM m)
SELECT 1 AS key, files, rows::HUGEINT::BIGINT AS n_values, 0::BIGINT AS n_nulls, (rows * 8)::BIGINT AS n_bytes, (SELECT min(q) FROM m) AS lowest, (SELECT max(q) FROM m) AS highest FROM g
UNION ALL SELECT 2, files, rows, 0, rows * 8, (SELECT min(d) FROM m), (SELECT max(d) FROM m) FROM g
UNION ALL SELECT 3, files, rows, 0, rows * 8, (SELECT min(n) FROM m), (SELECT max(n) FROM m) FROM g""")
def manifest_full_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.full_metrics(spark, _manifest(spark, sf_dir))


@query(f"SELECT * FROM ({_ENTRY}) WHERE low <= 1 AND high >= 0")
def manifest_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prune(spark, _manifest(spark, sf_dir), 1, 0, 1)


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS f, strftime(l_shipdate, '%Y') AS y, 'data/flag=' || l_returnflag || '/year=' || strftime(l_shipdate, '%Y') || '/0.parquet' AS file_path FROM lineitem)
SELECT file_path, CASE f WHEN 'R' THEN file_path || '.deletes-1;' || file_path || '.deletes-2' WHEN 'A' THEN file_path || '.deletes-2' ELSE '' END AS deletes FROM d""")
def manifest_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files with their files of deletes: by position as old as the data (applies), by equality as old (does not), and by equality that is younger."""
    rows = _table(spark, sf_dir, "lineitem")
    entries = manifest.build(rows, {"flag": F.col("l_returnflag"), "year": F.date_format("l_shipdate", "yyyy")}, {1: F.col("l_linenumber")})
    flag = F.col("data_file.partition.flag")
    more = [manifest.delete_entries(entries.where(flag == "R"), 1, 1), manifest.delete_entries(entries.where(flag == "N"), 2, 1, [1]), manifest.delete_entries(entries.where(flag.isin("R", "A")), 2, 2, [1])]
    gone = entries.withColumn("status", F.lit(manifest.DELETED)).withColumn("data_file", F.col("data_file").withField("file_path", F.lit("gone")))
    for m in [*more, gone]:
        entries = entries.unionByName(m)
    path = scratch(spark, "manifest-deletes")
    manifest.write(entries, path)
    return manifest.plan_with_deletes(spark, path).select("file_path", F.concat_ws(";", "deletes").alias("deletes"))


# --- Spark's own operators on top --------------------------------------------------------------------------
@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def ocf_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, "orders"), "orders"), ["o_custkey", "o_totalprice"])
    customer = read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, "customer"), "customer"), ["c_custkey", "c_nationkey"])
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS nth FROM orders")
def ocf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, "orders"), "window"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return r.select("o_orderkey", "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("nth"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def ocf_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_ocf(spark, _as_ocf(spark, _table(spark, sf_dir, "lineitem"), "top"), ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return r.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


# --- streams and images ------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ocf_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = _as_ocf(spark, events.repartition(3), "events")
    out = run_to_table(tumbling(stream_ocf(spark, path), "ts", "1 hour", "3650 days", "event_type", value="value"), "tumbling")
    return out.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
