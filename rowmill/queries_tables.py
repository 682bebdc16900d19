"""Registered queries of Spark's own operators over container files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.registry import as_ocf, query, table
from rowmill.sources.ocf import read_ocf
from rowmill.sources.scratch import scratch
from rowmill.streaming.windows import run_to_table, sliding, stream_ocf


def _read(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return read_ocf(spark, as_ocf(spark, table(spark, sf_dir, name), name), columns)


_PUSHED = "CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_PUSHED} >= 30 AND l_returnflag IN ('R', 'N') AND l_linestatus IS NOT NULL")
def ocf_filter_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters pushed into the source, NaN and nulls among the numbers. The result is written while pushdown is on."""
    x = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), "l_returnflag", "l_linestatus")
    source, out, on = as_ocf(spark, df, "pushed"), scratch(spark, "pushed"), "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(on, "false")
    spark.conf.set(on, "true")
    try:
        r = read_ocf(spark, source, pushdown="true").where("x >= 30 AND l_returnflag IN ('R', 'N') AND l_linestatus IS NOT NULL")
        r.select("l_orderkey", "l_linenumber").write.parquet(out)
    finally:
        spark.conf.set(on, before)
    return spark.read.parquet(out)


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def ocf_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _read(spark, sf_dir, "customer", ["c_custkey"]), _read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    return c.join(o.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def ocf_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = _read(spark, sf_dir, "part", ["p_partkey"]), _read(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity"])
    return p.join(li.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def ocf_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = _read(spark, sf_dir, "part", ["p_partkey"]), _read(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity"])
    return p.join(li.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("SELECT c_nationkey, s_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey % 2 = 0) FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey % 3 = 0) ON c_nationkey = s_nationkey GROUP BY ALL")
def ocf_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer", ["c_nationkey"]).where("c_nationkey % 2 = 0").distinct()
    s = _read(spark, sf_dir, "supplier", ["s_nationkey"]).where("s_nationkey % 3 = 0").distinct()
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))


_GROUPED = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT + 0 AS g, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY {}(l_returnflag, l_linestatus)"


def _grouped(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = _read(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"])
        return getattr(r, how)("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

    return run


query(_GROUPED.format("CUBE"), "ocf_cube")(_grouped("cube"))
query(_GROUPED.format("ROLLUP"), "ocf_rollup")(_grouped("rollup"))


@query("SELECT l_linestatus, count(DISTINCT l_partkey) AS parts, true AS near, round(median(l_quantity), 4) AS middle, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day FROM lineitem GROUP BY l_linestatus")
def ocf_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and approximate numbers of distinct values, which agree within a tenth, and a median."""
    r = _read(spark, sf_dir, "lineitem", ["l_linestatus", "l_partkey", "l_quantity", "l_shipdate"]).groupBy("l_linestatus")
    g = r.agg(F.countDistinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.round(F.median("l_quantity"), 4).alias("middle"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_day"))
    return g.select("l_linestatus", "parts", (F.abs(F.col("about") / F.col("parts") - 1) < 0.1).alias("near"), "middle", "first_day")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _read(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).select((F.col("c_custkey") % 50).alias("k"))
    return a, _read(spark, sf_dir, "supplier", ["s_suppkey"]).select((F.col("s_suppkey") * 2 % 60).alias("k"))


_A, _B = "SELECT c_custkey % 50 AS k FROM customer", "SELECT s_suppkey * 2 % 60 AS k FROM supplier"


@query(f"{_A} EXCEPT {_B}")
def ocf_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.subtract(b)


@query(f"{_A} INTERSECT {_B}")
def ocf_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} UNION ALL {_B}")
def ocf_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.unionAll(b)


@query("SELECT o_orderkey, upper(o_orderstatus) || '-' || lpad((o_orderkey % 1000)::VARCHAR, 5, '0') AS label, year(o_orderdate)::INT AS y, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, round(sqrt(o_totalprice), 6) AS root, abs(o_totalprice - 1000) < 500 AS near FROM orders")
def ocf_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"])
    label = F.concat(F.upper("o_orderstatus"), F.lit("-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 5, "0"))
    return r.select("o_orderkey", label.alias("label"), F.year("o_orderdate").alias("y"), F.trunc("o_orderdate", "month").cast("string").alias("m"), F.round(F.sqrt("o_totalprice"), 6).alias("root"), (F.abs(F.col("o_totalprice") - 1000) < 500).alias("near"))


@query("SELECT date_trunc('hour', ts) - to_hours(h::INT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 3) t(h) GROUP BY 1, 2")
def ocf_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three hours that begin every hour, over a stream of container files."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = as_ocf(spark, events.repartition(3), "events")
    out = run_to_table(sliding(stream_ocf(spark, path), "ts", "3 hours", "1 hour", "3650 days", "event_type", value="value"), "sliding")
    return out.withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def ocf_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events of one user that end after six hours without one."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = stream_ocf(spark, as_ocf(spark, events.repartition(3), "events"), columns="user_id,ts")
    sessions = stream.withWatermark("ts", "3650 days").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    out = run_to_table(sessions.select("user_id", F.col("session_window.start").alias("session_start"), "n"), "sessions")
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
