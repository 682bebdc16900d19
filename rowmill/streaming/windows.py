"""Streams of container files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.sources.ocf import register
from rowmill.sources.scratch import scratch


def stream_ocf(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A streaming DataFrame of the container files that a folder holds and gets."""
    register(spark)
    read = spark.readStream.format("ocf")
    for k, v in options.items():
        read = read.option(k, str(v))
    return read.load(path)


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str, value: str) -> DataFrame:
    """Counts and sums in windows of event time; rows later than `late` behind the newest are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, width: str, every: str, late: str, *keys: str, value: str) -> DataFrame:
    """Counts and sums in windows that begin every so often and so overlap; rows later than `late` behind the newest are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width, every), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def run_to_table(stream: DataFrame, tag: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its result as a batch table."""
    spark = stream.sparkSession
    out, state = scratch(spark, tag), scratch(spark, f"{tag}-state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
