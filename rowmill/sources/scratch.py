"""Folders for intermediate files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: str | None = None


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; in a local session without one, in a temporary folder."""
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="rowmill-")
            atexit.register(shutil.rmtree, _local, ignore_errors=True)
        root = f"file://{_local}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Let the driver's JVM delete an intermediate table that has been written when the application ends; until then results may read it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
