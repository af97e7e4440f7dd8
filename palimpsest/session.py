"""Spark sessions as this library expects them, and tables that cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """UTC, adaptive execution, splitting of skewed joins."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, the warehouse; on a single machine, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found and re.match(r"local(\[|$)", spark.sparkContext.master):
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found or spark.conf.get("spark.sql.warehouse.dir")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder that driver and executors share; lost executors cost no recomputation of what led to it.

    It goes when the application ends, or with unsettled().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def unsettled(*tables: DataFrame) -> None:
    """Remove tables from settled() that nothing reads any more."""
    for t in tables:
        where, files = _path(t.sparkSession, t._settled)
        files.delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="palimpsest-core-", suffix=".zip")  # code for the driver to send, not data
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(name)
