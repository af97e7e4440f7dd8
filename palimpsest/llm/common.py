"""What the operators of this subpackage share: word rules, scratch tables, shipping of code."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls TAB to CR.
SEPARATOR = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; of a null text, an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, the warehouse; on a single machine, a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not found and re.match(r"local(\[|$)", sc.master):
        found = tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(found)
    return found or spark.conf.get("spark.sql.warehouse.dir")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; the file system drops it when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def dropped(*tables: DataFrame) -> None:
    """Remove tables from written() that nothing unfinished reads any more."""
    for t in tables:
        drop_scratch(t.sparkSession, t._scratch)


def drop_scratch(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: While tables are written: shuffle files of the finished write would otherwise stay until the driver collects its garbage;
#: batches for Python workers are kept small, as rows here can be long.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, WRITING):
        df.write.parquet(path)
    tidy_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Give memory that a process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy_driver(spark: SparkSession) -> bool:
    """The same for the driver's JVM, whose compilers and codecs leave much freed native memory behind. False where the JVM has no command for it."""
    jvm = spark.sparkContext._jvm
    # By reflection, as the server's own class isn't public.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return False
    return True


def tidied(run):
    """A function over batches for mapInArrow, after which its worker, which outlives the task, is tidy."""

    @functools.wraps(run)
    def wrapper(batches):
        tidy()
        yield from run(batches)
        tidy()

    return wrapper


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, once for each application.

    Batches of Spark's default size hold too much text for a worker's memory; where the session says nothing else they get fewer rows.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "2000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="palimpsest-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(name)
