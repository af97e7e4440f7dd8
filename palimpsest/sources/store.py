"""Reading a store's files and local folders, and writing tables of them."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.ids import is_id
from palimpsest.model import Config, guard

# The folder of each type of file.
FOLDERS = {"key": "keys", "snapshot": "snapshots", "index": "index", "pack": "data"}


def root_of(url: str) -> str:
    """A path for Spark's file systems from a location: a plain path, a URL of a scheme that Hadoop knows, or scheme:path of the object stores."""
    scheme = urlparse(url).scheme
    if not scheme or len(scheme) == 1:
        return url
    known = {"local": "file://", "s3": "s3a://", "gs": "gs://", "azblob": "wasbs://", "hdfs": "hdfs://"}
    if scheme in ("rest", "rclone", "sftp", "http", "https"):
        raise ValueError(f"{scheme} has no file system here; mount it or copy it first")
    rest = url.split(":", 1)[1]
    return url if rest.startswith("//") and scheme not in known else known.get(scheme, f"{scheme}://") + rest.removeprefix("//")


def _binary(spark: SparkSession, path: str, content: bool) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", "modificationTime", *(["content"] if content else []))


def listing(spark: SparkSession, root: str, tpe: str) -> DataFrame:
    """tpe, id, size of files whose names are ids; contents aren't read."""
    rows = _binary(spark, f"{root_of(root)}/{FOLDERS[tpe]}", False).select(F.lit(tpe).alias("tpe"), F.substring_index("path", "/", -1).alias("id"), F.col("length").alias("size"))
    return rows.where(is_id(F.col("id")))


def files(spark: SparkSession, root: str, tpe: str) -> DataFrame:
    """id, content of whole files."""
    rows = _binary(spark, f"{root_of(root)}/{FOLDERS[tpe]}", True).select(F.substring_index("path", "/", -1).alias("id"), "content")
    return rows.where(is_id(F.col("id")))


def read_at(content: Column, offset: Column, length: Column) -> Column:
    return F.substring(content, offset + 1, length)


def documents(spark: SparkSession, root: str, tpe: str, schema: str, ids: DataFrame | None = None) -> DataFrame:
    """id and the fields of JSON files of a type, of all or some ids; files that can't be read are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").option("multiLine", "true").schema(schema).json(f"{root_of(root)}/{FOLDERS[tpe]}")
    rows = rows.withColumn("id", F.substring_index(F.input_file_name(), "/", -1)).where(is_id(F.col("id")))
    return rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")


def get(table: DataFrame, i: str) -> DataFrame:
    return table.where(F.col("id") == i)


def _empty_files(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime of files without content, which Spark's file sources pass over: folders directly below path are listed in a task each."""
    import pyarrow as pa
    from pyarrow import fs

    scheme = urlparse(path).scheme
    files, inner = fs.FileSystem.from_uri(path if scheme else f"file://{path}")
    whole = path if scheme else f"file:{path}"
    lead = whole[: len(whole) - len(inner)]

    def found(folder: str, deep: bool) -> list[tuple]:
        own = files.get_file_info(fs.FileSelector(folder, recursive=deep))
        return [(lead + x.path, x.mtime) for x in own if x.type == fs.FileType.File and not x.size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [x for f in b.column(0).to_pylist() for x in found(f, True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.string()), pa.array([t for _, t in own], pa.timestamp("us", "UTC"))], names=["path", "mtime"])

    below = [(x.path,) for x in files.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.Directory]
    schema = "path string, mtime timestamp"
    out = spark.createDataFrame(found(inner, False), schema)
    if below:
        out = out.unionByName(spark.createDataFrame(below, "inner string").repartition(len(below)).mapInArrow(run, schema))
    return out


def walked(spark: SparkSession, path: str, marker: str | None = None, max_size: int | None = None, keep: Column | None = None) -> DataFrame:
    """path, type, size, mtime, content of files under a folder, empty ones included, without those too large, those in folders that hold a marker file, or those a
    condition leaves out."""
    rows = _binary(spark, path, True).select(F.col("path"), F.lit("file").alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    empty = _empty_files(spark, root_of(path))
    rows = rows.unionByName(empty.select("path", F.lit("file").alias("type"), F.lit(0).cast("long").alias("size"), "mtime", F.unhex(F.lit("")).alias("content")))
    if max_size is not None:
        rows = rows.where(F.col("size") <= max_size)
    if marker is not None:
        folder = F.regexp_replace("path", "/[^/]*$", "")
        marked = rows.where(F.endswith("path", F.lit(f"/{marker}"))).select(folder.alias("at")).distinct()
        above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
        hidden = rows.select("path", F.explode(above).alias("at")).join(marked, "at", "left_semi").select("path").distinct()
        rows = rows.join(hidden, "path", "left_anti")
    return rows if keep is None else rows.where(keep)


def single(spark: SparkSession, content: bytes, path: str = "stdin") -> DataFrame:
    """One entry, such as what a command wrote."""
    return spark.createDataFrame([(path, "file", len(content), bytearray(content))], "path string, type string, size long, content binary")


def save(df: DataFrame, path: str, by: str | None = None, dry_run: bool = False) -> DataFrame:
    """Append to a table, in folders by the first two characters of an id if asked for. A dry run writes nothing."""
    if not dry_run:
        rows = df.withColumn("prefix", F.substring(by, 1, 2)) if by else df
        w = rows.write.mode("append")
        (w.partitionBy("prefix") if by else w).parquet(path)
    return df


def put(spark: SparkSession, root: str, files: dict[tuple[str, str], bytes], dry_run: bool = False) -> None:
    """Write files, by type and id, under a location of any file system that Spark knows; packs go to a folder by the first two characters of their id. For the few files
    that a driver makes, such as snapshots and indexes; tables are written by save()."""
    jvm = spark.sparkContext._jvm
    for (tpe, i), content in () if dry_run else files.items():
        where = jvm.org.apache.hadoop.fs.Path(f"{root_of(root)}/{FOLDERS[tpe]}/{i[:2] + '/' if tpe == 'pack' else ''}{i}")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(content))
        out.close()


def removed(table: DataFrame, ids: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    guard(config, "removing files")
    return table.join(ids.select("id"), "id", "left_anti")


def routed(requests: DataFrame) -> DataFrame:
    """requests (tpe, blob_type, op) with target: reads of whole files and of parts that are cached go to the hot store; writes to both, but configs and data packs to the cold one."""
    cacheable = (F.col("tpe") != "pack") | (F.col("blob_type") == "tree")
    target = F.when(F.col("op") == "read_full", "hot").when(F.col("op") == "read_partial", F.when(cacheable, "hot").otherwise("cold"))
    return requests.withColumn("target", target.otherwise(F.when((F.col("tpe") == "config") | ~cacheable, F.lit("cold")).otherwise(F.lit("both"))))
