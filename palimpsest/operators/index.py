"""The index: which blob lies where in which pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import BLOB_TYPES, ENTRY_COMPRESSED, ENTRY_PLAIN, FILE_TYPES, HEADER_LENGTH, OVERHEAD

ENTRY = ("index_id", "pack_id", "to_delete")


def exploded(indexes: DataFrame) -> DataFrame:
    """INDEX_BLOBS rows from index files: id, packs and packs_to_delete, arrays of (id, time, size, blobs)."""
    rows = None
    for column, gone in (("packs", False), ("packs_to_delete", True)):
        own = indexes.select(F.col("id").alias("index_id"), F.explode(column).alias("p"), F.lit(gone).alias("to_delete"))
        own = own.select("index_id", F.col("p.id").alias("pack_id"), "to_delete", F.col("p.time").alias("pack_time"), F.posexplode_outer("p.blobs").alias("blob_pos", "b"))
        own = own.select("index_id", "pack_id", "to_delete", "pack_time", "blob_pos", F.col("b.id").alias("blob_id"), F.col("b.type").alias("blob_type"), F.col("b.offset").alias("offset"), F.col("b.length").alias("length"), F.col("b.uncompressed_length").alias("uncompressed_length"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def entry_length() -> Column:
    return F.when(F.col("uncompressed_length").isNull(), F.lit(ENTRY_PLAIN)).otherwise(F.lit(ENTRY_COMPRESSED))


def data_length() -> Column:
    """Plain length of a blob."""
    return F.coalesce(F.col("uncompressed_length"), F.col("length") - OVERHEAD)


def packs(blobs: DataFrame, *more: Column) -> DataFrame:
    """A row for each entry of a pack in an index: blob_type (that of its first blob; data if it has none), blobs, pack_size (what the file must measure), and more aggregates."""
    first = F.min_by("blob_type", "blob_pos")
    size = F.coalesce(F.sum(F.col("length") + entry_length()), F.lit(0)) + OVERHEAD + HEADER_LENGTH
    return blobs.groupBy(*ENTRY).agg(F.coalesce(first, F.lit("data")).alias("blob_type"), F.count("blob_id").alias("blobs"), size.cast("long").alias("pack_size"), F.min("pack_time").alias("pack_time"), *more)


def deduplicated(entries: DataFrame) -> DataFrame:
    """One entry for each pack: a live one before one marked for deletion, then the first index."""
    first = Window.partitionBy("pack_id").orderBy("to_delete", "index_id")
    return entries.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def is_first() -> Column:
    """Of rows of blobs: whether they are of the entry of their pack that deduplicated() keeps."""
    return F.rank().over(Window.partitionBy("pack_id").orderBy("to_delete", "index_id")) == 1


def lookup(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Where each wanted blob (blob_id, blob_type) lies, null if nowhere. Live packs only; of several places the first by pack and offset."""
    live = blobs.where("NOT to_delete").groupBy("blob_type", "blob_id").agg(F.min(F.struct("pack_id", "offset", "length", "uncompressed_length")).alias("at"))
    return wanted.join(live, ["blob_type", "blob_id"], "left").select("blob_type", "blob_id", "at.pack_id", "at.offset", "at.length", "at.uncompressed_length")


def known(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    return wanted.join(blobs.where("NOT to_delete").select("blob_id"), "blob_id", "left_semi")


def unknown(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct wanted blobs that no live pack has: what a writer still has to store, or a check misses."""
    return wanted.dropDuplicates(["blob_id"]).join(blobs.where("NOT to_delete").select("blob_id"), "blob_id", "left_anti")


def _zero_filled(found: DataFrame, keys: dict[str, tuple], counts: tuple[str, ...]) -> DataFrame:
    """Rows for all combinations of a few fixed keys."""
    spark, rows = found.sparkSession, [()]
    for values in keys.values():
        rows = [(*r, v) for r in rows for v in values]
    kinds = {bool: "boolean", str: "string"}
    full = spark.createDataFrame(rows, ", ".join(f"{k} {kinds[type(v[0])]}" for k, v in keys.items()))
    return full.join(found, list(keys), "left").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) if c in counts else c for c in found.columns if c not in keys))


def blob_infos(blobs: DataFrame) -> DataFrame:
    """to_delete, blob_type (of the pack), count, size (packed), data_size, zeros included."""
    rows = blobs.join(packs(blobs).select(*ENTRY, F.col("blob_type").alias("pack_type")), list(ENTRY)).where("blob_id IS NOT NULL")
    found = rows.groupBy("to_delete", F.col("pack_type").alias("blob_type")).agg(F.count("*").alias("count"), F.sum("length").alias("size"), F.sum(data_length()).alias("data_size"))
    return _zero_filled(found, {"to_delete": (False, True), "blob_type": BLOB_TYPES}, ("count", "size", "data_size"))


def pack_infos(blobs: DataFrame) -> DataFrame:
    """to_delete, blob_type, count, min_size, max_size (null where there are none)."""
    found = packs(blobs).groupBy("to_delete", "blob_type").agg(F.count("*").alias("count"), F.min("pack_size").alias("min_size"), F.max("pack_size").alias("max_size"))
    return _zero_filled(found, {"to_delete": (False, True), "blob_type": BLOB_TYPES}, ("count",))


def total_size(blobs: DataFrame) -> DataFrame:
    found = packs(blobs.where("NOT to_delete")).groupBy("blob_type").agg(F.sum("pack_size").alias("total_size"))
    return _zero_filled(found, {"blob_type": BLOB_TYPES}, ("total_size",))


def file_infos(files: DataFrame) -> DataFrame:
    """tpe, count, size for every type of file."""
    return _zero_filled(files.groupBy("tpe").agg(F.count("*").alias("count"), F.sum("size").alias("size")), {"tpe": FILE_TYPES}, ("count", "size"))
