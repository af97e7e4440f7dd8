"""What restoring a snapshot to a place would do, and which bytes it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def planned(nodes: DataFrame, there: DataFrame, verify: bool = False) -> DataFrame:
    """path, type, action for each path of a snapshot (nodes) or at the destination: restore, modify, unchanged, verify (content must be compared), additional.

    Another type is replaced. Two empty files are unchanged; files of one size and mtime too, unless verify is set; of one size else need comparing.
    """
    old = there.select(F.col("path").alias("_path"), F.col("type").alias("_type"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    rows = nodes.select("path", "type", "size", "mtime").join(old, F.col("path") == F.col("_path"), "full_outer")
    sized, timed = F.col("size").eqNullSafe(F.col("_size")), F.col("mtime").eqNullSafe(F.col("_mtime"))
    action = (
        F.when(F.col("path").isNull(), "additional").when(F.col("_path").isNull(), "restore").when(F.col("type") != F.col("_type"), "modify").when(F.col("type") != "file", "unchanged")
        .when((F.col("size") == 0) & (F.col("_size") == 0), "unchanged").when(sized & timed & F.lit(not verify), "unchanged").when(sized, "verify").otherwise("modify")
    )
    return rows.select(F.coalesce("path", "_path").alias("path"), F.coalesce("type", "_type").alias("type"), action.alias("action"))


def verified(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """path, action of files to verify: verified if every blob (path, pos, blob_id) is found in place, else modify."""
    rows = wanted.join(found.select("path", "pos", F.col("blob_id").alias("_id")), ["path", "pos"], "left")
    return rows.groupBy("path").agg(F.when(F.bool_and(F.col("blob_id").eqNullSafe(F.col("_id"))), F.lit("verified")).otherwise(F.lit("modify")).alias("action"))


def statistics(plan: DataFrame) -> DataFrame:
    return plan.groupBy("type", "action").agg(F.count("*").alias("count"))


def without_hardlinks(nodes: DataFrame) -> DataFrame:
    """nodes with link_to: the first path of the same device and inode, for files with several links; null for that path itself and for others."""
    linked = (F.col("type") == "file") & (F.col("links") > 1) & (F.col("inode") != 0) & (F.col("device_id") != 0)
    first = F.min(F.when(linked, F.col("path"))).over(Window.partitionBy("device_id", "inode"))
    return nodes.withColumn("link_to", F.when(linked & (first != F.col("path")), first))


def reads(offsets: DataFrame, index: DataFrame) -> DataFrame:
    """pack_id, offset, length and targets (path, start): each blob once, with all places it goes to. offsets: path, blob_id, start; index: blob_id, pack_id, offset, length."""
    at = index.groupBy("blob_id").agg(F.min(F.struct("pack_id", "offset", "length")).alias("at"))
    rows = offsets.join(at, "blob_id")
    return rows.groupBy("blob_id", "at").agg(F.array_sort(F.collect_list(F.struct("path", "start"))).alias("targets")).select("at.pack_id", "at.offset", "at.length", "targets")
