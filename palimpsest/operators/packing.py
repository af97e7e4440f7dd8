"""Sizes, filling and reading of packs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from palimpsest.functions.ids import in_subset
from palimpsest.model import BLOBS_PER_INDEX, BLOBS_PER_PACK, MAX_HOLE, MAX_PACK_SIZE, MAX_READ, PackSizing
from palimpsest.operators.order import numbered
from palimpsest.session import settled

#: Up to about so many rows a fold is one task; beyond, a task for each part of the order that isn't decided as a whole.
FOLD_ROWS = 1 << 18


def target_size(current: Column, sizing: PackSizing) -> Column:
    """How large a pack should be when all packs measure current: the default plus the root of that times a factor, within limits."""
    root = F.floor(F.sqrt(current.cast("double")))
    return F.least(root * sizing.grow_factor + F.lit(sizing.default), F.lit(sizing.limit), F.lit(MAX_PACK_SIZE)).cast("long")


def too_small(size: Column, current: Column, sizing: PackSizing) -> Column:
    return size * 100 < target_size(current, sizing) * sizing.min_percent


def too_large(size: Column, current: Column, sizing: PackSizing) -> Column:
    """Never, where there is no upper tolerance."""
    return F.lit(False) if sizing.max_percent is None else size * 100 > target_size(current, sizing) * sizing.max_percent


def size_ok(size: Column, current: Column, sizing: PackSizing) -> Column:
    return ~too_small(size, current, sizing) & ~too_large(size, current, sizing)


def filled(blobs: DataFrame, writer: str, order: list[str], target: int, most: int = BLOBS_PER_PACK) -> DataFrame:
    """blobs with pack_no (int, from 0 for each writer): a writer closes a pack once it holds most blobs or target bytes.

    A writer's blobs are streamed in order through one task, which holds a batch and three numbers; a null length counts as 0.
    """
    import pyarrow as pa

    rows = blobs.repartition(writer).sortWithinPartitions(writer, *order)
    at_writer, at_length = blobs.columns.index(writer), blobs.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, no, size, n = object(), 0, 0, 0
        for b in batches:
            out = []
            for w, length in zip(b.column(at_writer).to_pylist(), b.column(at_length).to_pylist(), strict=True):
                if w != who:
                    who, no, size, n = w, 0, 0, 0
                out.append(no)
                size, n = size + (length or 0), n + 1
                if n >= most or size >= target:
                    no, size, n = no + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "pack_no"])

    out = rows.mapInArrow(run, StructType([*blobs.schema, StructField("pack_no", IntegerType(), False)]))
    return out.select(writer, *order, *[c for c in blobs.columns if c not in (writer, *order)], "pack_no")


def coalesced(blobs: DataFrame, hole: int = MAX_HOLE, most: int = MAX_READ) -> DataFrame:
    """pack_id, offset, length, blobs: reads that cover the wanted blobs (pack_id, offset, length). A blob joins the read before it if it begins after its end,
    at most hole bytes on, and the whole stays within most. Packs are streamed in order through tasks that hold a batch and one read."""
    import pyarrow as pa

    rows = blobs.select("pack_id", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    rows = rows.repartition("pack_id").sortWithinPartitions("pack_id", "offset", "length")
    names = ["pack_id", "offset", "length", "blobs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for b in batches:
            out = []
            for p, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now and now[0] == p and now[1] + now[2] <= o <= now[1] + now[2] + hole and o + n - now[1] <= most:
                    now[2], now[3] = o + n - now[1], now[3] + 1
                else:
                    out += [now] if now else []
                    now = [p, o, n, 1]
            yield made(out)
        yield made([now] if now else [])

    def made(out: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "pack_id string, offset long, length long, blobs long")


def subset_nm(packs: DataFrame, n: int, m: int) -> DataFrame:
    """Part n of m of packs (id)."""
    return packs.where(in_subset(F.col("id"), n, m))


def subset_size(packs: DataFrame, limit: int | None = None, percent: float | None = None, seed: int = 0, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Packs (id, size) in an order shuffled by seed, taken while they are smaller than what remains of limit bytes, or of percent of all.

    Each choice depends on all before it. The order is cut into parts of about fold_rows packs, of which the driver knows sum and least size: a part that fits as a whole is taken,
    one whose smallest pack doesn't fit is not, and only others are folded, each in a task of its own. Empty packs always fit.
    """
    spark = packs.sparkSession
    if limit is None:
        limit = int((packs.agg(F.sum("size")).first()[0] or 0) * percent / 100.0)
    fitting = packs.where(F.col("size") < limit)
    shuffled = fitting.where("size > 0").withColumn("_order", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256))
    parts = -(-shuffled.count() // fold_rows)
    if parts <= 1:
        return _taken(shuffled, limit).unionByName(fitting.where("size = 0")).select(*packs.columns)
    # The order is that of hashes, so their first 32 bits cut it evenly.
    head = F.coalesce(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(0))
    shuffled = shuffled.withColumn("_part", F.shiftright(head * parts, 32).cast("int"))
    sums = shuffled.groupBy("_part").agg(F.sum("size").alias("total"), F.min("size").alias("least")).collect()  # a row for each part
    whole, folded, rest, left = [], [], limit, shuffled
    for part, total, least in sorted(map(tuple, sums)):
        if total < rest:
            whole.append((part,))
            rest -= total
        elif least < rest:
            if len(folded) == 1:  # a part is read by itself from here on
                left = settled(shuffled.where((F.col("_part") >= part) & (F.col("size") < rest)).repartitionByRange(parts, "_part").sortWithinPartitions("_part"))
            folded.append(settled(_taken(left.where((F.col("_part") == part) & (F.col("size") < rest)).drop("_part"), rest)))
            rest -= folded[-1].agg(F.sum("size")).first()[0] or 0
    out = fitting.where("size = 0")
    if whole:
        out = out.unionByName(shuffled.join(F.broadcast(spark.createDataFrame(whole, "_part int")), "_part").select(*packs.columns))  # at most a row for each part
    for own in folded:
        out = out.unionByName(own)
    return out.select(*packs.columns)


def _taken(shuffled: DataFrame, limit: int) -> DataFrame:
    """What one fold along _order takes, in a task that holds a batch and one number."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = limit
        for pdf in batches:
            kept = []
            for size in pdf["size"].tolist():
                kept.append(rest > size)
                rest -= size * kept[-1]
            yield pdf[kept].drop(columns="_order")

    return shuffled.repartition(1).sortWithinPartitions("_order", "size").mapInPandas(run, shuffled.drop("_order").schema)


def batches(ids: DataFrame, size: int = 1) -> DataFrame:
    """ids with batch: runs of size by id, for requests made together. Null ids come first; repeated ids each count."""
    return numbered(ids, ["id"], "_n").withColumn("batch", F.floor(F.col("_n") / F.lit(size)).cast("long")).drop("_n")


def index_files(packs: DataFrame, writer: str, most: int = BLOBS_PER_INDEX) -> DataFrame:
    """packs (writer, pack_id, blobs) with index_no: a writer starts a new index file once one holds most blobs."""
    rows = packs.withColumn("length", F.col("blobs").cast("long"))
    return filled(rows, writer, ["pack_id"], most, most).drop("length").withColumnRenamed("pack_no", "index_no")
