"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard follows from the key and the number of shards alone; there is no ring table. Going from n to
n + 1 shards moves 1 / (n + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

# Multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _advance(x: Column) -> Column:
    """x * MULTIPLIER + 1 modulo 2**64 on signed longs, from 32 and 16 bit halves so that nothing overflows."""
    a_high, a_low = MULTIPLIER >> 32, MULTIPLIER & _LOW
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)

    def halves(v: Column, c: int) -> tuple[Column, Column]:
        return v * F.lit(c & 0xFFFF), v * F.lit(c >> 16)

    t0, t1 = halves(low, a_low)
    s = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftrightunsigned(s, 32) + F.shiftrightunsigned(t1, 16)

    def cross(v: Column, c: int) -> Column:
        l, h = halves(v, c)
        return (l + F.shiftleft(h.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))

    top = (carry + cross(high, a_low) + cross(low, a_high)).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(top, 32).bitwiseOR(s.bitwiseAND(F.lit(_LOW)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key. A null key counts as 0.

    A key jumps forward at most once for each shard, so the loop is a fold over a constant number of steps.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(acc: Column, _: Column) -> Column:
        state = _advance(acc["state"])
        at = (F.lit(2147483648.0) / (F.shiftrightunsigned(state, 33) + F.lit(1)).cast("double")) * (acc["next"] + F.lit(1)).cast("double")
        # Jumps beyond any shard number are cut, for the cast's sake.
        there = F.least(at, F.lit(4e9)).cast("long")
        on = acc["next"] < F.lit(shards)
        return F.struct(
            F.when(on, state).otherwise(acc["state"]).alias("state"),
            F.when(on, acc["next"]).otherwise(acc["shard"]).alias("shard"),
            F.when(on, there).otherwise(acc["next"]).alias("next"),
        )

    start = F.struct(F.coalesce(key.cast("long"), F.lit(0)).cast("long").alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    # The first step visits shard 0; every further one a larger number, so shards + 1 steps reach the end.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda acc: acc["shard"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 16, cells: int = 1024) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1; a null text has 0 bytes and the checksum of an empty one. A null doc_id
    is kept and hashed as 0. Repeated rows each get a slot of their own; which of two equal rows comes first is
    not visible. No rows: no rows. Other columns of docs are not read.

    Slots run from 0 without gaps in each shard. They are numbered in two levels, so no task sorts a whole shard:
    rows fall into cells by doc_id and checksum, one small table holds the rows of each cell, and a row's slot is the
    number of rows in its shard's earlier cells plus its place in its own cell.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(cells)) * 31 + F.col("text_crc32"), F.lit(cells)).cast("int").alias("cell"),
    )
    rows = written(rows, "shards")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.join(starts, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + place).alias("slot"), "grown_shard")
