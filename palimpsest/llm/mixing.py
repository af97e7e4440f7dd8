"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import count_words, written

# Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources take the weights in turn, by code point, null last. Their targets sum to share of all sizes, in
    proportion to the weights, but stop at most times a source's size; what is above is shared again by weight.
    That ends where target = least(most * size, level * weight) for one level, found by sorting sources by
    size / weight: those before the first that the level doesn't fill stay at their limit. The table has a row for each source.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    rows = totals.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything, before = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
        (most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("full"),
        F.row_number().over(by).alias("k"),
    )
    level = (share * F.col("all_size") - F.col("full")) / F.col("left_weight")
    rows = rows.select("*", level.alias("level"), (most * F.col("source_size") >= level * F.col("weight")).alias("open"))
    first = F.min(F.when(F.col("open"), F.struct("k", "level"))).over(Window.partitionBy())
    rows = rows.select("*", first.alias("at"))
    cap = (most * F.col("source_size")).cast("double")
    target = F.when(F.col("at").isNull() | (F.col("k") < F.col("at.k")), cap).otherwise(F.least(cap, F.col("at.level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def sampled(docs: DataFrame, seed: int = 1, cells: int = 64, **rules) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source).

    Every document of a source expects target / source_size copies. Documents of a source stand in a row, by size
    class (quarter powers of two) so that all sizes are met evenly; the expectations are summed along it, one
    random offset is added for the source, and a document is emitted once for each integer that the sum crosses in
    it. The offset depends on seed and source alone: reruns agree.

    As expectations are equal within a source, a sum is a rank times target / source_size. Ranks come from two levels,
    a small table of counts by source, class and cell and a rank in the cell, so no task sorts a whole source. Null
    texts have size 0, null sources are one source, null ids are kept, repeated rows stand apart, no rows give no
    rows; other columns are not read. A source without any word gets no copies.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"))
    rows = rows.select(
        "*",
        F.when(F.col("size") > 0, F.floor(4 * F.log2("size"))).otherwise(-1).cast("int").alias("class"),
        F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(cells)).cast("int").alias("cell"),
    )
    rows = written(rows, "sizes")
    counts = rows.groupBy("source", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    aims = targets(counts.groupBy("source").agg(F.sum("s").alias("source_size")), **rules)
    before = Window.partitionBy("source").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("of"), F.col("class").alias("c"), F.col("cell").alias("e"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    cells_ = starts.join(aims, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    place = F.row_number().over(Window.partitionBy("source", "class", "cell").orderBy("size", "doc_id"))
    ranked = rows.withColumn("place", place)
    ranked = ranked.join(cells_, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("c")) & (F.col("cell") == F.col("e")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\x00")))), 1, 8), 16, 10).cast("double")
    offset, rank = digits / F.lit(4294967296.0), F.col("first") + F.col("place")
    copies = F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)
    out = ranked.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
