"""Numbers along a global order, without a task that sees all rows.

Rows are dealt by ranges of the order and numbered within their range; what comes before a range is a sum over a table with a row
for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from palimpsest.session import settled


def ranged(df: DataFrame, order: list[Column | str], parts: int | None = None, between: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """df, settled, by ranges of order: _id, whose upper bits are the range (_part) and whose lower ones count its rows along order (_at). parts: how many ranges;
    between: applied to ranges in their order, row by row."""
    ranged = df.repartition(1) if parts == 1 else df.repartitionByRange(*(() if parts is None else (parts,)), *order)
    rows = settled(between(ranged.sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})


def of_part(rows: DataFrame, part: int) -> DataFrame:
    """One range of ranged(); others aren't read."""
    return rows.where((F.col("_id") >= F.lit(part << 33)) & (F.col("_id") < F.lit((part + 1) << 33)))


def numbered(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """df with a number from 0 along order. Rows that order doesn't tell apart are numbered in any order among themselves; nulls come first
    unless order says otherwise."""
    rows = ranged(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_of"), before.alias("_start"))  # a row for each partition of the write above
    return rows.join(F.broadcast(starts), F.col("_part") == F.col("_of")).withColumn(name, F.col("_start") + F.col("_at")).select(*df.columns, name)


def numbered_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "n") -> DataFrame:
    """df with a number from 0 along order within each group of keys, however large a group is."""
    rows = numbered(df, [*keys, *order], "_n")
    firsts = rows.groupBy(*keys).agg(F.min("_n").alias("_first"))
    same = F.lit(True)
    there = firsts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_first")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(there, same).withColumn(name, F.col("_n") - F.col("_first")).select(*df.columns, name)


def with_previous(df: DataFrame, order: list[Column | str], columns: list[str]) -> DataFrame:
    """df with _c for each column c: its value in the row before, null in the first. Values are shifted within ranges of order; the first row of a range gets what the last row before it has."""
    import pyarrow as pa

    at = [df.columns.index(c) for c in columns]

    def run(batches):
        last = None
        for b in batches:
            if b.num_rows:
                own = [b.column(i) for i in at]
                before = [pa.nulls(1, x.type) if last is None else y for x, y in zip(own, last or own, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.concat_arrays([y, x.slice(0, b.num_rows - 1)]) for x, y in zip(own, before, strict=True))], names=[*b.schema.names, *(f"_{c}" for c in columns)])
                last = [pa.concat_arrays([x.slice(b.num_rows - 1)]) for x in own]

    schema = StructType([*df.schema, *(StructField(f"_{c}", df.schema[c].dataType) for c in columns)])
    rows = ranged(df, order, between=lambda x: x.mapInArrow(run, schema))
    ends = rows.groupBy("_part").agg(F.max_by(F.struct(*columns), "_at").alias("_end"))
    ends = ends.select((F.col("_part")).alias("_of"), F.lag("_end").over(Window.orderBy("_part")).alias("_end"))  # a row for each partition of the write above
    rows = rows.join(F.broadcast(ends), (F.col("_part") == F.col("_of")) & (F.col("_at") == 0), "left")
    return rows.select(*df.columns, *(F.when(F.col("_at") == 0, F.col("_end")[c]).otherwise(F.col(f"_{c}")).alias(f"_{c}") for c in columns))
