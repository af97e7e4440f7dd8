"""Snapshots that arrive as a stream of files, kept as a table with one row for each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def into_table(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append rows of a stream (id, ...) whose ids the Parquet table lacks; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates(["id"])
        try:
            held = spark.read.schema(batch.schema).parquet(table)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = None
        (rows if held is None else rows.join(held.select("id"), "id", "left_anti")).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
