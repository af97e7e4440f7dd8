"""Sources of entries that users plug in, as a Spark data source.

A source is a class with parts(), which names its parts, and entries(part), which yields tuples of SCHEMA; tasks read a part each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, type string, size long, mtime timestamp, content binary"


class Entries:
    """What a source has to offer; subclasses replace both methods."""

    def parts(self) -> Sequence[str]:
        return [""]

    def entries(self, part: str) -> Iterator[tuple]:
        raise NotImplementedError


class _Part(InputPartition):
    def __init__(self, name: str):
        self.name = name


def read(spark: SparkSession, source: Entries, name: str = "entries") -> DataFrame:
    """The entries of a source as a DataFrame; content is read where and when a task needs it."""

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return [_Part(p) for p in source.parts()]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return iter(source.entries(partition.name))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"palimpsest_{name}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    from palimpsest.session import ship

    ship(spark)
    spark.dataSource.register(Source)
    return spark.read.format(f"palimpsest_{name}").load()
