"""Cutting content into chunks, and finding content again through its chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.ids import blob_id
from palimpsest.model import KIB, MIB
from palimpsest.session import ship

#: The irreducible polynomial of the rolling hash, unless a store has its own, and the hash's window in bytes.
POLYNOMIAL, WINDOW = 0x3DA3358B4DC173, 64
#: So many windows are hashed at a time, and so many chunks handed on: what a task holds besides its batch and one file.
BLOCK, ROWS = 1 << 18, 1 << 13


def fixed(files: DataFrame, size: int, key: str = "path", content: str = "content") -> DataFrame:
    """key, pos, offset, length, blob_id, chunk: pieces of size bytes (or characters, for strings), the last may be shorter. Empty content has none."""
    n = F.length(content)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = files.select(key, F.col(content), F.posexplode(starts).alias("pos", "offset"))
    chunk = F.substring(F.col(content), F.col("offset") + 1, F.lit(size))
    return rows.select(key, "pos", F.col("offset").cast("long").alias("offset"), F.length(chunk).cast("long").alias("length"), blob_id(chunk).alias("blob_id"), chunk.alias("chunk"))


def _reduce(x: int, poly: int) -> int:
    """x modulo poly, both polynomials over GF(2)."""
    while (d := x.bit_length() - poly.bit_length()) >= 0:
        x ^= poly << d
    return x


@lru_cache(4)
def _tables(poly: int) -> np.ndarray:
    """For each place in the window, counted from its end, what each byte adds to the hash."""
    out = np.empty((WINDOW, 256), np.uint64)
    for j in range(WINDOW):
        bits = [_reduce(1 << (8 * j + k), poly) for k in range(8)]
        for b in range(256):
            v = 0
            for k in range(8):
                v ^= bits[k] * (b >> k & 1)
            out[j, b] = v
    return out


def check_sizes(size: int, least: int, most: int) -> None:
    if size < 1 or size & (size - 1) or not WINDOW <= least <= size <= most:
        raise ValueError("size must be a power of two between least and most, and least no smaller than the window")


def cuts(data: bytes, size: int = MIB, least: int = 512 * KIB, most: int = 8 * MIB, poly: int = POLYNOMIAL) -> list[int]:
    """Ends of content-defined chunks. A chunk ends where, at least `least` bytes on, the hash of the last WINDOW bytes is 0 in its low bits, or after `most`.

    The hash of a window depends on its bytes alone, so all of a block are computed at once; only the choice of ends goes from left to right.
    """
    check_sizes(size, least, most)
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw, tables = np.frombuffer(data, np.uint8), _tables(poly)
    ends = []
    for at in range(0, n - WINDOW + 1, BLOCK):
        m = min(BLOCK, n - WINDOW + 1 - at)
        h = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            first = at + WINDOW - 1 - j
            h ^= tables[j][raw[first : first + m]]
        ends.append(np.flatnonzero(h & np.uint64(size - 1) == 0) + (WINDOW + at))
    ends = np.concatenate(ends)
    out, start = [], 0
    while n - start > least:
        k = int(np.searchsorted(ends, start + least))
        stop = min(int(ends[k]) if k < len(ends) else n, start + most, n)
        out.append(stop)
        start = stop
    return out + ([n] if start < n else [])


def content_defined(files: DataFrame, key: str = "path", content: str = "content", **options: int) -> DataFrame:
    """key, pos, offset, length, blob_id of content-defined chunks of binary content. options: see cuts(); null and empty content has no chunks."""
    import hashlib

    import pyarrow as pa

    check_sizes(*(options.get(k, v) for k, v in (("size", MIB), ("least", 512 * KIB), ("most", 8 * MIB))))

    ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, content in enumerate(b.column(1)):
                data, start = content.as_py() or b"", 0
                for pos, stop in enumerate(cuts(data, **options)):
                    rows.append((i, pos, start, stop - start, hashlib.sha256(memoryview(data)[start:stop]).hexdigest()))
                    start = stop
                    if len(rows) == ROWS:
                        yield made(b.column(0), rows)
                        rows = []
            yield made(b.column(0), rows)

    def made(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        at, *rest = (pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))
        return pa.RecordBatch.from_arrays([keys.take(at), *rest], names=[key, "pos", "offset", "length", "blob_id"])

    return files.select(key, F.col(content).cast("binary").alias(content)).mapInArrow(run, f"{key} {kind}, pos int, offset long, length long, blob_id string")


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """chunks, distinct_chunks, bytes, distinct_bytes."""
    each = chunks.groupBy("blob_id").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    return each.agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("distinct_bytes"))


def content_offsets(nodes: DataFrame, lengths: DataFrame, key: str = "path") -> DataFrame:
    """key, pos, blob_id, start, length: where each blob of a file's content lies in it. lengths: blob_id, length."""
    each = nodes.select(key, F.posexplode("content").alias("pos", "blob_id")).join(lengths.select("blob_id", "length"), "blob_id")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(key, "pos", "blob_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"), "length")


def read_at(offsets: DataFrame, first: int, n: int) -> DataFrame:
    """Blobs that hold bytes first to first + n of each file, with skip and take: the part of the blob to read."""
    end = F.col("start") + F.col("length")
    rows = offsets.where((F.col("start") < first + n) & (end > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    return rows.withColumn("skip", skip).withColumn("take", F.least(end, F.lit(first + n)) - F.col("start") - F.col("skip"))


def dumped(nodes: DataFrame, chunks: DataFrame, key: str = "path") -> DataFrame:
    """key, content: each file put together from chunks (blob_id, chunk)."""
    each = nodes.select(key, F.posexplode("content").alias("pos", "blob_id")).join(chunks.select("blob_id", "chunk").dropDuplicates(["blob_id"]), "blob_id")
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "").alias("content"))
