"""Numbered parts of numpy data through Spark's shuffle.

Rows that are only hashes and positions cost more as rows than they weigh. Workers pack what belongs to one part into one
binary row a batch, and the task that gets a part unpacks it all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "part int, packed binary"


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """A part, 0 to parts - 1, from a hash's high bits."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def by_part(part: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each part that has rows, with its rows of the columns in their order."""
    order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
    columns = [c[order] for c in columns]
    at = 0
    for k, e in enumerate(ends):
        if e > at:
            yield k, [c[at:e] for c in columns]
        at = e


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays with their types and lengths, byte planes apart, so that what varies little packs well."""
    head = [np.array([len(arrays)], np.int64).tobytes()]
    body = []
    for a in arrays:
        head.append(np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], np.int64).tobytes())
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes())
    return b"".join(head + body)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for kind, width, size in head.tolist():
        planes = np.frombuffer(data, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(f"{chr(kind)}{width}")).reshape(size))
        at += width * size
    return out


def rows(packed: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Batches for Spark of (part, arrays)."""
    for part, arrays in packed:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(arrays)], pa.binary())], names=["part", "packed"])


def dealt(packed: DataFrame, parts: int) -> DataFrame:
    """Part k in partition k."""
    return packed.repartitionById(parts, F.col("part")) if hasattr(packed, "repartitionById") else packed.repartition(parts, "part")


def received(batches: Iterator[pa.RecordBatch]) -> list[list[np.ndarray]]:
    """All arrays that a task got, one list a packed row."""
    return [unpack(x) for b in batches for x in b.column(1).to_pylist()]
