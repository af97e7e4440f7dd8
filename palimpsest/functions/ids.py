"""Content ids: lowercase hex strings of 32 bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.model import NULL_ID


def blob_id(content: Column) -> Column:
    """The id of content: its SHA-256."""
    return F.sha2(content, 256)


def is_null_id(i: Column) -> Column:
    return i == F.lit(NULL_ID)


def as_u32(i: Column) -> Column:
    """The first four bytes as a little-endian number."""
    return F.conv(F.concat(*(F.substring(i, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")


def is_id(name: Column) -> Column:
    return F.rlike(name, F.lit("^[0-9a-f]{64}$"))


def is_full_id(text: str) -> bool:
    return bool(re.fullmatch("[0-9a-f]{64}", text))


def in_subset(i: Column, n: int, m: int) -> Column:
    """Whether an id belongs to part n of m. Parts 1 to m hold every id once."""
    return as_u32(i) % F.lit(m) == F.lit(n % m)
