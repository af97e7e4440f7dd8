"""Schemas of the store's tables, fixed values of its formats, and option objects."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values of the formats.
NULL_ID = "0" * 64
FILE_TYPES = ("key", "snapshot", "index", "pack")
BLOB_TYPES = ("tree", "data")
OVERHEAD = 32
HEADER_LENGTH = 4
ENTRY_PLAIN = 37
ENTRY_COMPRESSED = 41
MAX_PACK_SIZE = 4076 * 1024 * 1024
MAX_HOLE = 256 * 1024
MAX_READ = 40 * 1024 * 1024
BLOBS_PER_PACK = 10_000
BLOBS_PER_INDEX = 50_000
KIB, MIB = 1024, 1024 * 1024

NODE = "name string, type string, size long, mtime timestamp, ctime timestamp, atime timestamp, mode int, uid int, gid int, user string, group string, inode long, device_id long, links long, content array<string>, subtree string"
SNAPSHOTS = (
    "id string, time timestamp, time_local timestamp_ntz, tree string, parent string, parents array<string>, label string, paths array<string>, hostname string, "
    "username string, uid int, gid int, tags array<string>, original string, delete_kind string, delete_after timestamp, description string, program_version string"
)
TREE_NODES = f"tree_id string, pos int, {NODE}"
INDEX_BLOBS = "index_id string, pack_id string, to_delete boolean, pack_time timestamp, blob_pos int, blob_id string, blob_type string, offset long, length long, uncompressed_length long"
FILES = "tpe string, id string, size long"


@dataclass(frozen=True)
class PackSizing:
    """How large packs should become as the store grows."""

    default: int = 32 * MIB
    grow_factor: int = 32
    limit: int = MAX_PACK_SIZE
    min_percent: int = 30
    max_percent: int | None = None


TREE_SIZING, DATA_SIZING = PackSizing(4 * MIB), PackSizing(32 * MIB)


@dataclass(frozen=True)
class Config:
    """Settings of a store; apply() checks changes before it takes them."""

    version: int = 2
    chunker: str = "rabin"
    chunk_size: int = MIB
    chunk_min_size: int = 512 * KIB
    chunk_max_size: int = 8 * MIB
    chunker_polynomial: int = 0x3DA3358B4DC173
    append_only: bool = False
    compression: int | None = None
    tree_sizing: PackSizing = field(default=TREE_SIZING)
    data_sizing: PackSizing = field(default=DATA_SIZING)

    def apply(self, **changes) -> Config:
        new = replace(self, **changes)
        if new.version not in (1, 2):
            raise ValueError("version must be 1 or 2")
        if new.version < self.version:
            raise ValueError("the version can't be lowered")
        if new.version == 1 and new.compression:
            raise ValueError("compression needs version 2")
        if new.compression is not None and not -7 <= new.compression <= 22:
            raise ValueError("compression levels run from -7 to 22")
        if new.chunker not in ("rabin", "fixed"):
            raise ValueError("chunkers are rabin and fixed")
        if new.chunker == "rabin" and new.chunk_size & (new.chunk_size - 1):
            raise ValueError("the chunk size must be a power of two")
        if new.chunker == "rabin" and not new.chunk_min_size <= new.chunk_size <= new.chunk_max_size:
            raise ValueError("chunk sizes must be in order")
        for s in (new.tree_sizing, new.data_sizing):
            if s.min_percent > 100 or (s.max_percent is not None and s.max_percent < 100):
                raise ValueError("tolerances must enclose 100 percent")
        return new


def guard(config: Config, what: str) -> None:
    """Operations that take something away are refused on an append-only store."""
    if config.append_only:
        raise PermissionError(f"{what} isn't allowed on an append-only store")
