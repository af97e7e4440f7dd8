"""Texts to token ids through a table of chunks, for tokenizers that split with the GPT-2 pattern.

The pattern never joins what stands before a single space between two other characters with what follows, so texts
are cut there and a chunk's ids are looked up; only chunks not yet in the table are encoded. Texts in which a space
touches other white space are cut by the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids of many chunks, one after the other, and how many each has.
Ids = tuple[np.ndarray, np.ndarray]
#: Ids of many chunks in any order, where each chunk's start, and how many it has.
Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> Ids:
    """Rows of a ragged table, one after the other, and their lengths."""
    n = lengths[rows]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[rows] - (ends - n), n)], n


def _unspaced(parts: pa.StringArray) -> list[str]:
    """Strings without spaces as a list, made of one string, which takes a sixth of the time."""
    if not len(parts):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), " ")[0].as_py().split(" ")


class _Keys(dict):
    """Chunk to row. If strict, chunks around which cutting isn't safe have row -1."""

    def __init__(self, table: ChunkTable, strict: bool):
        super().__init__()
        self.table, self.strict = table, strict

    def rows(self, parts: list[str]) -> np.ndarray:
        """Rows of parts; those not yet known get the next ones and wait to be encoded."""
        found = np.fromiter(map(self.get, parts, repeat(-2)), np.int64, len(parts))
        missing = np.flatnonzero(found == -2)
        if len(missing):
            each = [parts[i] for i in missing.tolist()]
            new = dict.fromkeys(each)
            if self.strict:
                bare = map(str.rstrip, new)
                odd = dict.fromkeys([p for p, q in zip(new, bare, strict=True) if p != q or not p], -1)
                self.update(odd)
                new = [p for p in new if p not in odd]
            at = self.table.rows + len(self.table.pending)
            self.update(zip(new, range(at, at + len(new)), strict=True))
            self.table.pending += new
            found[missing] = np.fromiter(map(self.__getitem__, each), np.int64, len(each))
        return found


class ChunkTable:
    """encode: from chunks to a Table. split: a text's pieces by the pattern. limit, most: the table starts anew beyond so many chunks, or bytes of them."""

    def __init__(self, encode: Callable[[list[str]], Table], split: Callable[[str], list[str]], limit: int = 400_000, most: int = 256 << 20):
        self.encode_chunks, self.split, self.limit, self.most = encode, split, limit, most
        self.clear()

    def clear(self) -> None:
        self.rows, self.pending = 0, []
        self.first, self.piece = _Keys(self, True), _Keys(self, False)
        # Chunks that a space stands before, without it, and their rows: by far the most, and as Arrow strings a tenth of what a dict takes.
        self.known, self.known_rows = None, np.empty(0, np.int64)
        self.flat, self.starts, self.lengths = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = 0

    def rest(self, parts: pa.StringArray) -> np.ndarray:
        """Rows of different parts, each after a space. Those not yet known get the next ones and wait to be encoded; those around which cutting isn't safe have row -1."""
        if self.known is None:
            self.known = parts.slice(0, 0)
        at = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy()
        missing = np.flatnonzero(at < 0)
        rows = np.empty(len(parts), np.int64)
        rows[at >= 0] = self.known_rows.take(at[at >= 0])
        if len(missing):
            new = parts.take(pa.array(missing))
            each = _unspaced(new)
            size, bare = (np.fromiter(map(len, x), np.int64, len(each)) for x in (each, map(str.strip, each)))
            safe = (size == bare) & (size > 0)
            rows[missing] = np.where(safe, self.rows + len(self.pending) + np.cumsum(safe) - 1, -1)
            self.pending += map(" ".__add__, compress(each, safe.tolist()))
            self.known, self.known_rows = pa.concat_arrays([self.known, new]), np.concatenate([self.known_rows, rows[missing]])
        return rows

    def resolve(self) -> None:
        if not self.pending:
            return
        flat, starts, lengths = self.encode_chunks(self.pending)

        def put(name: str, at: int, new: np.ndarray) -> None:
            old = getattr(self, name)
            if at + len(new) > len(old):
                grown = np.empty(2 * (at + len(new)), old.dtype)
                grown[:at] = old[:at]
                setattr(self, name, old := grown)
            old[at : at + len(new)] = new

        put("flat", self.used, flat)
        put("starts", self.rows, self.used + starts)
        put("lengths", self.rows, lengths)
        self.used, self.rows, self.pending = self.used + len(flat), self.rows + len(lengths), []

    def encode(self, texts: pa.StringArray) -> Ids:
        """Ids of all texts, one after the other, and the number of each text's. Nulls have none."""
        parts = list(self.encode_runs(texts))
        return (np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))

    def encode_runs(self, texts: pa.StringArray, most: int = 1 << 18) -> Iterator[Ids]:
        """The same for runs of texts of about so many chunks. Chunks are looked up for all texts together, each different one once."""
        if self.rows > self.limit or self.known is not None and self.known.nbytes > self.most:
            self.clear()
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        parts = cut.flatten().dictionary_encode()
        ends = np.cumsum(cut.value_lengths().to_numpy())
        starts = np.concatenate(([0], ends[:-1]))
        # Each different part is looked up once; what starts a text, again as such.
        rows = self.rest(parts.dictionary)[parts.indices.to_numpy()]
        rows[starts] = self.first.rows(parts.take(pa.array(starts)).to_pylist())
        counts = ends - starts
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(rows < 0), "right"))
        if len(odd):
            each = np.split(rows, ends[:-1])
            for i in odd.tolist():
                each[i] = self.piece.rows(self.split(texts[i].as_py() or ""))
            rows, counts = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        self.resolve()
        ends, at = np.cumsum(counts), 0
        while at < len(ends):
            first = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, first + most, "right")))
            flat, n = gather(self.flat, self.starts, self.lengths, rows[first : ends[to - 1]])
            yield flat, np.diff(np.concatenate(([0], np.cumsum(n)))[ends[at:to] - first], prepend=0)
            at = to


def runs(column: pa.StringArray, most: int = 32 << 20) -> Iterator[pa.StringArray]:
    """A column in slices of about so many bytes; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield column.slice(at, to - at)
        at = to
