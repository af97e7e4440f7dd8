"""Byte-level BPE from a file of ranks: encoding and decoding.

A piece's merges are found with a segment tree over its byte positions. The leaf of a live position holds the rank
of the pair it forms with its next live neighbour, every node the least rank below it, so the root shows the lowest rank
and a descent that prefers the left child finds its leftmost place. A merge updates three leaves and their paths to
the root. Many short pieces are merged together, as rows of one array; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import ship, tidied
from palimpsest.llm.pieces import ChunkTable, Ids, Table, runs

NONE = np.int32(2**31 - 1)
LONG = 256


class Ranks:
    """A vocabulary: token bytes by rank, and which pairs of tokens merge into which."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = dict(zip(self.rank.values(), self.rank.keys(), strict=True))
        self.width = 1 + max(self.token)
        self.pair: dict[int, int] = {}
        for whole, r in self.rank.items():
            for i in range(1, len(whole)):
                a, b = self.rank.get(whole[:i]), self.rank.get(whole[i:])
                if a is not None and b is not None:
                    self.pair[a * self.width + b] = r
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        keys = np.array(list(self.pair), np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(self.pair.values()), np.int32)[order]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they don't merge or one is negative."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], NONE)


def merge_long(ranks: Ranks, piece: bytes) -> list[int]:
    """The ids of one piece, by a tree of its own."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ids, after, before = [int(ranks.byte[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
    none, pair, width = int(NONE), ranks.pair, ranks.width
    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pair.get(ids[i] * width + ids[i + 1], none)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while (rank := tree[1]) != none:
        k = 1
        while k < size:
            k = 2 * k + (tree[2 * k] != rank)
        i = k - size
        j = after[i]
        ids[i], after[i], ids[j] = rank, after[j], -1
        put(j, none)
        if after[i] < n:
            before[after[i]] = i
            put(i, pair.get(rank * width + ids[after[i]], none))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], pair.get(ids[before[i]] * width + rank, none))
    return [x for x in ids if x >= 0]


def merge_rows(ranks: Ranks, pieces: list[bytes], size: int) -> Ids:
    """The ids of pieces of at most size bytes (a power of two), all trees advancing together."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    ids = np.full((n, size), -1, np.int32)
    ids[np.arange(size) < lengths[:, None]] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.minimum(np.arange(1, size + 1)[None, :], lengths[:, None]).astype(np.int32)
    before = np.broadcast_to(np.arange(-1, size - 1, dtype=np.int32), (n, size)).copy()
    tree = np.full((n, 2 * size), NONE, np.int32)
    tree[:, size : 2 * size - 1] = ranks.pairs(ids[:, :-1], ids[:, 1:])
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    live = np.arange(n)

    def put(rows: np.ndarray, at: np.ndarray, rank) -> None:
        k = at + size
        tree[rows, k] = rank
        for _ in range(size.bit_length() - 1):
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    while len(live := live[tree[live, 1] != NONE]):
        rank, k = tree[live, 1], np.ones(len(live), np.int64)
        for _ in range(size.bit_length() - 1):
            k = 2 * k + (tree[live, 2 * k] != rank)
        i = k - size
        j = after[live, i]
        ids[live, i], ids[live, j] = rank, -1
        beyond = after[live, j]
        after[live, i] = beyond
        more = beyond < lengths[live]
        before[live[more], beyond[more]] = i[more]
        put(live, j, NONE)
        put(live, i, np.where(more, ranks.pairs(rank, ids[live, np.where(more, beyond, 0)]), NONE))
        prior = before[live, i]
        r, p = live[prior >= 0], prior[prior >= 0]
        put(r, p, ranks.pairs(ids[r, p], rank[prior >= 0]))
    kept = ids >= 0
    return ids[kept], kept.sum(axis=1)


class Codec:
    """encode(texts) and decode(ids), as the ranks and the pattern say."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.split = Ranks(path), regex.compile(pattern).findall
        self.table = ChunkTable(self._chunks, self.split, limit=200_000)
        self.names = [str(i) for i in range(self.ranks.width)]

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. A piece that is itself a token is that token."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            r = self.ranks.rank.get(p)
            if r is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONG:
                out[i] = np.array(merge_long(self.ranks, p), np.int32)
            else:
                groups.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for size, own in groups.items():
            step = max(1, (1 << 19) // size)
            for at in range(0, len(own), step):
                some = own[at : at + step]
                flat, n = merge_rows(self.ranks, [pieces[i] for i in some], size)
                for i, x in zip(some, np.split(flat, np.cumsum(n)[:-1]), strict=True):
                    out[i] = x
        return out

    def _chunks(self, chunks: list[str]) -> Table:
        cut = [self.split(c) for c in chunks]
        row: dict[str, int] = {}
        rows = [[row.setdefault(p, len(row)) for p in x] for x in cut]
        ids = self.pieces([p.encode() for p in row])
        flat = [ids[r] for x in rows for r in x]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        lengths = np.array([sum(size[r] for r in x) for x in rows], np.int64)
        return np.concatenate(flat) if flat else np.empty(0, np.int32), np.cumsum(lengths) - lengths, lengths

    def encode(self, texts: pa.StringArray) -> Ids:
        return self.table.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs (doc_id, text).

    Null and empty texts have no ids; null ids and repeated rows are kept; no rows: no rows; other columns are not
    read. Special tokens have no meaning: their strings are ordinary text. path: a file of base64 tokens and ranks;
    it must exist on every executor.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids, i = b.column(0), 0
            for texts in runs(b.column(1), 1 << 20):
                flat, n = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(texts)), lists], names=["doc_id", "ids"])
                i += len(texts)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary) and text of each row of encoded (doc_id, ids); text is null where the bytes are not UTF-8, which
    ids from encode() never give. Null ids decode to nothing."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            found = [own.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    out = encoded.selectExpr("CAST(doc_id AS long) AS doc_id", "ids").mapInArrow(tidied(run), "doc_id long, bytes binary")
    return out.selectExpr("doc_id", "bytes", "CASE WHEN is_valid_utf8(CAST(bytes AS string)) THEN CAST(bytes AS string) END AS text")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs: encode() and decode() in one pass, only digests leaving the worker."""
    import hashlib

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            counts, digests, decoded = [], [], []
            for flat, n in (x for texts in runs(b.column(1), 1 << 20) for x in own.table.encode_runs(texts)):
                ends = np.cumsum(n)
                for k, e in zip(n.tolist(), ends.tolist(), strict=True):
                    ids = flat[e - k : e].tolist()
                    counts.append(k)
                    digests.append(hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
