"""Exact top-k by inner product with block-at-a-time pruning.

Components are terms. Vectors, in the order of their ids, fall into blocks; a block keeps its rows as a forward index, and a summary the
largest and smallest value of each of its terms. A query's bound on a block is the sum over terms of its component times the larger in effect of the
two. Summaries are a small part of the vectors (two rows for BLOCK), and queries are held against them in packs. First each query's blocks of
the highest bounds are scored; the k-th score so far is a threshold that holds for the whole corpus. Then only blocks whose bound reaches it are
scored, all others are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions, ship, tidied, written

SCALE = 1024
#: Vectors in a block, blocks in a pack of summaries, queries in a pack, and blocks of a pack of summaries that a query has scored for its threshold.
BLOCK, SUMMARIES, QUERIES, BEST = 128, 512, 64, 3

_PACKED = "part int, at int, ids binary, width int, kind string, matrix binary"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of rows that take part: with an id, a vector, and nothing in it null or not finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact in doubles."""
    return np.floor(SCALE * values)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists; shorter ones end in zeros."""
    n = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = whole(flat)
    return out


def _kind(matrix: np.ndarray) -> str:
    """The narrowest type that holds whole numbers."""
    top = np.abs(matrix).max(initial=0)
    return "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "f8"


def _unpacked(data: bytes, kind: str, width: int, wide: int) -> np.ndarray:
    """Rows as doubles, of wide columns."""
    rows = np.frombuffer(data, kind).reshape(-1, width) if width else np.zeros((0, 0))
    out = np.zeros((len(rows), wide))
    out[:, :width] = rows
    return out


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Runs of size rows by vec_id, their whole components in a narrow type. Vectors without components have a zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= size:
                yield made(part, at, held.slice(0, size))
                held, at = held.slice(size), at + 1
        if held is not None and held.num_rows:
            yield made(part, at, held)

    def made(part: int, at: int, t: pa.Table) -> pa.RecordBatch:
        ids, vectors = (c.combine_chunks() for c in t.columns)
        matrix = _matrix(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors)
        matrix = matrix if matrix.shape[1] else np.zeros((len(matrix), 1))
        kind = _kind(matrix)
        row = [part, at, ids.to_numpy().tobytes(), matrix.shape[1], kind, matrix.astype(kind).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])

    return rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(tidied(run), _PACKED)


def summary(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest value of each term."""
    return matrix.max(axis=0), matrix.min(axis=0)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block no less than any score. Rounding of very large sums must not lose a block."""
    out = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return out + np.abs(out) * 1e-9


def _summarized(blocks: DataFrame) -> DataFrame:
    """Summaries of up to SUMMARIES blocks a row."""
    names = ["parts", "ats", "wide", "kind", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in range(b.num_rows):
                part, at, width, kind, data = (c[r].as_py() for c in b.columns)
                held.append((part, at, *summary(_unpacked(data, kind, width, width))))
                if len(held) == SUMMARIES:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        wide = max(len(h) for *_, h, _ in held)
        # A shorter vector meets longer ones as if it ended in zeros.
        high, low = (np.stack([np.pad(x[i], (0, wide - len(x[i]))) for x in held]) for i in (2, 3))
        kind = max(_kind(high), _kind(low), key=("i2", "i4", "f8").index)
        row = [np.array([x[0] for x in held], np.int32).tobytes(), np.array([x[1] for x in held], np.int32).tobytes(), wide, kind, high.astype(kind).tobytes(), low.astype(kind).tobytes()]
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return blocks.select("part", "at", "width", "kind", "matrix").mapInArrow(tidied(run), "parts binary, ats binary, wide int, kind string, high binary, low binary")


def wanted(queries: np.ndarray, high: np.ndarray, low: np.ndarray, best: int, least: np.ndarray | None) -> np.ndarray:
    """Which blocks each query has scored: without least, those of its best bounds; with it, the others whose bound reaches the query's least score."""
    bound = bounds(queries, high, low)
    first = np.zeros(bound.shape, bool)
    order = np.argsort(-bound, axis=1, kind="stable")[:, :best]
    np.put_along_axis(first, order, True, axis=1)
    return first if least is None else ~first & (bound >= least[:, None])


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products of queries and rows as longs. Doubles do where no sum can reach 2**53; else Python's integers, which fail beyond 64 bits."""
    if np.abs(rows).max(initial=0) * np.abs(queries).sum(axis=1).max(initial=0) < 2**53:
        return (queries @ rows.T).astype(np.int64)
    wholes = [[int(x) for x in r] for r in rows]
    return np.array([[sum(a * b for a, b in zip(r, q, strict=True)) for r in wholes] for q in ([int(x) for x in q] for q in queries)], np.int64).reshape(len(queries), len(rows))


_ASKED = "part int, at int, keys binary, query_ids binary, width int, kind string, matrix binary, least binary"


def _requests(asked: DataFrame, summaries: DataFrame, best: int, second: bool) -> DataFrame:
    """Which queries are to be scored against which block, a row for a pack of queries and a block; from packs of queries with least (keys in their order) and summaries.

    Every pack of the stated queries meets every pack of summaries once, in a grid of cells: packs of one kind are dealt to its rows, of the other to its columns."""
    side = max(1, math.isqrt(partitions(asked.sparkSession)))
    deal = lambda df, c, across: df.withColumn("_own", F.pmod(F.xxhash64(*c), F.lit(side)).cast("int")).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("cell", (F.col("_own") * side + F.col("_x")) if across else (F.col("_x") * side + F.col("_own"))).drop("_own", "_x")
    q = deal(asked.select(F.col("part").alias("qp"), F.col("at").alias("qa"), F.col("ids").alias("qi"), F.col("width").alias("qw"), F.col("kind").alias("qk"), F.col("matrix").alias("qm"), "least"), ["qp", "qa"], True)
    pairs = q.join(deal(summaries, ["parts", "ats"], False), "cell").select("qp", "qa", "qi", "qw", "qk", "qm", "least", "parts", "ats", "wide", "kind", "high", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qp, qa, qi, qw, qk, qm, least, parts, ats, wide, kind, high, low = (c[r].as_py() for c in b.columns)
                ids, span = np.frombuffer(qi, np.int64), max(qw, wide)
                queries = _unpacked(qm, qk, qw, span)
                keys = (qp << 40) + qa * QUERIES + np.arange(len(ids), dtype=np.int64)
                bar = np.frombuffer(least, np.float64) if least else np.full(len(ids), -np.inf)
                mask = wanted(queries, _unpacked(high, kind, wide, span), _unpacked(low, kind, wide, span), best, bar if second else None)
                own = np.frombuffer(qm, qk).reshape(len(ids), qw)
                hit = np.flatnonzero(mask.any(axis=0))
                for at in range(0, len(hit), 64):
                    rows = [(own[mask[:, j]], mask[:, j], j) for j in hit[at : at + 64].tolist()]
                    cols = [
                        [int(np.frombuffer(parts, np.int32)[j]) for *_, j in rows], [int(np.frombuffer(ats, np.int32)[j]) for *_, j in rows], [keys[m].tobytes() for _, m, _ in rows], [ids[m].tobytes() for _, m, _ in rows],
                        [qw] * len(rows), [qk] * len(rows), [np.ascontiguousarray(x).tobytes() for x, *_ in rows], [bar[m].tobytes() for _, m, _ in rows],
                    ]
                    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _ASKED.split(", ")])

    return pairs.mapInArrow(tidied(run), _ASKED)


def _scored(requests: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """key, query_id, vec_id, score: of each request the best k rows of its block for each query, none below the query's least score."""
    names = ["keys", "query_ids", "qw", "qk", "qm", "least", "ids", "width", "kind", "matrix"]
    asked = requests.select(F.col("part").alias("p"), F.col("at").alias("a"), "keys", "query_ids", F.col("width").alias("qw"), F.col("kind").alias("qk"), F.col("matrix").alias("qm"), "least")
    rows = asked.join(blocks, (F.col("p") == F.col("part")) & (F.col("a") == F.col("at"))).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, query_ids, vec_ids, scores = [], [], [], []
            for r in range(b.num_rows):
                own_keys, own_ids, qw, qk, qm, least, ids, width, kind, matrix = (c[r].as_py() for c in b.columns)
                own_keys, own_ids, ids, span = np.frombuffer(own_keys, np.int64), np.frombuffer(own_ids, np.int64), np.frombuffer(ids, np.int64), max(qw, width)
                s = products(_unpacked(matrix, kind, width, span), _unpacked(qm, qk, qw, span))
                good = (own_ids[:, None] != ids[None, :]) & (s >= np.frombuffer(least, np.float64)[:, None])
                i, j = np.nonzero(good)
                v, x = s[i, j], ids[j]
                order = np.lexsort((x, -v, i))
                i, v, x = i[order], v[order], x[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                keep = nth < k
                keys.append(own_keys[i[keep]])
                query_ids.append(own_ids[i[keep]])
                vec_ids.append(x[keep])
                scores.append(v[keep])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, query_ids, vec_ids, scores)], names=["key", "query_id", "vec_id", "score"])

    return rows.mapInArrow(tidied(run), "key long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, best: int = BEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The result of top_k(); and requests of the first and second wave, tables of packs of queries (keys, 8 bytes each) and the block (part, at) they were scored against."""
    ship(vectors.sparkSession)
    asked = written(_packed(valid(queries), QUERIES), "queries")
    blocks = written(_packed(valid(vectors), BLOCK), "vectors")
    summaries = written(_summarized(blocks), "summaries")
    first = written(_requests(asked.withColumn("least", F.lit(None).cast("binary")), summaries, best, False), "requests")
    found = written(_ranked(_scored(first, blocks, k), k), "found")
    # The k-th score of each query, if it has so many, in its pack's order: at most QUERIES rows a pack.
    bars = found.where(F.col("rank") == k).select(F.shiftright("key", 40).cast("int").alias("bp"), F.col("key").bitwiseAND(F.lit((1 << 40) - 1)).alias("n"), "score")
    bars = bars.select("bp", F.floor(F.col("n") / QUERIES).cast("int").alias("ba"), (F.col("n") % QUERIES).cast("int").alias("line"), "score").groupBy("bp", "ba").agg(F.collect_list(F.struct("line", "score")).alias("bars"))
    least = asked.join(bars, (F.col("part") == F.col("bp")) & (F.col("at") == F.col("ba")), "left").select(*asked.columns, "bars")

    columns = asked.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ids, own in zip(b.column("ids").to_pylist(), b.column("bars").to_pylist(), strict=True):
                bar = np.full(len(ids) // 8, -np.inf)
                for x in own or ():
                    # A double below a whole number that it can't hold: nothing that ties is lost.
                    near = float(x["score"])
                    bar[x["line"]] = near if int(near) <= x["score"] else np.nextafter(near, -np.inf)
                out.append(bar.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.binary())], names=[*columns, "least"])

    least = least.mapInArrow(tidied(packed), f"{_PACKED}, least binary")
    second = written(_requests(least, summaries, best, True), "requests")
    every = found.drop("rank").unionByName(_scored(second, blocks, k))
    return _ranked(every, k).select("query_id", "rank", "vec_id", "score"), first, second


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k highest integer inner products with rows of vectors.

    Both have vec_id and embedding; components count as floor(1024 * x). Rows without an id or vector, or with a null or non-finite component,
    take no part. Rows with the query's id are its own and no candidates. Ties go to the smaller vec_id; repeated rows
    each count; vectors of different lengths meet as if the shorter ended in zeros; a query with fewer candidates gets all; no
    queries or no candidates: no rows; other columns are not read. Scores must fit a long.

    Only summaries of blocks meet all queries. A block is sent the queries that want it, in packs; no more than k rows a query and block go on to the ranking.
    """
    return search(vectors, queries, k)[0]
