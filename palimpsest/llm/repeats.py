"""Exact repeats of word runs across documents, found by fixed-block anchors.

Every document is cut into blocks of BLOCK words, and the blocks are indexed. The index is probed with every rolling run of as many
words. A run of WINDOW = 2 * BLOCK - 1 words holds a whole block wherever it starts, so if it also stands in an earlier document
(one with a smaller doc_id), one of its rolling runs hits a block of that document. Around hits, and only there, runs of
WINDOW words are compared; those that also start in an earlier document, laid over each other, are the maximal repeats.

All comparisons are minima by key: a block keeps the smallest document that has it and the largest that probes it, a run
the smallest document that has it. So a passage in many documents costs as much as its words, not as its pairs. Hits
are found by 48 bits of a hash and the part it is dealt to; runs are compared by 80 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import exchange
from palimpsest.llm.common import dropped, partitions, ship, tidied, written
from palimpsest.llm.hashing import U, rows_of_runs, run_hashes, text_slices, word_hashes, word_spans

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Bytes of text that a worker turns into packed rows at a time.
HELD = 4 << 20


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """doc_id, tag, text. The tag tells rows of one doc_id with different texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag"), text.alias("text"), *more)


class _Packer:
    """Collects (key hash, place) of rows and packs them by part."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.tags: list = []
        self.rows: list = []
        self.columns: list = []
        self.n = self.bytes = 0

    def add(self, ids: np.ndarray, tags: np.ndarray, row: np.ndarray, columns: list[np.ndarray], size: int) -> None:
        """row: of each entry, its place among ids."""
        self.ids.append(ids)
        self.tags.append(tags)
        self.rows.append(row + self.n)
        self.columns.append(columns)
        self.n += len(ids)
        self.bytes += size

    def flush(self, part, sent=list) -> Iterator[pa.RecordBatch]:
        """part: from ids, rows and columns to parts. sent: what is packed of the columns."""
        if self.rows:
            ids, tags, row = np.concatenate(self.ids), np.concatenate(self.tags), np.concatenate(self.rows)
            columns = [np.concatenate(c) for c in zip(*self.columns, strict=True)]
            yield from exchange.rows((p, _table(ids, tags, x)) for p, x in exchange.by_part(part(ids, row, columns), self.parts, [row, *sent(columns)]))
        self.clear()


def _table(ids: np.ndarray, tags: np.ndarray, entries: list[np.ndarray]) -> list[np.ndarray]:
    """Entries sorted by row, with the ids and tags of the rows that occur and how often each does."""
    row, *columns = entries
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return [ids[row[start]], tags[row[start]], np.diff(start, append=len(row)).astype(np.uint32), *columns]


def _joined(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """ids, tags, row of each entry, columns of all that a task received."""
    got = exchange.received(batches)
    if not got:
        return None
    ids, tags, n, *columns = (np.concatenate(x) for x in zip(*got, strict=True))
    return [ids, tags, np.repeat(np.arange(len(ids)), n), *columns]


def _home(parts: int):
    """Rows go back to the part of their document."""
    from palimpsest.llm.hashing import mixed

    return lambda ids, row, _: exchange.part_of(mixed(ids.astype(U)), parts)[row]


def _gathered(packed: DataFrame, parts: int, name: str) -> DataFrame:
    """One row a document: doc_id, tag and all its places, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _joined(batches)) is None:
            return
        ids, tags, row, place = got
        # The same document may come from every part.
        order = np.lexsort((place, tags[row], ids[row]))
        i, t, place = ids[row][order], tags[row][order], place[order]
        start = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]))))
        end = np.append(start[1:], len(i))
        for at in range(0, len(start), 5000):
            s, e = start[at : at + 5000], end[at : at + 5000]
            found = [np.unique(place[x:y]).astype(np.uint32).tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(i[s]), pa.array(t[s].astype(np.int32)), pa.array(found, pa.binary())], names=["doc_id", "tag", name])

    return exchange.dealt(packed, parts).mapInArrow(tidied(run), f"doc_id long, tag int, {name} binary")


def _hits(docs: DataFrame, block: int, parts: int) -> DataFrame:
    """doc_id, tag, hits: places whose run of block words is also a block of an earlier document, or is itself a block that a later document has."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(parts)
        part = lambda _, __, columns: exchange.part_of(columns[0].astype(U) << U(32), parts)
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j, data, starts in text_slices(b.column(2)):
                first, end, counts = word_spans(data, starts)
                runs = run_hashes(word_hashes(data, first, end), block)
                own = np.maximum(counts - block + 1, 0)
                h = runs[rows_of_runs(counts, block)]
                row = np.repeat(np.arange(j - i), own)
                place = np.arange(len(h)) - np.repeat(np.cumsum(own) - own, own)
                out.add(ids[i:j], tags[i:j], row, [(h >> U(32)).astype(np.uint32), h.astype(np.uint32), place.astype(np.uint32)], len(data))
                if out.bytes >= HELD:
                    yield from out.flush(part, short)
        yield from out.flush(part, short)

    def short(columns: list[np.ndarray]) -> list[np.ndarray]:
        """Of the hash's upper half, whose high bits name the part, 16 bits go along."""
        return [columns[0].astype(np.uint16), *columns[1:]]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _joined(batches)) is None:
            return
        ids, tags, row, high, low, place = got
        h = (high.astype(U) << U(32)) | low
        del high, low
        doc = ids[row]
        index = place % block == 0
        order = np.argsort(h[index])
        keys, owner = h[index][order], doc[index][order]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        keys, least = keys[start], (np.minimum.reduceat(owner, start) if len(start) else np.empty(0, np.int64))
        if not len(keys):
            return
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        known = keys[at] == h
        most = np.full(len(keys), np.iinfo(np.int64).min)
        np.maximum.at(most, at[known], doc[known])
        hit = known & ((least[at] < doc) | (index & (most[at] > doc)))
        out = _Packer(parts)
        out.add(ids, tags, row[hit], [place[hit]], 0)
        yield from out.flush(_home(parts))

    found = exchange.dealt(docs.mapInArrow(tidied(emit), exchange.SCHEMA), parts).mapInArrow(tidied(meet), exchange.SCHEMA)
    return _gathered(found, parts, "hits")


def _repeated(texts: DataFrame, block: int, window: int, parts: int) -> DataFrame:
    """doc_id, tag, starts: where runs of window words start that also start in an earlier document. texts: doc_id, tag, text, hits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(parts)
        part = lambda _, __, columns: exchange.part_of(columns[0], parts)
        for b in batches:
            ids, tags, hits = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for i, j, data, starts in text_slices(b.column(2)):
                first, end, counts = word_spans(data, starts)
                words = word_hashes(data, first, end)
                runs, check = run_hashes(words, window), run_hashes(words, window, seed=1)
                base = np.cumsum(counts) - counts
                spots, rows = [], []
                for k in range(i, j):
                    n = int(counts[k - i]) - window + 1
                    if n > 0:
                        marks = np.zeros(n + 1, np.int64)
                        hit = np.frombuffer(hits[k].as_buffer(), np.uint32).astype(np.int64)
                        np.add.at(marks, np.minimum(np.maximum(hit - (window - block), 0), n), 1)
                        np.add.at(marks, np.minimum(hit + 1, n), -1)
                        own = np.flatnonzero(np.cumsum(marks[:n]) > 0)
                        spots.append(own)
                        rows.append(np.full(len(own), k - i))
                if spots:
                    place, row = np.concatenate(spots), np.concatenate(rows)
                    at = base[row] + place
                    out.add(ids[i:j], tags[i:j], row, [runs[at], check[at].astype(np.uint16), place.astype(np.uint32)], len(data))
                if out.bytes >= HELD:
                    yield from out.flush(part)
        yield from out.flush(part)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _joined(batches)) is None:
            return
        ids, tags, row, h, check, place = got
        doc = ids[row]
        order = np.lexsort((check, h))
        h, check, doc, row, place = h[order], check[order], doc[order], row[order], place[order]
        start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]))))
        least = np.repeat(np.minimum.reduceat(doc, start), np.diff(start, append=len(h)))
        hit = doc > least
        row, place = row[hit], place[hit]
        order = np.argsort(row, kind="stable")
        out = _Packer(parts)
        out.add(ids, tags, row[order], [place[order]], 0)
        yield from out.flush(_home(parts))

    found = exchange.dealt(texts.mapInArrow(tidied(emit), exchange.SCHEMA), parts).mapInArrow(tidied(meet), exchange.SCHEMA)
    return _gathered(found, parts, "starts")


def repeat_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tag, starts (binary, unsigned 32-bit word places, sorted) of rows that have any run of window words that also starts
    in an earlier document. window must be odd."""
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be odd")
    ship(docs.sparkSession)
    block, parts = (window + 1) // 2, partitions(docs.sparkSession)
    rows = _keyed(docs).where("doc_id IS NOT NULL")
    found = written(_hits(rows, block, parts), "hits")
    hits = found.select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "hits")
    texts = rows.join(hits, (F.col("doc_id") == F.col("i")) & (F.col("tag") == F.col("t"))).select("doc_id", "tag", "text", "hits")
    starts = written(_repeated(texts, block, window, parts), "starts")
    dropped(found)
    return starts


def spans(starts: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the maximal stretches that runs starting at starts cover."""
    at = np.frombuffer(starts, np.uint32).astype(np.int64)
    fresh = np.concatenate(([True], at[1:] > at[:-1] + window)) if len(at) else np.empty(0, bool)
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1) if len(at) else np.empty(0, np.int64)
    return at[fresh], at[last] + window


def without_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, cut (array of first word and end), kept (text), and columns to carry along, of each row of docs (doc_id, text).

    Words are taken unchanged. Each word goes that lies in a run of window words which also starts in a row with a smaller doc_id, as
    the input has it; what is kept is joined by single spaces. Rows of one doc_id do not remove from each other. A row without doc_id is
    kept whole and removes nothing; null and empty texts have no words; repeated rows each get a row; no rows: no rows; other columns are not read.
    """
    starts = repeat_starts(docs, window).select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "starts")
    more = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    rows = _keyed(docs, *more).join(starts, (F.col("doc_id") == F.col("i")) & (F.col("tag") == F.col("t")), "left").select("doc_id", "text", "starts", *(f"_{i}" for i in range(len(carry))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, texts, found, *rest_of_row = b.slice(at, 500).columns
                total, gone, cuts, kept = [], [], [], []
                for text, own in zip(texts, found, strict=True):
                    words = text.as_buffer().to_pybytes().split()
                    total.append(len(words))
                    pairs = []
                    if own.is_valid:
                        pairs = [list(map(int, p)) for p in zip(*spans(own.as_py(), window), strict=True)]
                        left, rest = 0, []
                        for x, y in pairs:
                            rest += words[left:x]
                            left = y
                        words = rest + words[left:]
                    cuts.append(pairs)
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary()).cast(pa.string()), *rest_of_row],
                    names=["doc_id", "n_words", "n_removed", "cut", "kept", *(f"_{i}" for i in range(len(rest_of_row)))],
                )

    kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = rows.mapInArrow(tidied(run), f"doc_id long, n_words long, n_removed long, cut array<array<int>>, kept string{kinds}")
    return out.select("doc_id", "n_words", "n_removed", "cut", "kept", *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)))
