"""Toxicity by bags of subwords: character n-gram embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is wrapped in < and >, and its character n-grams and itself are hashed to rows of an embedding table. A text is the mean of
all rows of all its words; a linear layer and a softmax over two classes follow. Misspellings never seen share
most n-grams with what was seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import ship, tidied, tidy, tidy_driver
from palimpsest.llm.hashing import mixed
from palimpsest.llm.pieces import gather

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
#: About so many labelled rows are fitted, whatever their length. Scoring has no such limit.
FIT_ROWS = 6000
#: How often each fitted row is seen, and steps of training that are made in any case.
EPOCHS, STEPS = 8.5, 800


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, one word after the other, and how many each word has."""
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(n)
    word = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(chars)) - (ends - n)[word]
    left = n[word] - place
    h, found, of = np.zeros(len(chars), np.uint64), [], []
    for k in range(1, max(GRAMS) + 1):
        h[: len(chars) - k + 1] = h[: len(chars) - k + 1] * np.uint64(0x100000001B3) + chars[k - 1 :]
        if k in GRAMS:
            at = np.flatnonzero(left >= k)
            found.append(mixed(h[at] + np.uint64(k)))
            of.append(word[at])
    # The whole word: a sum of its mixed characters and places.
    weights = mixed(chars * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    sums = np.cumsum(weights, dtype=np.uint64)
    found.append(mixed(sums[ends - 1] - sums[ends - n] + weights[ends - n]) if len(words) else np.empty(0, np.uint64))
    of.append(np.arange(len(words)))
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(of_all, minlength=len(words))


def cut(text: str | None) -> list[str]:
    """Lower-case words; null and empty texts have none."""
    return (text or "").lower().split()


@dataclass
class Model:
    """row: what a bucket adds to the log odds, its embedding times the layer's weights. bias: the log odds of a text without words."""

    row: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Log odds of texts, with a table of words seen."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.counts = np.empty(0), np.empty(0, np.int64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.limit:
            self._clear()
        known, rows = self.known, []
        for t in texts:
            words = cut(t)
            try:
                rows.append(list(map(known.__getitem__, words)))
            except KeyError:
                for w in words:
                    known.setdefault(w, len(known))
                rows.append(list(map(known.__getitem__, words)))
        if len(known) > len(self.sums):
            buckets, n = subwords(list(known)[len(self.sums) :])
            at = np.repeat(np.arange(len(n)), n)
            self.sums = np.concatenate([self.sums, np.bincount(at, self.model.row[buckets], len(n))])
            self.counts = np.concatenate([self.counts, n])
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for x in rows for r in x), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(rows)), size)
        sums, counts = np.bincount(of, self.sums[flat], len(rows)), np.bincount(of, self.counts[flat], len(rows))
        odds = sums / np.maximum(counts, 1) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


#: A text's different words, joined by spaces, and how often each occurs: as long as its vocabulary, not as the text.
Counted = tuple[str, np.ndarray]


def counted(text: str | None) -> Counted:
    seen: dict[str, int] = {}
    for w in cut(text):
        seen[w] = seen.get(w, 0) + 1
    return " ".join(seen), np.fromiter(seen.values(), np.int32, len(seen))


def bags(texts: list[Counted], seen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that at least so many texts have; for all texts the places of their buckets among these, the buckets' shares of
    the text's subwords, and how many buckets each text has."""
    known: dict[str, int] = {}
    rows = [np.array([known.setdefault(w, len(known)) for w in words.split()], np.int32) for words, _ in texts]
    words = list(known)
    del known
    parts = []
    for at in range(0, len(words), 20_000):
        flat, n = subwords(words[at : at + 20_000])
        parts.append((flat.astype(np.int32), n.astype(np.int32)))
    del words
    flat = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.int32)
    n = np.concatenate([k for _, k in parts]) if parts else np.empty(0, np.int32)
    del parts
    starts = np.cumsum(n, dtype=np.int64) - n

    def bag(r: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every, each = gather(flat, starts, n, r)
        own, at = np.unique(every, return_inverse=True)
        return own, np.bincount(at, np.repeat(times, each), len(own))

    texts_with = np.zeros(BUCKETS, np.int32)
    for r, (_, times) in zip(rows, texts, strict=True):
        texts_with[bag(r, times)[0]] += 1
    common = np.flatnonzero(texts_with >= seen)
    place = np.full(BUCKETS, -1, np.int32)
    place[common] = np.arange(len(common))
    # Their places are counted, so they are put where they stay: lists of them would be held twice while they are joined.
    total = int(texts_with[common].sum(dtype=np.int64))
    buckets, shares, sizes, at = np.empty(total, np.int32), np.empty(total, np.float32), np.zeros(len(rows), np.int64), 0
    for i, (r, (_, times)) in enumerate(zip(rows, texts, strict=True)):
        own, count = bag(r, times)
        kept = place[own] >= 0
        sizes[i] = kept.sum()
        buckets[at : at + sizes[i]] = place[own[kept]]
        shares[at : at + sizes[i]] = count[kept] / max(1, count.sum())
        at += int(sizes[i])
    return common, buckets, shares, sizes


def loss_and_gradients(table: np.ndarray, layer: np.ndarray, offset: np.ndarray, own: np.ndarray, part: np.ndarray, of: np.ndarray, wanted: np.ndarray, scale: float) -> tuple[float, tuple[np.ndarray, ...]]:
    """Mean cross entropy of a batch, and its gradients by embeddings, layer and offset. own, part, of: buckets of the batch, their shares, and which text each is of.

    The mean is linear in the embeddings, so it needs one number for each bucket and class; an embedding's gradient is the layer's weights times the
    bucket's share-weighted errors."""
    votes = table @ layer
    odds = np.stack([np.bincount(of, part * votes[own, c], len(wanted)) for c in (0, 1)], axis=1) * scale + offset
    top = odds.max(axis=1, keepdims=True)
    p = np.exp(odds - top)
    total = p.sum(axis=1, keepdims=True)
    error = (p / total - wanted) / len(wanted)
    pulled = np.stack([np.bincount(own, part * error[of, c], len(table)) for c in (0, 1)], axis=1).astype(np.float32) * scale
    loss = float(-(wanted * (odds - top - np.log(total))).sum() / len(wanted))
    return loss, (pulled @ layer.T, table.T @ pulled, error.sum(axis=0))


def train(texts: list[Counted], labels: np.ndarray, dim: int = 8, steps: int | None = None, batch: int = 64, rate: float = 0.02, decay: float = 0.6, seen: int = 4, smooth: float = 0.02, scale: float = 1000.0, seed: int = 1) -> Model:
    """Fit embeddings and layer together with Adam on the cross entropy. steps: as many as see each row EPOCHS times, STEPS at least.

    Buckets in fewer than `seen` texts stay at zero, each
    embedding is shortened a little at every step (a group lasso, so most end at zero), and labels count as wrong
    with probability `smooth`: else rows with wrong labels would be learned by their rare words. Means are multiplied by
    `scale`, as those of many rows are small. Without rows, or with one label only, the model answers by the share of label 1.
    """
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), bias)
    steps = max(STEPS, int(EPOCHS * len(labels) / batch)) if steps is None else steps
    rng = np.random.default_rng(seed)
    common, buckets, shares, sizes = bags(texts, seen)
    starts = np.cumsum(sizes) - sizes
    table = rng.normal(0, 0.01, (len(common), dim)).astype(np.float32)
    layer = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    offset = np.array([0.0, bias], np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, layer, offset)]
    wanted = np.stack([labels == 0, labels == 1], axis=1) * (1 - 2 * smooth) + smooth
    order = rng.permutation(len(labels))
    at = 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(labels)), 0
        some, at = order[at : at + batch], at + batch
        own, n = gather(buckets, starts, sizes, some)
        part, _ = gather(shares, starts, sizes, some)
        _, gradients = loss_and_gradients(table, layer, offset, own, part, np.repeat(np.arange(len(some)), n), wanted[some], scale)
        now = rate * (1 - step / (steps + 1))
        for x, g, s in zip((table, layer, offset), gradients, state, strict=True):
            s[0] += 0.1 * (g - s[0])
            s[1] += 0.01 * (g * g - s[1])
            x -= now * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-6)
        table *= np.maximum(0, 1 - now * decay / np.maximum(np.sqrt((table * table).sum(axis=1, keepdims=True)), 1e-9))
    row = np.zeros(BUCKETS)
    row[common] = (table @ (layer[:, 1] - layer[:, 0])).astype(np.float64) * scale
    return Model(row, float(offset[1] - offset[0]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows of docs that aren't held out: a hash of doc_id picks about rows of them, whatever the length of their texts.

    The bound is what the driver holds, which gets each text's different words and their counts. Rows with null labels, ids or texts don't take part in the fit; of several
    labels of one doc_id the highest counts; repeated rows of docs each count; empty tables give a model that answers by the share of label 1.
    """
    ship(docs.sparkSession)
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    limit = int(min(1.0, rows / max(1, n)) * (2**31 - 1))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31 - 1)) <= limit)
    names = ["doc_id", "h", "toxic", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [counted(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([w for w, _ in made], pa.string()), pa.array([c.tobytes() for _, c in made], pa.binary())], names=names)

    # About `rows` rows by the choice above, so small whatever the corpus.
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), "toxic", "text").mapInArrow(tidied(run), "doc_id long, h long, toxic int, words string, counts binary")
    found = texts.toPandas().sort_values(["doc_id", "h"])
    texts, toxic = [(w, np.frombuffer(c, np.int32)) for w, c in zip(found.words, found["counts"], strict=True)], found.toxic.to_numpy() == 1
    del found
    tidy()
    tidy_driver(docs.sparkSession)
    model = train(texts, toxic)
    del texts
    tidy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) of each row of docs (doc_id, text), texts read whole.

    Null and empty texts have the score of a text without words. Null ids are kept and never held out; repeated rows each get a
    row; no rows: no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.row.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, bias = shared.value
        scorer = Model(row.astype(np.float64), bias).scorer()
        for b in batches:
            texts, made = b.column(2), []
            for at in range(0, b.num_rows, 256):
                made.append(scorer.score(texts.slice(at, 256).to_pylist()))
            s = np.concatenate(made) if made else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs, all columns, that aren't predicted toxic; judged where they stand, without a join.

    Null and empty texts have the score of a text without words, null ids are kept, repeated rows are each judged alike; no rows: no rows."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.row.astype(np.float32), model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, bias = shared.value
        scorer = Model(row.astype(np.float64), bias).scorer()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield part.filter(pa.array(scorer.score(part.column(at).to_pylist()) < 0.5))

    return docs.mapInArrow(tidied(run), docs.schema)
