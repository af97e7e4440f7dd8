"""Near-duplicate groups by an exact Jaccard join on word shingles, with PartEnum signatures (Arasu and others, 2006).

Sets fall into bands of sizes. Two sets of one band (or neighbouring bands) that are similar enough differ in at most k features, k
following from the band. The feature domain is cut twice: into groups, more than k / 2 of them, so that some group holds at most one difference; and each group
into CELLS cells, of which that difference spoils one. A set's signatures are, for each group, what it holds in each subset of all cells but one: similar
sets of a band share the signature of a group with the spoiled cell left out. An agreement on nothing would join everything, so:

 1. Features common in the corpus are left out of the domain. Differences only become fewer. Signatures of nothing aren't given. A group in which a set
    has two cells that aren't empty is strong: whichever cell is left out, something is left. A set with more than k / 2 strong groups is safe, as
    one of them holds at most one difference to any partner.
 2. A set that isn't safe is mostly common text and gives signatures on the whole domain as well, where the same holds.
 3. A set that isn't safe there either gives a signature for each of its features, of which some agree in any case. Two unsafe sets meet here.

Which features count as common changes the number of candidates only, never a result. Classes of equal sets take part once; they are told apart by 128 bits.
Candidates are checked: first by histograms of their features, which bound the overlap from above, then exactly.

Signatures shared by many sets, as in large groups of near copies, are not expanded into pairs. Sets that share such signatures
form clusters. In a large corpus loosely similar texts chain most of them into one, so these sets are told apart by their rarest features: of sets
similar enough, a fifth of either's, rarest first, has one in common. Again, features shared by few sets make pairs, and those shared by many
make clusters, now of sets that are mostly near copies. These are split by size and hash into blocks of bounded size; a task compares two blocks, counts the links of each
set, and keeps only those of a spanning forest. Pairs that lie within a cluster need no check of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import exchange
from palimpsest.llm.common import dropped, partitions, ship, tidied, written
from palimpsest.llm.components import components, forest
from palimpsest.llm.hashing import U, mixed, powers, run_hashes, text_slices, word_hashes, word_spans

SHINGLE, PERCENT = 5, 80
#: A feature is common if it is in so many sets of a batch (of so many features), and in so many in all such batches; so many are kept.
BATCH_COUNT, COUNTED, TOTAL_COUNT, MOST_COMMON = 3, 1 << 21, 16, 1 << 18
#: Cells of a group, and how many more groups there are than need be, without common features and on the whole domain: some of them aren't strong.
CELLS, SPARE, SPARE_WHOLE = 3, 1.25, 1.6
#: Classes that a task remembers having given signatures for; more are forgotten, and some signatures then given twice.
REMEMBERED = 1 << 19
#: Sets that share a signature are paired up to this number; from there on they go to blocks of about so many sets, and of so many features.
PAIRED, BLOCK, BLOCK_FEATURES = 8, 512, 1 << 22
#: Up to so many ids are broadcast to pick texts by; beyond, the join is shuffled.
BROADCAST_IDS = 1 << 20


def lows(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """The least size of each band. A band spans at least a factor of 100 / percent, so partners are at most a band apart."""
    ratio, out = (100 / percent) ** 2, [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return np.array(out, np.int64)


def shingle_sets(column: pa.Array, k: int = SHINGLE, lower: bool = True) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs (from, to) of rows and each row's set: sorted distinct hashes of k words, of all words if there are fewer."""
    for i, j, data, starts in text_slices(column):
        first, end, counts = word_spans(data, starts, lower)
        words = word_hashes(data, first, end, lower)
        runs = run_hashes(words, k)
        at, out = 0, []
        for c in counts.tolist():
            if c >= k:
                out.append(np.unique(runs[at : at + c - k + 1]))
            elif c:
                out.append(mixed(((words[at : at + c] * powers(0x9E3779B97F4A7C15, c)).sum(dtype=U) + U(c)).reshape(1)))
            else:
                out.append(np.empty(0, U))
            at += c
        yield i, j, out


def class_key(s: np.ndarray, doubtful: dict[int, None] | frozenset = frozenset()) -> int:
    """One number for a set, as a signed long. Equal sets have equal keys. doubtful: keys that sets with different check() share; these sets get another key."""
    key = int(mixed(s + U(0x632BE59BD9B4E019)).sum(dtype=U).astype(np.int64))
    return other_key(s) if key in doubtful else key


def check(s: np.ndarray) -> int:
    """A second number, independent of the first: sets that agree in both are taken as equal, n sets of which do so by chance with probability n**2 / 2**129."""
    return int(mixed(mixed(s ^ U(0xA0761D6478BD642F)) + U(0xE7037ED1A0B428DB)).sum(dtype=U).astype(np.int64))


def other_key(s: np.ndarray) -> int:
    return int(mixed(np.array([check(s)], np.int64).view(U) ^ U(0x8EBC6AF09C88C6E3))[0].astype(np.int64))


def signatures(s: np.ndarray, common: np.ndarray, low: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A set's signatures, for its own band and, if it can have a partner there, the next."""
    n = len(s)
    if not n:
        return np.empty(0, U)
    rest = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s] if len(common) else s
    band = int(np.searchsorted(low, n, "right")) - 1
    out = []
    for i in (band, band + 1) if 100 * n >= percent * low[band + 1] else (band,):
        k = int(2 * (low[i + 1] - 1) * (100 - percent) // (100 + percent))
        if not k:
            continue  # sets this small are equal or no partners
        least = k // 2 + 1
        for level, (features, groups) in enumerate(((rest, math.ceil(SPARE * least)), (s, math.ceil(SPARE_WHOLE * least)))):
            # As features are sorted, so are their cells.
            cell = exchange.part_of(features, groups * CELLS)
            at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
            held, some = np.zeros(groups * CELLS, U), np.zeros(groups * CELLS, bool)
            if len(at):
                held[cell[at]] = np.add.reduceat(mixed(features ^ U(0x9E3779B97F4A7C15)), at)
                some[cell[at]] = True
            held, some = held.reshape(groups, CELLS), some.reshape(groups, CELLS)
            filled = some.sum(axis=1)
            # All cells of a group but one: what is in them, if anything.
            content = (held.sum(axis=1, dtype=U)[:, None] - held).ravel()
            names = np.arange(groups * CELLS).astype(U)
            given = (filled[:, None] - some > 0).ravel()
            out.append(mixed(content[given] + mixed(names[given] * U(1000003) + U(i * 7919 + (level << 50)))))
            if (filled >= 2).sum() >= least:
                break
        else:
            out.append(mixed(mixed(s ^ U(0x9E3779B97F4A7C15)) + U(i * 7919 + (3 << 50))))
    return np.concatenate(out) if out else np.empty(0, U)


def _described(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document's id, set size, class key, check and other key; a common feature's count and hash."""

    names = ["common", "doc_id", "n", "key", "text_hash", "check", "other"]

    def often(distinct: dict[int, np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(list(distinct.values()))
        distinct.clear()
        every.sort()
        start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        count = np.diff(start, append=len(every))
        kept = count >= BATCH_COUNT
        n = int(kept.sum())
        return pa.RecordBatch.from_arrays([pa.array([True] * n, pa.bool_()), pa.nulls(n, pa.int64()), pa.array(count[kept], pa.int64()), pa.array(every[start[kept]].view(np.int64)), *[pa.nulls(n, pa.int64())] * 3], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            for i, j, sets in shingle_sets(b.column(1)):
                keys = [class_key(s) for s in sets]
                for k, s in zip(keys, sets, strict=True):
                    if len(s) and k not in distinct:
                        distinct[k] = s
                        held += len(s)
                yield pa.RecordBatch.from_arrays([pa.array([False] * (j - i)), b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), b.column(2).slice(i, j - i), pa.array([check(s) for s in sets], pa.int64()), pa.array([other_key(s) for s in sets], pa.int64())], names=names)
                if held >= COUNTED:
                    yield often(distinct)
                    held = 0
        if held:
            yield often(distinct)

    return docs.mapInArrow(tidied(run), "common boolean, doc_id long, n long, key long, text_hash long, check long, other long")


def _candidates(docs: DataFrame, common, doubtful: frozenset, percent: int, parts: int) -> DataFrame:
    """(a, b, hot): pairs of class keys; if hot, links that join keys which share a signature with many others."""
    low = lows(percent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, nodes, held = [], [], 0

        for b in batches:
            for _, _, sets in shingle_sets(b.column(0)):
                if len(seen) > REMEMBERED:
                    seen.clear()
                for s in sets:
                    key = class_key(s, doubtful)
                    if key not in seen:
                        seen.add(key)
                        x = signatures(s, common.value, low, percent)
                        if len(x):
                            sigs.append(x)
                            nodes.append(np.full(len(x), key, np.int64))
                            held += len(x)
                if held > 1 << 20:
                    yield from _given(sigs, nodes, parts)
                    held = 0
        if held:
            yield from _given(sigs, nodes, parts)

    return _met(docs.mapInArrow(tidied(emit), exchange.SCHEMA), parts)


def _runs(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that follow each other go along once, with their number."""
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    return node[start], np.diff(start, append=len(node)).astype(np.uint32)


def _given(sigs: list[np.ndarray], nodes: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Signatures and the keys that have them, by parts of the signatures; the lists are emptied. Of a signature 40 bits go along, besides the part; agreeing by chance only makes a candidate more."""
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    sigs.clear()
    nodes.clear()
    yield from exchange.rows((p, [(s >> U(32)).astype(np.uint8), s.astype(np.uint32), *_runs(k)]) for p, (s, k) in exchange.by_part(exchange.part_of(sig, parts), parts, [sig, node]))


def _met(given: DataFrame, parts: int) -> DataFrame:
    """(a, b, hot) of what _given() gave: pairs of keys; if hot, links that join keys which share a signature with many others."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = exchange.received(batches)
        if not got:
            return
        high, low, node, times = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        sig = (high.astype(U) << U(32)) | low
        del high, low
        node = np.repeat(node, times)
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        same = sig[1:] == sig[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        sig, node = sig[shared], node[shared]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))) if len(sig) else np.empty(0, bool)
        sig, node = sig[fresh], node[fresh]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.empty(0, np.int64)
        size = np.diff(start, append=len(sig))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in range(2, PAIRED + 1):
            own = node[start[size == n][:, None] + np.arange(n)]
            x, y = np.triu_indices(n, 1)
            a.append(own[:, x].ravel())
            b.append(own[:, y].ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
        many = size > PAIRED
        hot = forest(node[np.repeat(many, size)], np.repeat(node[start[many]], size[many]))
        for x, y, h in ((a[fresh], b[fresh], False), (*hot, True)):
            for i in range(0, len(x), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]), pa.array(y[i : i + 50_000]), pa.array(np.full(len(x[i : i + 50_000]), h))], names=["a", "b", "hot"])

    return exchange.dealt(given, parts).mapInArrow(tidied(meet), "a long, b long, hot boolean")


def _prefixes(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b, hot) as of _candidates(), of sets (key, features) among themselves, by features that are among the rarest of both.

    A set's features are put in one order for all, by how many of the sets have them, then by themselves. Sets similar enough agree in percent of either, so the
    first features of both, a number one above what may differ, have one in common. Those that no other set has make no candidates.
    """
    low = lows(percent)

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            feature = np.concatenate([f for _, f in held])
            node = np.repeat(np.array([k for k, _ in held], np.int64), [len(f) for _, f in held])
            held.clear()
            yield from exchange.rows((p, [f, *_runs(k)]) for p, (f, k) in exchange.by_part(exchange.part_of(feature, parts), parts, [feature, node]))

        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.append((key, np.frombuffer(x.as_buffer(), U)))
                n += len(held[-1][1])
                if n > 1 << 20:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = exchange.received(batches)
        if not got:
            return
        feature, node, times = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        node = np.repeat(node, times)
        _, at, count = np.unique(feature, return_inverse=True, return_counts=True)
        count = count[at].astype(np.uint32)
        del at
        order = np.argsort(node, kind="stable")
        feature, node, count = feature[order], node[order], count[order]
        # Of features that one set alone has, only the number goes back.
        alone, several = _runs(node[count == 1]) if (count == 1).any() else (np.empty(0, np.int64), np.empty(0, np.uint32)), count > 1
        node, feature, count = np.concatenate([node[several], alone[0]]), np.concatenate([feature[several], np.zeros(len(alone[0]), U)]), np.concatenate([count[several], np.zeros(len(alone[0]), np.uint32)])
        number = np.concatenate([np.ones(int(several.sum()), np.uint32), alone[1]])
        for p, (k, f, c, x) in exchange.by_part(exchange.part_of(mixed(node.view(U)), parts), parts, [node, feature, count, number]):
            only = c == 0
            yield from exchange.rows([(p, [k[only], x[only], f[~only], c[~only], *(_runs(k[~only]) if not only.all() else (k[:0], x[:0]))])])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = exchange.received(batches)
        if not got:
            return
        only, number, feature, count, node, times = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        node = np.repeat(node, times)
        keys, at = np.unique(np.concatenate([only, node]), return_inverse=True)
        single = np.bincount(at[: len(only)], number, len(keys)).astype(np.int64)
        own = at[len(only) :]
        size = single + np.bincount(own, minlength=len(keys))
        order = np.lexsort((feature, count, own))
        feature, own = feature[order], own[order]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        first = size - -(-percent * size // 100) + 1
        kept = nth < (first - single)[own]
        feature, own = feature[kept], own[kept]
        # Partners are of one band or of neighbouring ones.
        band = np.searchsorted(low, size, "right") - 1
        upper = 100 * size[own] >= percent * low[band[own] + 1]
        own, feature, where = np.concatenate([own, own[upper]]), np.concatenate([feature, feature[upper]]), np.concatenate([band[own], band[own[upper]] + 1])
        if len(own):
            order = np.argsort(own, kind="stable")
            yield from _given([mixed(feature[order] ^ mixed(where[order].astype(U)))], [keys[own[order]]], parts)

    there = exchange.dealt(sets.mapInArrow(tidied(dealt_out), exchange.SCHEMA), parts).mapInArrow(tidied(counted), exchange.SCHEMA)
    return _met(exchange.dealt(there, parts).mapInArrow(tidied(rarest), exchange.SCHEMA), parts)


def _sets(texts: DataFrame, doubtful: frozenset, column: str) -> DataFrame:
    """key, n and column of (key, text), where the text has that key: its features, or their histogram (256 counts by their top byte)."""

    def held(s: np.ndarray) -> bytes:
        return s.tobytes() if column == "features" else np.minimum(np.bincount((s >> U(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            want = b.column(0).to_pylist()
            for i, _, sets in shingle_sets(b.column(1)):
                kept = [(want[k], s) for k, s in enumerate(sets, i) if want[k] not in seen and class_key(s, doubtful) == want[k]]
                seen.update(k for k, _ in kept)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()), pa.array([held(s) for _, s in kept], pa.binary())], names=["key", "n", column])

    return texts.mapInArrow(tidied(run), f"key long, n long, {column} binary")


def _filtered(pairs: DataFrame, overlap, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, x, y) of which overlap(x, y) is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                a, b, na, nb, x, y = batch.slice(at, 1000).columns
                both = np.array([overlap(p.as_buffer(), q.as_buffer()) for p, q in zip(x, y, strict=True)], np.int64)
                both = np.minimum(both, np.minimum(na.to_numpy(), nb.to_numpy()))
                enough = pa.array(100 * both >= percent * (na.to_numpy() + nb.to_numpy() - both))
                yield pa.RecordBatch.from_arrays([a.filter(enough), b.filter(enough)], names=["a", "b"])

    return pairs.mapInArrow(tidied(run), "a long, b long")


def _bound(x, y) -> int:
    """No less than the overlap; counts that are cut off bound nothing."""
    both = np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
    return int(both.sum(dtype=np.int64)) if both.max() < 255 else 1 << 40


def _exact(x, y) -> int:
    p, q = np.frombuffer(x, U), np.frombuffer(y, U)
    if len(p) > len(q):
        p, q = q, p
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def _beside(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) of keys with sizes and the column of their sets."""
    left = sets.select(F.col("key").alias("ka"), F.col("n").alias("na"), F.col(column).alias("x"))
    right = sets.select(F.col("key").alias("kb"), F.col("n").alias("nb"), F.col(column).alias("y"))
    return pairs.join(left, pairs["a"] == F.col("ka")).join(right, F.col("b") == F.col("kb")).select("a", "b", "na", "nb", "x", "y")


def _of(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets of some keys; if they aren't too many, the others are left out before anything is shuffled."""
    keys = keys.select(F.col("key").alias("of")).distinct()
    return sets.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, F.col("key") == F.col("of"), "left_semi")


def compare(keys: np.ndarray, features: list[np.ndarray], weights: np.ndarray, side: np.ndarray, alone: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links between sets of side 0 and side 1, or among all if alone; and what each set is linked with, by weight."""
    sizes = np.array([len(f) for f in features], np.int64)
    every, at, count = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[at]
    row, column = row[shared[at]], column[shared[at]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if alone:
        left = right = np.arange(len(sizes))
    both = np.zeros((len(sizes), len(sizes)), np.float32)[: len(left), : len(right)].copy()
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 8192):
        i, j = np.searchsorted(column, (at, at + 8192))
        held = np.zeros((len(sizes), 8192), np.float32)
        held[row[i:j], column[i:j] - at] = 1
        both += held[left] @ held[right].T
    both = both.astype(np.int64)
    x, y = np.nonzero(100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both))
    x, y = left[x], right[y]
    x, y = x[x != y], y[x != y]
    count = np.bincount(x, weights[y], len(keys))
    if not alone:
        count += np.bincount(y, weights[x], len(keys))
    return *forest(keys[x], keys[y]), count.astype(np.int64)


def _clusters(links: DataFrame) -> DataFrame:
    """key, cluster of sets that share a signature with many others."""
    return components(links).select(F.col("node").alias("key"), F.col("component").alias("cluster"))


def _hot_links(clusters: DataFrame, sets: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """(a, b, n) within clusters: links of a forest, n being 0, and with a = b what a set is linked with, by weight, in parts to be added up."""
    import pandas as pd

    # Partners are less than a band of this width apart, even where the logarithm is rounded.
    band = F.floor(F.log("n") / F.lit(math.log(1.05 * 100 / percent))).cast("int")
    members = clusters.join(sets.select("key", "n"), "key").withColumn("band", band).join(weights, F.col("key") == F.col("of")).drop("of")
    members = written(members, "members")
    blocks = members.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_FEATURES))).cast("int").alias("own"))
    order = Window.partitionBy("cluster").orderBy("band")
    near = lambda f: F.when(f("band").over(order) == F.col("band") + (1 if f is F.lead else -1), f("own").over(order)).otherwise(0)
    blocks = written(blocks.select("cluster", "band", "own", near(F.lead).alias("above"), near(F.lag).alias("below")), "blocks")
    placed = members.join(blocks, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("own")).cast("int"))

    def upto(n: str, make):
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)).otherwise(F.array())

    def meeting(lower, across: bool, x, y, side):
        return F.struct(lower.cast("int").alias("lower"), F.lit(across).alias("across"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))

    b, k = F.col("band"), F.col("block")
    meetings = F.concat(
        upto("own", lambda i: meeting(b, False, F.least(i, k), F.greatest(i, k), (i < k).cast("int"))),
        upto("above", lambda i: meeting(b, True, k, i, F.lit(0))),
        upto("below", lambda i: meeting(b - 1, True, i, k, F.lit(1))),
    )
    rows = placed.select("cluster", "key", "weight", F.explode(meetings).alias("m")).select("cluster", "m.lower", "m.across", "m.x", "m.y", "m.side", "key", "weight").join(sets.select("key", "features"), "key")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, alone = group["key"].to_numpy(), not group["across"].iloc[0] and group["x"].iloc[0] == group["y"].iloc[0]
        a, b, n = compare(keys, [np.frombuffer(f, U) for f in group["features"]], group["weight"].to_numpy(), group["side"].to_numpy(), bool(alone), percent)
        own = keys[n > 0]
        return pd.DataFrame({"a": np.concatenate([a, own]), "b": np.concatenate([b, own]), "n": np.concatenate([np.zeros(len(a), np.int64), n[n > 0]])})

    return rows.groupBy("cluster", "lower", "across", "x", "y").applyInPandas(run, "a long, b long, n long")


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, text_hash (xxhash64) of each row of docs (doc_id, text), by links of Jaccard similarity percent / 100 or more.

    A set holds the distinct runs of five words, A-Z lower-cased; of fewer words, all of them as one. Rows without words are linked
    with nothing and are their own component. component_id is the smallest doc_id that links reach, n_links the number of other rows that
    a row is itself linked with. Repeated rows each get a row.
    A row without doc_id is linked like any other, but has no id to give: its component is named by those that have one, null if none has. Of rows
    with one doc_id and different texts each stands for itself. No rows: no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = 2 * partitions(spark)  # more than usual, as a task holds what it received
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    described = written(_described(hashed), "sets")
    # At most MOST_COMMON numbers come here.
    often = described.where("common").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= TOTAL_COUNT).orderBy(F.desc("n"), "key").limit(MOST_COMMON)
    common = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in often.collect()], np.int64).view(U)))
    own = described.where(~F.col("common"))
    # Keys that different sets share by chance: n**2 / 2**65 are to be expected of n sets, three of 10**10.
    shared = own.where("n > 0").groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b")
    doubtful = frozenset(r.key for r in shared.select("key").collect())
    if doubtful:
        own = own.withColumn("key", F.when(F.col("key").isin(*doubtful), F.col("other")).otherwise(F.col("key")))
    first = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))
    classes = written(own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), first.alias("first"), F.max("n").alias("n"), F.count("*").alias("rows")), "classes")
    found = written(_candidates(rows.select("text"), common, doubtful, percent, parts), "candidates")

    def of_texts(keys: DataFrame, column: str, label: str) -> DataFrame:
        """A row for each of these keys, from a text of each."""
        wanted = written(keys.distinct().join(classes.select(F.col("key").alias("of"), "least", "first"), F.col("key") == F.col("of")).select("key", "least", "first"), "wanted")
        picked = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        there = hashed.join(picked, (F.col("text_hash") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("least")))
        sets = written(_sets(there.select("key", "text"), doubtful, column), label)
        if sets.count() > wanted.count():  # rows repeated over tasks
            several, sets = sets, written(sets.dropDuplicates(["key"]), label)
            dropped(several)
        dropped(wanted)
        return sets

    def apart(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
        """Pairs but those within a cluster."""
        of_a, of_b = clusters.select(F.col("key").alias("ka"), F.col("cluster").alias("ca")), clusters.select(F.col("key").alias("kb"), F.col("cluster").alias("cb"))
        pairs = pairs.join(of_a, F.col("a") == F.col("ka"), "left").join(of_b, F.col("b") == F.col("kb"), "left")
        return pairs.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b")

    size = classes.select(F.col("key").alias("of"), F.col("n").alias("size"))

    def sized(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("a", "b").distinct().join(size, F.col("a") == F.col("of")).select("a", "b", F.col("size").alias("na")).join(size, F.col("b") == F.col("of"))
        return pairs.where(100 * F.least("na", "size") >= percent * F.greatest("na", "size")).select("a", "b")

    # What shares signatures with many others is looked at again, by its rarest features.
    loose = _clusters(found.where("hot").select("a", "b"))
    shared = of_texts(loose.select("key"), "features", "shared")
    closer = written(_prefixes(shared.select("key", "features"), percent, parts), "closer")
    dropped(shared)
    clusters = _clusters(closer.where("hot").select("a", "b"))
    # Pairs within a loose cluster are among the closer ones, those within a cluster are compared there.
    pairs = written(apart(apart(sized(found.where(~F.col("hot"))), loose).union(sized(closer.where(~F.col("hot")))).distinct(), clusters), "pairs")

    sets = of_texts(pairs.select(F.col("a").alias("key")).union(pairs.select("b")), "histogram", "histograms")
    likely = written(_filtered(_beside(pairs, sets, "histogram"), _bound, percent), "likely")
    dropped(sets)
    ends = likely.select(F.col("a").alias("key")).union(likely.select("b"))
    sets = of_texts(ends.union(clusters.select("key")), "features", "features")

    weights = classes.select(F.col("key").alias("of"), F.col("rows").alias("weight"))
    linked = written(_filtered(_beside(likely, _of(ends, sets), "features"), _exact, percent), "linked")
    hot = written(_hot_links(clusters, _of(clusters, sets), weights, percent), "hot")
    groups = written(components(linked.union(hot.select("a", "b"))), "groups")
    # A pair is either checked by itself or within its cluster.
    beside = [linked.join(weights, F.col(y) == F.col("of")).select(F.col(x).alias("linked"), "weight") for x, y in (("a", "b"), ("b", "a"))]
    near = hot.where("a = b").select("a", "n").union(beside[0]).union(beside[1]).toDF("linked", "n").groupBy("linked").agg(F.sum("n").alias("near"))
    least = groups.join(classes.select(F.col("key").alias("of"), "least"), F.col("node") == F.col("of")).groupBy("component").agg(F.min("least").alias("smallest"))
    smallest = groups.join(least, "component").select(F.col("node").alias("of"), "smallest")
    named = classes.join(smallest, F.col("key") == F.col("of"), "left").join(near, F.col("key") == F.col("linked"), "left")
    named = named.select(F.col("key").alias("k"), F.coalesce("smallest", "least").alias("component_id"), (F.coalesce("near", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    named = written(named, "named")
    dropped(classes, found, closer, pairs, likely, sets, linked, hot, groups)
    out = own.join(named, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash")
