"""Connected components of a table of links, without ever holding them in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_scratch, dropped, ship, tidied, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as links (a, b), a node's root being the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], np.int64)
    keep = roots != np.arange(len(nodes))
    return nodes[keep], nodes[roots[keep]]


def _thinned(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, 1 << 18

        def thin() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n > least:
                held = [thin()]
                # A forest has fewer links than nodes, so what a task holds follows its nodes.
                n = len(held[0][0])
                least = max(least, 2 * n)
        if held:
            x, y = thin()
            for at in range(0, len(x), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]), pa.array(y[at : at + 50_000])], names=["a", "b"])

    return links.mapInArrow(tidied(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of links (a, b), both long and not null.

    Labels start at the smallest neighbour. A round gives each node the least label around it and then the label of
    its label; it ends when no label changes, after about as many rounds as the logarithm of the longest path. Links are
    first thinned to forests task by task. Neighbours are joined on nodes through plain shuffles, which Spark splits
    where a node has very many; minima are taken before shuffling. Each round is a table of its own.
    """
    ship(links.sparkSession)
    spark = links.sparkSession
    first = written(_thinned(links.select("a", "b").where("a <> b")), "links")
    # What many small tasks left of one component is thinned again where they are read together.
    own = written(_thinned(first), "links")
    dropped(first)
    both = written(own.select("a", "b").union(own.select("b", "a")).distinct(), "neighbours")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        hooked = labels.join(around, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        to = labels.select(F.col("node").alias("of"), F.col("component").alias("next"))
        jumped = written(hooked.join(to, hooked["component"] == to["of"]).select("node", "was", F.least("component", "next").alias("component")), "labels")
        drop_scratch(spark, labels._scratch)
        changed = jumped.where("was <> component").limit(1).count()
        if not changed:
            dropped(own, both)
            return jumped.select("node", "component")
        path = jumped._scratch
        labels = jumped.select("node", "component")
        labels._scratch = path
