"""Top-k search against brute force."""

import math
import random

import numpy as np

from palimpsest.llm import topk


def brute(vectors, queries, k):
    out = []
    clean = lambda rows: [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, e in clean(queries):
        found = sorted((-sum(a * b for a, b in zip(e, v)), i) for i, v in clean(vectors) if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def run(spark, vectors, queries, k):
    schema = "vec_id long, embedding array<double>, score string, rank string"
    v, q = (spark.createDataFrame([(i, e, "x", "y") for i, e in rows], schema) for rows in (vectors, queries))
    return sorted(map(tuple, topk.top_k(v, q, k).collect()))


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    vectors = [(i * 3, [rnd.choice([-1, 1]) * rnd.random() ** 3 for _ in range(12)]) for i in range(900)]
    vectors += [(5001, vectors[7][1]), (5002, vectors[7][1]), (5003, vectors[7][1]), (5003, vectors[7][1])]
    vectors += [(6000, None), (6001, [1.0, None]), (6002, [float("nan")] * 12), (6003, [float("inf")] * 12), (None, [1.0] * 12), (6004, []), (6005, [0.5] * 5), (6006, [2.0] * 20), (6007, [2.0**40] + [0.0] * 11)]
    queries = [v for v in vectors if v[0] is not None and v[0] % 5 == 0] + [(6000, None), (21, vectors[7][1])]
    assert run(spark, vectors, queries, 7) == brute(vectors, queries, 7)


def test_few_and_none(spark):
    vectors = [(1, [0.25, -0.1]), (2, [0.2, 0.3]), (3, [-1.0, 0.0])]
    assert run(spark, vectors, vectors[:1], 10) == brute(vectors, vectors[:1], 10)
    assert run(spark, vectors, [], 3) == run(spark, [], vectors, 3) == run(spark, vectors[:1], vectors[:1], 3) == []


def test_blocks_are_passed_over(spark):
    """Vectors in tight groups: most blocks can't reach a query's threshold and are never scored; the result is still that of brute force."""
    rng = np.random.default_rng(1)
    rows = np.repeat(rng.integers(-900, 900, (60, 8)), topk.BLOCK, axis=0) + rng.integers(-5, 5, (60 * topk.BLOCK, 8))
    vectors = [(i, (r / 1024).tolist()) for i, r in enumerate(rows)]
    queries = vectors[::97]
    schema = "vec_id long, embedding array<double>"
    v, q = spark.createDataFrame(vectors, schema), spark.createDataFrame(queries, schema)
    found, first, second = topk.search(v, q, 10)
    scored = sum(len(r["keys"]) // 8 for r in first.union(second).collect())
    assert scored < 0.2 * 60 * len(queries)
    score = rows @ rows[::97].T
    want = []
    for n, (i, _) in enumerate(queries):
        order = [x for x in np.lexsort((np.arange(len(rows)), -score[:, n])).tolist() if x != i][:10]
        want += [(i, r, x, int(score[x, n])) for r, x in enumerate(order, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows, queries = rng.integers(-900, 900, (128, 8)).astype(float), rng.integers(-900, 900, (20, 8)).astype(float)
    high, low = topk.summary(rows)
    assert (topk.bounds(queries, high[None], low[None])[:, 0] >= (queries @ rows.T).max(axis=1)).all()
