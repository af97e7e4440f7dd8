"""The Jaccard join and components against brute force."""

import random

import numpy as np
import pytest

from palimpsest.llm import jaccard
from palimpsest.llm.components import components
from tests_llm_brute import groups, shingles

SCHEMA = "doc_id long, text string, key string, n string, component_id string"


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return words


def corpus(seed=5, n=40):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 5000}"
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "one", "one", "One two", "a b c d", "a b c d e", "long " * 30000, "Aé b\x1cc"]
    for g in range(n):
        base = [word() for _ in range(rnd.choice([3, 5, 6, 9, 14, 30, 60, 120, 300, 1500]))]
        for _ in range(rnd.choice([1, 2, 3, 6])):
            texts.append(" ".join(edited(rnd, base, rnd.choice([0, 0, 1, 1, 2, len(base) // 60, len(base) // 40]))))
        if g % 2:
            texts.append(" ".join(passage + [word() for _ in range(rnd.choice([5, 40, 90]))]))
    base = [word() for _ in range(150)]
    texts += [" ".join(edited(rnd, base, rnd.choice([0, 1, 2, 3, 4, 5]))) for _ in range(90)]  # shares signatures beyond PAIRED
    rnd.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    return sorted(tuple(r)[:3] for r in jaccard.near_groups(df, **k).collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == groups(rows)


def test_common_features_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BATCH_COUNT", 2)
    monkeypatch.setattr(jaccard, "TOTAL_COUNT", 2)
    monkeypatch.setattr(jaccard, "PAIRED", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = corpus(7)
    assert run(spark, rows) == groups(rows)


def test_any_two_similar_sets_share_a_signature():
    rng, low = np.random.default_rng(3), jaccard.lows()
    for trial in range(1000):
        n = int(rng.choice([rng.integers(4, 30), rng.integers(4, 400)]))
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        most = len(s) // 9
        cut, add = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        t = np.unique(np.concatenate([rng.permutation(s)[cut:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        both = len(np.intersect1d(s, t))
        common = np.sort(rng.permutation(s)[: int(rng.choice([0, len(s) // 3, len(s) // 1.2, len(s)]))])
        if 100 * both >= 80 * (len(s) + len(t) - both) and both < max(len(s), len(t)):
            assert len(np.intersect1d(jaccard.signatures(s, common, low), jaccard.signatures(t, common, low))), trial


def test_odd_rows(spark):
    rows = [(7, "a b c"), (7, "a b c"), (7, "other words here"), (3, "A b C"), (5, "other words here")]
    assert run(spark, rows) == [(3, 1, 3), (5, 1, 5), (7, 1, 3), (7, 1, 3), (7, 1, 5)]
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (None, "z")], "doc_id long, text string")
    assert sorted((tuple(r)[:3] for r in jaccard.near_groups(df).collect()), key=str) == [(4, 1, 4), (None, 1, 4), (None, 1, None)]


def test_rows_without_ids_are_linked_too(spark):
    """Near copies without an id, and what only they bridge."""
    rnd = random.Random(3)
    rows = corpus(9, 25)
    base = [f"q{i}" for i in range(100)]
    far = lambda n: " ".join(f"z{i}" if i < n else w for i, w in enumerate(base))
    rows += [(9000, far(0)), (9001, far(5)), (9002, far(10)), (9003, far(15))]
    hidden = {i for i, _ in rows if rnd.random() < 0.3} - {9000, 9003} | {9001, 9002}
    component = {i: c for i, _, c in groups(rows)}
    named = {}
    for i, c in component.items():
        if i not in hidden:
            named[c] = min(named.get(c, i), i)
    df = spark.createDataFrame([(None if i in hidden else i, t) for i, t in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.near_groups(df).collect()), key=str)
    assert got == sorted(((None if i in hidden else i, named.get(component[i])) for i, _ in rows), key=str)
    assert (9003, 9000) in got


def test_sets_that_share_a_key_are_told_apart():
    a, b = np.array([1, 2, 3], np.uint64), np.array([4, 5], np.uint64)
    doubtful = frozenset([jaccard.class_key(a)])
    assert jaccard.class_key(a, doubtful) == jaccard.other_key(a) != jaccard.class_key(a)
    assert jaccard.class_key(b, doubtful) == jaccard.class_key(b) and jaccard.check(a) != jaccard.check(b)


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000 + rnd.randrange(300), 1000 + rnd.randrange(300)) for _ in range(150)] + [(5000, 5000 + i) for i in range(1, 100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("paired, block, features", [(8, 512, 1 << 22), (3, 8, 1 << 22), (3, 512, 500)])
def test_every_link_is_counted(spark, monkeypatch, paired, block, features):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", features)
    rows = corpus(8)
    sets, want = {i: shingles(t) for i, t in rows}, {i: 0 for i, _ in rows}
    for i, s in sets.items():
        want[i] = sum(bool(s) and i != j and 100 * len(s & t) >= 80 * len(s | t) for j, t in sets.items())
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in jaccard.near_groups(df).collect()} == want
    assert sum(want.values()) > 2 * len(rows)


def test_loosely_similar_sets_are_not_compared_with_each_other(spark, monkeypatch):
    """Texts that share half of their words share signatures with many others, but only near copies go to blocks."""
    rnd = random.Random(4)
    page = [f"p{i}" for i in range(100)]
    loose = [page + [f"u{k}x{i}" for i in range(40)] for k in range(150)]
    near = [edited(rnd, loose[0], k % 3) for k in range(30)]
    rows = list(enumerate(" ".join(x) for x in loose + near))
    seen, within = [], jaccard._hot_links

    def counted(clusters, *rest):
        seen.append(clusters.count())
        return within(clusters, *rest)

    monkeypatch.setattr(jaccard, "_hot_links", counted)
    assert run(spark, rows) == groups(rows)
    assert 10 < seen[0] <= 31
