"""Repeats across documents against brute force."""

import random

import pytest

from palimpsest.llm import exchange, repeats
from tests_llm_brute import repeats as brute

SCHEMA = "doc_id long, text string, tag string, starts string, kept string"


def corpus(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "Ä", "c\x1c", "日本", f"w{rnd.randrange(3000)}"]) if rnd.random() < 0.3 else f"w{rnd.randrange(3000)}"
    passages = [[word() for _ in range(rnd.choice([7, 12, 13, 14, 20, 27, 60]))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "x " * 40), (4, "x " * 13), (5, "x " * 12), (900, "long tail " * 40000)]
    for i in range(10, n):
        w = []
        for _ in range(rnd.randrange(6)):
            w += [word() for _ in range(rnd.randrange(25))] + rnd.choice(passages)[rnd.choice([0, 0, 1]) :]
        rows.append((i * 3 % 1000, rnd.choice([" ", "\n", "  "]).join(w)))
    rows += [rows[20], (rows[21][0], rows[22][1]), (None, rows[23][1])]
    rnd.shuffle(rows)
    return rows


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(df, **k).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[2] for r in got) > 500


def test_other_windows_and_no_rows(spark):
    rows = corpus(4, 60)
    assert run(spark, rows, window=5) == brute(rows, 5)
    assert run(spark, rows, window=1) == brute(rows, 1)
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        repeats.repeat_starts(spark.createDataFrame([], SCHEMA), 12)


def test_packing_round_trip():
    import numpy as np

    arrays = [np.arange(5, dtype=np.int64), np.array([], np.uint16), np.array([1, 2**32 - 1], np.uint32), np.array([7], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, exchange.unpack(exchange.pack(arrays)), strict=True))
