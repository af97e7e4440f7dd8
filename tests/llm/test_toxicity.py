"""Toxicity: held-out accuracy, misspellings, odd rows."""

import tracemalloc
import zlib

import numpy as np

from palimpsest.llm import common, toxicity
from palimpsest.llm.queries import op2_subword_toxicity

RUDE = ["numskull", "blockhead", "nitwit"]


def corpus(n=1200, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abdefhilmnoprstu"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(5, 200)))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(1 + len(words) // 60):
                words.insert(int(rng.integers(len(words))), str(rng.choice(RUDE)))
        rows.append((i, " ".join(words), toxic))
    return rows


def fitted(rows):
    return toxicity.train([toxicity.counted(t) for _, t, _ in rows], np.array([y for *_, y in rows]))


def plain_buckets(word):
    """Buckets of a word's n-grams and of the word, by loops over Python's integers."""
    mask, out = (1 << 64) - 1, []

    def mix(x):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = ((x ^ (x >> shift)) * factor) & mask
        return x ^ (x >> 33)

    w = [ord(c) for c in f"<{word}>"]
    for k in toxicity.GRAMS:
        for i in range(len(w) - k + 1):
            h = 0
            for c in w[i : i + k]:
                h = (h * 0x100000001B3 + c) & mask
            out.append(mix((h + k) & mask) % toxicity.BUCKETS)
    out.append(mix(sum(mix((c * 0x9E3779B97F4A7C15 + i) & mask) for i, c in enumerate(w)) & mask) % toxicity.BUCKETS)
    return out


def plain_score(model, text):
    found = [b for w in (text or "").lower().split() for b in plain_buckets(w)]
    return 1 / (1 + np.exp(-(sum(model.row[b] for b in found) / max(1, len(found)) + model.bias)))


def test_scores_are_those_of_plain_loops():
    rows = corpus(300)
    model = fitted(rows)
    texts = [t for _, t, _ in rows[:60]] + ["", None, "a", "\u4e2d\u6587 \U0001f600 x", "Numskull! BLOCKHEAD", "w " * 3000]
    assert np.allclose(model.scorer().score(texts), [plain_score(model, t) for t in texts], atol=1e-9)


def test_bags_are_those_of_plain_loops():
    texts = ["ab abc ab", "abc", "", "xyz ab", "abc xyz"]
    common, buckets, shares, sizes = toxicity.bags([toxicity.counted(t) for t in texts], 2)
    each = [[b for w in t.split() for b in plain_buckets(w)] for t in texts]
    often = sorted({b for e in each for b in e if sum(b in x for x in each) >= 2})
    assert common.tolist() == often
    at = 0
    for e, n in zip(each, sizes.tolist(), strict=True):
        got = dict(zip(common[buckets[at : at + n]].tolist(), shares[at : at + n].tolist(), strict=True))
        assert got == {b: np.float32(e.count(b) / len(e)) for b in e if b in often}
        at += n


def test_bags_are_held_once():
    """What the driver takes while bags are made is little more than the bags."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(rng.choice(list("abdefhilmnoprstu"), 8)) for _ in range(2000)])
    texts = [toxicity.counted(" ".join(rng.choice(vocabulary, 1200))) for _ in range(150)]
    tracemalloc.start()
    made = toxicity.bags(texts, 4)
    held, peak = sum(x.nbytes for x in made), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held > 10_000_000 and peak < 1.6 * held


def test_native_memory_of_the_driver_is_given_back(spark, monkeypatch):
    assert common.tidy_driver(spark)
    seen, plain = [], common.tidy_driver
    monkeypatch.setattr(common, "tidy_driver", lambda s: seen.append(plain(s)))
    assert common.written(spark.range(10), "tidied").count() == 10
    assert seen == [True]


def test_gradients_are_those_of_differences():
    """A step's gradients against differences of the loss, which is computed by a plain loop over texts."""
    rng = np.random.default_rng(0)
    table, layer, offset = rng.normal(0, 1, (6, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)
    texts = [([0, 2, 5], [0.2, 0.5, 0.3]), ([1], [1.0]), ([], []), ([2, 3], [0.6, 0.4])]
    own, part = np.array([b for t, _ in texts for b in t]), np.array([p for _, s in texts for p in s])
    of = np.repeat(np.arange(4), [len(t) for t, _ in texts])
    wanted = np.array([[0.98, 0.02], [0.02, 0.98], [0.98, 0.02], [0.02, 0.98]])

    def plain(table, layer, offset):
        total = 0.0
        for (t, s), w in zip(texts, wanted, strict=True):
            mean = sum((p * table[b] for b, p in zip(t, s, strict=True)), np.zeros(3))
            odds = 2.0 * (mean @ layer) + offset
            total -= (w * (odds - np.log(np.exp(odds).sum()))).sum()
        return total / len(texts)

    loss, gradients = toxicity.loss_and_gradients(table, layer, offset, own, part, of, wanted, 2.0)
    assert abs(loss - plain(table, layer, offset)) < 1e-9
    for i, g in enumerate(gradients):
        for at in np.ndindex(g.shape):
            moved = [x.copy() for x in (table, layer, offset)]
            moved[i][at] += 1e-6
            assert abs((plain(*moved) - plain(table, layer, offset)) / 1e-6 - g[at]) < 1e-3


def test_held_out_rows_and_unseen_misspellings():
    rows = corpus()
    model = fitted(rows[:900])
    scores = model.scorer().score([t for _, t, _ in rows[900:]])
    assert ((scores >= 0.5) == np.array([y == 1 for *_, y in rows[900:]])).mean() > 0.97
    odd = model.scorer().score(["du numskul fa", "blockheadd re", "", None, "du fa re"])
    assert odd[0] > 0.5 and odd[1] > 0.5 and max(odd[2:]) < 0.5
    assert (fitted(rows[:900]).row == model.row).all()


def test_scores_do_not_depend_on_batches():
    rows = corpus(200)
    model = fitted(rows)
    texts = [t for _, t, _ in rows]
    small = toxicity.Scorer(model, limit=50)
    assert np.allclose(model.scorer().score(texts), np.concatenate([small.score(texts[i : i + 7]) for i in range(0, 200, 7)]))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "x", 5), (2, None, 5), (3, "", 5), (4, "long " * 50000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_driver_table(spark):
    got = {r.doc_id: r for r in op2_subword_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    own = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    assert len(got) == 1000 and sum(a == b for a, b in own) > 0.9 * len(own)


def test_thousands_of_labels_are_all_fitted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.extend(w for w, _ in texts))
    docs = spark.range(7000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic"))
    assert sorted(seen) == sorted(f"text {i}" for i in range(7000) if zlib.crc32(str(i).encode()) % 5)


def test_length_is_no_bar_to_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.extend(texts))
    docs = spark.createDataFrame([(1, "Long word " * 30000), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    toxicity.fit(docs, docs.selectExpr("doc_id", "1 AS toxic"))
    got = {w: c.tolist() for w, c in seen}
    assert got.get("long word", [30000, 30000]) == [30000, 30000] and len(seen) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in (1, 2, 4))
