"""The pipeline's stages against brute force, and the whole on the driver's small tables."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from palimpsest.llm import mixing, toxicity
from tests_llm_brute import groups, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], SF))
    return [[r.asDict() for r in d.collect()] for d in found]


def test_columns_and_contract(steps):
    assert all(set(r) == set(corpus_pipeline.COLUMNS) for rows in steps[:-1] for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixture", "bpe"]


def test_toxic_documents_go_and_others_stay(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in steps[1]} == want


def test_one_document_of_each_group_stays(steps):
    found = groups([(r["doc_id"], r["text"]) for r in steps[1]])
    assert {r["doc_id"] for r in steps[2]} == {d for d, _, c in found if c == d}


def test_repeated_passages_go(steps):
    want = {d: (gone, kept) for d, _, gone, kept in repeats([(r["doc_id"], r["text"]) for r in steps[2]])}
    before = {r["doc_id"]: r for r in steps[2]}
    for r in steps[3]:
        gone, kept = want[r["doc_id"]]
        assert r["text"] == (kept if gone else before[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"])
    assert len(steps[3]) == len(steps[2]) and any(gone for gone, _ in want.values())


def test_mixture_takes_copies(spark, steps):
    rows = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in steps[3]], "doc_id long, text string, source string")
    want = {r.doc_id: r.copies for r in mixing.sampled(rows).collect()}
    assert Counter(r["doc_id"] for r in steps[4]) == Counter({d: n for d, n in want.items() if n})


def test_tokens_are_the_library_s(steps):
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in steps[4]:
        ids = enc.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in steps[5]) == want


def test_run_is_the_stages(spark, steps):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(tuple(r.values()) for r in steps[5])


def test_words_rule():
    assert re.findall("[^\x20\x09-\x0d]+", "a\x0bb\x1cc") == ["a", "b\x1cc"]


def test_stages_take_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " x", "en", "a", 5), (2, "other", None, None, None), (None, "no id " * 30, "en", "a", 5), (None, None, None, None, None), (3, "", "en", "b", 0), (4, "long " * 30000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        after[name] = stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted((r.doc_id, r.text) for r in after["near_duplicates"] if r.doc_id) == [(1, text), (1, text), (2, "other"), (3, ""), (4, "long " * 30000)]
    assert len(after["repeats"]) == len(rows) and [r.text for r in after["repeats"] if r.doc_id == 2 and r.lang] == ["x"]
    want = Counter()
    for r in mixing.sampled(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in after["mixture"]) == +want
    assert len(after["bpe"]) == len(rows)
