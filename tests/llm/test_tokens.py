"""Token files and byte-level BPE against the libraries, and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from palimpsest.llm import bpe, pieces, token_files  # noqa: E402

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, start string, part string"


def odd_texts():
    rnd = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "1", "'s", "'ll", "!", "\x1c", "\xa0", "ab", "the", " the", "<|endoftext|>", "\U0001f600", "\x00"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(200)]
    return [None, "", " ", "a" * 3000, " " * 500, "word " * 20000, "x y" * 300, *made, "same", "same"]


def rows(spark, texts=None):
    texts = odd_texts() if texts is None else texts
    return [(i if i != 5 else None, t) for i, t in enumerate(texts)], spark.createDataFrame([(i if i != 5 else None, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def test_bpe_equals_the_library_and_decodes_back(spark):
    import tiktoken

    data, df = rows(spark)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(RANKS, P.PATTERN).ranks.rank, special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in data}
    encoded = bpe.encode(df, RANKS, P.PATTERN)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: (r.text, bytes(r.bytes)) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()} == {i: (t or "", (t or "").encode()) for i, t in data}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()}
    assert got == {i: (len(want[i]), sha(",".join(map(str, want[i])).encode()), sha((t or "").encode())) for i, t in data}
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_short_and_long_merges_agree():
    ranks, rnd = bpe.codec(RANKS, P.PATTERN).ranks, random.Random(2)
    pieces = [bytes(rnd.choice(b"theinos \xc3\xa9") for _ in range(rnd.randrange(1, 33))) for _ in range(500)]
    flat, n = bpe.merge_rows(ranks, pieces, 32)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [bpe.merge_long(ranks, p) for p in pieces]


def test_files_hold_what_the_library_encodes(spark, tmp_path):
    from tokenizers import Tokenizer

    data, df = rows(spark)
    tokenizer = Tokenizer.from_file(JSON)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in data}
    out = str(tmp_path / "ids")
    token_files.write_ids(df, out, JSON, P.PATTERN, 2, shard=5000)
    got = {r.doc_id: r for r in token_files.read_ids(spark, out).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    start = 0
    for i in sorted(want, key=lambda i: (i is not None, i)):
        assert (got[i].start, got[i].n_tokens) == (start, len(want[i]))
        start += len(want[i])
    sums = {r.doc_id: r.ids_crc32 for r in token_files.read_checksums(spark, out).collect()}
    assert sums == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}
    long = max((i for i in want if i is not None), key=lambda i: len(want[i]))
    for first, n in ((0, 3), (17, 1), (100, 900), (len(want[long]) - 2, 10)):
        assert token_files.read_span(spark, out, long, first, n) == [want[long][first : first + n]]


def test_repeated_ids_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(7, "b"), (7, "b"), (7, "a c"), (3, "z")], "doc_id long, text string")
    token_files.write_ids(df, str(tmp_path / "a"), JSON, P.PATTERN, 2)
    got = token_files.read_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [3, 7, 7, 7] and [r.start for r in got] == [0, *np.cumsum([len(r.ids) for r in got])[:-1].tolist()]
    token_files.write_ids(df.limit(0), str(tmp_path / "b"), JSON, P.PATTERN, 2)
    assert token_files.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_grammar_round_trip():
    rnd = np.random.default_rng(1)
    for n, kinds in ((0, 5), (1, 5), (5000, 3), (5000, 1), (20000, 300)):
        ids = rnd.integers(0, kinds, n)
        ends = np.sort(np.concatenate([rnd.integers(0, n + 1, 20), [n]]))
        rules, lengths, seq, stops = token_files.compress(ids, ends, 500, least=4)
        grammar = token_files.Grammar(500, rules, lengths)
        assert grammar.expand(seq)[0].tolist() == ids.tolist()
        assert np.concatenate(([0], np.cumsum(grammar.lengths[seq])))[stops].tolist() == ends.tolist()
        assert n < 5000 or len(seq) < n


def most_frequent(seq, stops):
    """How often the most frequent pair of adjacent symbols of one document occurs, overlaps not counted."""
    count = {}
    for own in np.split(seq, stops[:-1]):
        at, last = 0, {}
        for at, pair in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True)):
            if last.get(pair, -2) < at - 1:
                count[pair], last[pair] = count.get(pair, 0) + 1, at
    return max(count.values(), default=0)


def test_no_frequent_pair_is_left():
    rnd = np.random.default_rng(2)
    passage = rnd.integers(0, 400, 300)
    copies = np.concatenate([np.concatenate([rnd.integers(0, 400, 5), passage]) for _ in range(2000)])
    for ids, least in ((rnd.integers(0, 30, 30000), 16), (copies, 16), (np.full(100000, 7), 16), (np.arange(50000) // 3 % 5, 4), (rnd.zipf(1.3, 50000) % 400, 16)):
        ends = np.unique(np.append(rnd.integers(1, len(ids), 40), len(ids)))
        rules, lengths, seq, stops = token_files.compress(ids, ends, 400, least=least)
        grammar = token_files.Grammar(400, rules, lengths)
        assert grammar.expand(seq)[0].tolist() == ids.tolist()
        assert np.concatenate(([0], np.cumsum(grammar.lengths[seq])))[stops].tolist() == ends.tolist()
        assert most_frequent(seq, stops) < least
        assert ids is not copies or lengths.max() >= 300


def test_a_rare_pair_of_id_0_among_frequent_pairs():
    ids = np.array([*[1, 2] * 500, 0, 0, *[3, 4] * 500])
    rules, lengths, seq, _ = token_files.compress(ids, np.array([len(ids)]), 10)
    assert token_files.Grammar(10, rules, lengths).expand(seq)[0].tolist() == ids.tolist()


def test_spans_follow_only_the_rules_they_need():
    rng = np.random.default_rng(4)
    phrase = rng.integers(0, 30, 200)
    ids = np.concatenate([np.concatenate([phrase, rng.integers(0, 30, 10)]) for _ in range(60)]).astype(np.int32)
    rules, lengths, symbols, _ = token_files.compress(ids, np.array([len(ids)]), 30)
    assert lengths.max() > 64
    for first, n in ((0, 5), (37, 400), (len(ids) - 3, 10), (len(ids), 4), (500, 0), (0, len(ids))):
        assert token_files.expanded_span(30, rules, lengths, symbols, first, n) == ids[first : first + n].tolist()
    # A span in the middle of long rules doesn't touch rules beside it.
    broken = rules.copy()
    broken[~np.isin(np.arange(len(rules)), needed(30, rules, lengths, symbols, 1000, 3))] = 10**6
    assert token_files.expanded_span(30, broken, lengths, symbols, 1000, 3) == ids[1000:1003].tolist()


def needed(base, rules, lengths, symbols, first, n):
    """Rules whose expansion overlaps the span."""
    out, at = set(), 0

    def down(s, at):
        if s >= base and at < first + n and at + lengths[s - base] > first:
            out.add(s - base)
            left = rules[s - base, 0]
            down(left, at)
            down(rules[s - base, 1], at + (1 if left < base else lengths[left - base]))

    for s in symbols:
        down(s, at)
        at += 1 if s < base else lengths[s - base]
    return sorted(out)


def test_pairs_that_cannot_be_frequent_are_not_sorted(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 200_000).astype(np.int32)
    ids[:4000] = np.tile([7, 8, 9, 10], 1000)
    seen, plain = [], token_files._sorted_pairs
    monkeypatch.setattr(token_files, "_sorted_pairs", lambda left, *rest: seen.append(len(left)) or plain(left, *rest))
    rules, lengths, symbols, ends = token_files.compress(ids, np.array([1500, 200_000]), 50_000)
    grammar = token_files.Grammar(50_000, rules, lengths)
    assert np.array_equal(grammar.expand(symbols)[0], ids) and grammar.expand(symbols[: ends[0]])[1].sum() == 1500
    assert len(rules) and seen[0] < 20_000


def test_strings_without_spaces_are_listed():
    for parts in ([], [""], ["", ""], ["a"], ["", "a", "\n", "\uffff", "\x00", "\u65e5\u672c", "\U0001f600"]):
        assert pieces._unspaced(pa.array(parts, pa.string())) == parts


def test_every_control_character_is_shown_to_the_model_as_the_library_does():
    from tokenizers import Tokenizer

    texts = [f"a{chr(c)}b x{chr(c)}{chr(c)} {chr(c)}y end.{chr(c)}Start" for c in range(128)]
    tokenizer = Tokenizer.from_file(JSON)
    flat, n = token_files.Encoder(JSON, P.PATTERN).table.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_not_translated_character_by_character():
    """Counts characters that the slow translation looks up: it asks a dict for each of them."""
    asked = []

    class Shown(dict):
        def __getitem__(self, c):
            asked.append(c)
            return super().__getitem__(c)

    own = token_files.Encoder(JSON, P.PATTERN)
    own.shown = Shown(own.shown)
    own.table.encode(pa.array([" ".join(f"word{i}" for i in range(3000))]))
    assert len(asked) < 100


def test_pieces_of_other_scripts_go_to_the_model_too():
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    letters = ["a", "b", "é", "ß", "ж", "日", "٣", "²", "́", "…", ",", "\U0001f600", "'s", "1", "\n", "­", "\u0085", "　", "᠎", "​", "\U0001e4d0", "Ɤ"]
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(60)) for _ in range(60)]
    tokenizer = Tokenizer.from_file(JSON)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoded = lambda own, texts: [x.tolist() for x in (lambda flat, n: np.split(flat, np.cumsum(n)[:-1]))(*own.table.encode(pa.array(texts)))]
    assert encoded(token_files.Encoder(JSON, P.PATTERN), texts) == want
    # Characters on which library and pattern don't agree go to the library with their chunks.
    own, whole = token_files.Encoder(JSON, P.PATTERN), []
    plain = own._whole
    own._whole = lambda chunks: whole.extend(chunks) or plain(chunks)
    own.agreed["ж"] = False
    assert encoded(own, ["x café garçon жук naïve", "x 日本 été."]) == [tokenizer.encode(t, add_special_tokens=False).ids for t in ("x café garçon жук naïve", "x 日本 été.")]
    assert sorted(whole) == [" жук", "x"]


def test_known_chunks_are_not_encoded_again_until_the_table_is_full():
    asked = []

    def encode(chunks):
        asked.extend(chunks)
        return np.fromiter(map(len, chunks), np.int32, len(chunks)), np.arange(len(chunks)), np.ones(len(chunks), np.int64)

    table = pieces.ChunkTable(encode, str.split, most=64)
    texts = pa.array(["a bb ccc bb", "a ccc dddd"])
    for _ in range(2):
        assert table.encode(texts)[0].tolist() == [1, 3, 4, 3, 1, 4, 5]
        assert sorted(asked) == [" a", " bb", " ccc", " dddd", "a"]
    table.encode(pa.array(["a " + "x" * 100]))
    asked.clear()
    assert table.encode(texts)[0].tolist() == [1, 3, 4, 3, 1, 4, 5]
    assert sorted(asked) == [" a", " bb", " ccc", " dddd", "a"]


def test_pairs_are_not_hashed_where_few_would_be_dropped(monkeypatch):
    """The hash of all places is the largest part of a round in which most pairs are frequent."""
    rng, seen, plain = np.random.default_rng(3), [], token_files._not_alone
    ids = rng.integers(0, 60, 400_000).astype(np.int32)
    monkeypatch.setattr(token_files, "_not_alone", lambda left, *rest: seen.append(len(left)) or plain(left, *rest))
    rules, lengths, symbols, _ = token_files.compress(ids, np.array([len(ids)]), 60)
    assert np.array_equal(token_files.Grammar(60, rules, lengths).expand(symbols)[0], ids)
    assert seen[0] < len(ids) // 7 and sum(x > 300_000 for x in seen) == 0


def test_texts_are_cut_as_the_library_cuts_them_where_the_pattern_knows_newer_letters():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    texts = [f"a  {chr(c)}'s {chr(c)}b\n {chr(c)}1" for c in (0x16EA3, 0x18FBE, 0x85, 0xA0, 0xE9, 0x65E5)]
    flat, n = token_files.Encoder(JSON, P.PATTERN).table.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
