"""Sharding, host rules, mixing and URL lists against brute force and on odd inputs."""

import re
import zlib
from collections import Counter, defaultdict

from palimpsest.llm import host_quality, mixing, sharding, url_lists

DOCS = "doc_id long, text string, source string, shard string, cell string, words string, size string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS)


ODD = [
    (1, "a b c", "s1"), (2, None, "s1"), (3, "", None), (4, "a b c", "s2"), (4, "a b c", "s2"), (None, "x", "s1"),
    (-7, "é" * 50 + " b", "s3"), (2**62, "w " * 30000, "s2"), (9, "line one two\nline one two\n\nz", "s3"),
]


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [*range(300), -1, -5, 2**63 - 1, -(2**63), 123456789012345]
    rows = spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(rows).collect()}
    assert got == {k: (jump(k, 16), jump(k, 17)) for k in keys}
    assert all(a == b or b == 16 for a, b in got.values())


def test_shards_of_odd_rows(spark):
    got = sharding.assign_shards(make(spark, ODD), shards=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, 3)) for i, t, _ in ODD)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.assign_shards(make(spark, [])).count() == 0


def measured(text):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    spots = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = Counter(spots)
    covered = {j for i, w in enumerate(spots) if n[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_host_rules_on_odd_rows(spark):
    more = [(20, "a b c d e f g h i " * 3 + "k " * 40, "s4"), (21, "p q r s t u v w x y " * 2 + " ".join(map(str, range(60))), "s4"), (22, "a# b|\x0bc\x1cd", "s4")]
    rows = ODD + more
    got = host_quality.host_rules(make(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *measured(t)) for i, t, _ in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert host_quality.host_rules(make(spark, [])).count() == 0


def test_a_bad_host_takes_its_good_documents_along_and_a_small_one_is_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "no"
    rows = [(i, good, f"h{i % 10}") for i in range(1000)] + [(2000 + i, bad, "spam") for i in range(99)] + [(3000, good, "spam"), (3001, bad, "tiny")]
    got = {r.doc_id: r for r in host_quality.host_rules(make(spark, rows)).collect()}
    assert not got[3000].kept and all(got[i].kept for i in range(1000))
    assert got[3000].host_docs == 100 and got[3000].host_failed == 99


def test_mixing_meets_targets_and_agrees_with_itself(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 7}" if i % 7 else None) for i in range(3000)] + [(5000, None, "t"), (5001, "", "t"), (None, "a b", "t"), (None, "a b", "t")]
    got = mixing.sampled(make(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.sampled(make(spark, rows[::-1])).collect()), key=str)
    taken, aims, sizes = Counter(), {}, Counter()
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        aims[r.source] = r.target
    assert abs(sum(aims.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(aims[s] <= 2 * sizes[s] + 1e-9 for s in aims) and all(abs(taken[s] - aims[s]) <= 0.02 * aims[s] + 4 for s in aims)
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, left, want = set(order), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        want |= {s: 2 * sizes[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(want[s] - aims[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert mixing.sampled(make(spark, [])).count() == 0


def test_lists_hold_from_entry_to_next_entry(spark):
    entries = spark.sql("SELECT key, CAST(at AS timestamp_ntz) AS at, action FROM VALUES ('B.org', '2024-01-01', 'block'), ('b.org', '2024-03-01', 'lift'), ('a.b.org', '2024-02-01', 'allow'), ('b.org/x', '2024-01-15', 'block'), (NULL, '2024-01-01', 'block') AS t(key, at, action)")
    rows = [
        (1, "http://b.org/", "2023-12-31", False), (2, "http://b.org", "2024-01-01", True), (3, "https://u:p@c.A.b.org:80/q", "2024-01-10", True), (4, "https://a.b.org/q", "2024-02-01", False),
        (5, "http://b.org/", "2024-03-01", False), (6, "http://a.b.org/x/y", "2024-04-01", False), (7, "http://b.org/X?y", "2024-04-01", True), (8, None, "2024-01-02", False), (9, "b.org", "2024-01-02", False),
        (10, "http://b.org/", None, False), (10, "http://b.org/", "2024-01-02", True), (10, "http://b.org/", "2024-01-02", True), (11, "http://" + "b." * 5000 + "org/", "2024-01-02", False), (12, "http://bb.org/", "2024-01-02", False), (13, "", "2024-01-02", False),
    ]
    captures = spark.createDataFrame([(i, u, t, "x") for i, u, t, _ in rows], "page_id long, url string, at string, key string").selectExpr("page_id", "url", "CAST(at AS timestamp_ntz) AS fetched", "key", "1 AS since")
    assert Counter((r.page_id, r.blocked) for r in url_lists.as_listed(captures, entries).collect()) == Counter((i, b) for i, _, _, b in rows)
    assert not any(r.blocked for r in url_lists.as_listed(captures, entries.limit(0)).collect())
    assert url_lists.as_listed(captures.limit(0), entries).count() == 0
