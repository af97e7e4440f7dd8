"""Operators of the library against fixtures with known answers."""

import hashlib
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from palimpsest.functions import ids, packfile, paths, times
from palimpsest.model import Config, PackSizing
from palimpsest.operators import check, chunks, index, order, packing, prune, restore, retention, snapshots, trees, vfs
from palimpsest.sources import store
from pyspark.sql import functions as F

SNAPS = "id string, time timestamp_ntz, tree string, tags array<string>, hostname string, label string, paths array<string>, delete_kind string, delete_after timestamp_ntz, parent string"


def snap(i, t, tree="t", tags=(), host="h", label="l", kind="NotSet", after=None):
    return (f"{i:064x}", datetime.fromisoformat(t), tree, list(tags), host, label, ["/p"], kind, after and datetime.fromisoformat(after), None)


def plain_retention(rows, counts, within=None):
    """Newest first with a counter for each rule."""
    key = {
        "last": lambda t: object(), "hourly": lambda t: (t.year, t.timetuple().tm_yday, t.hour), "daily": lambda t: (t.year, t.timetuple().tm_yday), "weekly": lambda t: (t.year, t.isocalendar().week),
        "monthly": lambda t: (t.year, t.month), "quarter-yearly": lambda t: (t.year, (t.month - 1) // 3), "half-yearly": lambda t: (t.year, (t.month - 1) // 6), "yearly": lambda t: t.year,
        "minutely": lambda t: (t.year, (t.month - 1) // 6, t.minute),
    }
    rows, left, out = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])), dict(counts), []
    for i, r in enumerate(rows):
        said = []
        for rule in retention.RULES:
            if rule in left and (i == 0 or i == len(rows) - 1 or key[rule](r[1]) != key[rule](rows[i - 1][1])) and left[rule]:
                left[rule] -= 1
                said.append(rule)
            if within and rule in within and r[1] + within[rule] > rows[0][1]:
                said.append("within" if rule == "last" else f"within {rule}")
        out.append((r[0], bool(said), said))
    return sorted(out)


@pytest.mark.parametrize("counts", [{"last": 3}, {"daily": 5, "weekly": 2}, {"hourly": -1}, {"monthly": 2, "yearly": 0}, {"minutely": 9}, {"quarter-yearly": 4, "half-yearly": 2, "yearly": 3, "last": 1}])
def test_retention_equals_the_counting_walk(spark, counts):
    rnd, start = random.Random(1), datetime(2014, 1, 1)
    rows = [snap(i, (start + timedelta(minutes=rnd.randrange(1_100_000))).isoformat()) for i in range(150)] + [snap(900, "2015-01-01T00:00:00"), snap(901, "2015-01-01T00:00:00"), snap(902, "2014-12-31T10:00:00")]
    got = retention.retained(spark.createDataFrame(rows, SNAPS), retention.Keep(counts=counts, within={"daily": "INTERVAL 30 DAYS"}))
    assert sorted((r.id, r.keep, r.reasons) for r in got.collect()) == plain_retention(rows, counts, {"daily": timedelta(days=30)})


def test_retention_by_cells_is_the_same(spark):
    rnd, start = random.Random(7), datetime(2014, 1, 1)
    rows = [snap(i, (start + timedelta(minutes=rnd.randrange(900_000))).isoformat(), f"t{rnd.randrange(3)}", host=rnd.choice(["a", "b", "c"]), kind=rnd.choice(["NotSet"] * 6 + ["Never", "After"]), after="2015-01-01T00:00:00") for i in range(300)]
    df = spark.createDataFrame(rows, SNAPS).withColumn("hostname", F.when(F.col("hostname") != "c", F.col("hostname")))
    keep = retention.Keep(counts={"last": 3, "daily": 9, "weekly": 5, "monthly": -1, "yearly": 1}, within={"daily": "INTERVAL 20 DAYS"}, delete_unchanged=True)
    now = F.lit(datetime(2015, 1, 1)).cast("timestamp_ntz")
    shown = lambda **k: sorted((r.id, r.keep, r.reasons) for r in retention.retained(df, keep, by=["hostname"], now=now, **k).collect())
    assert shown() == shown(cell="month") == shown(cell="day")


def test_retention_flags_tags_ids_and_unchanged(spark):
    now = F.lit(datetime(2020, 1, 1)).cast("timestamp_ntz")
    rows = [
        snap(1, "2019-01-01T00:00:00", "a"), snap(2, "2019-01-02T00:00:00", "a"), snap(3, "2019-01-03T00:00:00", "b", ["x", "y"]), snap(4, "2019-01-04T00:00:00", "c", kind="Never"),
        snap(5, "2019-01-05T00:00:00", "d", kind="After", after="2019-12-31T00:00:00"), snap(6, "2019-01-06T00:00:00", "e", kind="After", after="2020-01-01T00:00:00"),
    ]
    df = spark.createDataFrame(rows, SNAPS)
    got = {int(r.id, 16): (r.keep, r.reasons) for r in retention.retained(df, retention.Keep(tags=[["y"], ["z"]], ids=["0" * 63 + "1"], counts={"last": 0}, delete_unchanged=True), now=now).collect()}
    assert got == {1: (True, ["id"]), 2: (False, ["unchanged"]), 3: (True, ["tags"]), 4: (True, ["snapshot"]), 5: (False, ["snapshot"]), 6: (True, ["snapshot"])}
    with pytest.raises(ValueError):
        retention.retained(df, retention.Keep())
    assert retention.retained(df.limit(0), retention.Keep(counts={"last": 1})).count() == 0
    assert [int(r.id, 16) for r in retention.forgotten(retention.forced(df, now)).orderBy("id").collect()] == [1, 2, 3, 5]


def test_requests(spark):
    rows = [("0011" + "0" * 59 + "1", datetime(2025, 7, 14, 9)), ("0021" + "0" * 59 + "2", datetime(2025, 7, 14, 10)), ("0031" + "0" * 59 + "3", datetime(2025, 7, 14, 11))]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz")
    last = lambda r: [x.id[-1] for x in snapshots.requested(df, r).collect()]
    assert last(["latest"]) == ["3"] and last(["latest~1"]) == ["2"] and last(["003"]) == ["3"]
    assert last(["latest~2", "002", rows[2][0], "002"]) == ["1", "2", "3", "2"]
    with pytest.raises(snapshots.NotFound, match="No snapshots found for latest~3."):
        last(["latest~3"])
    with pytest.raises(snapshots.NotFound, match="No suitable id found for `laztet~1`."):
        last(["laztet~1"])
    with pytest.raises(snapshots.NotUnique):
        last(["00"])


def test_groups_tags_and_changes(spark):
    df = spark.createDataFrame([snap(1, "2020-01-01T00:00:00", tags=["b", "a"]), snap(2, "2020-01-02T00:00:00", tags=["a"], host="g"), snap(3, "2020-01-03T00:00:00", tags=["a", "b"])], SNAPS)
    assert [(r.group.hostname, r.snapshots) for r in snapshots.grouped(df, snapshots.criterion("host")).collect()] == [("g", 1), ("h", 2)]
    assert snapshots.grouped(df, snapshots.criterion("tags")).count() == 2 and snapshots.grouped(df, ()).count() == 1
    with pytest.raises(ValueError):
        snapshots.criterion("host,size")
    assert df.where(snapshots.in_group({"hostname": None, "tags": ["b", "a"]})).count() == 2
    changed = {int(r.id, 16): (r.tags, r.changed) for r in snapshots.modified(df, add_tags=["b"], remove_tags=["c"]).collect()}
    assert changed == {1: (["b", "a"], False), 2: (["a", "b"], True), 3: (["a", "b"], False)}
    assert {r.parent for r in snapshots.parents_of(df.drop("parent").where("hostname = 'h'").limit(1), df).collect()} == {f"{3:064x}"}
    with pytest.raises(PermissionError):
        snapshots.without(df, df, Config(append_only=True))


def test_subsets_of_ids_and_names_of_them(spark):
    some = spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(),) for i in range(200)], "id string")
    parts = [packing.subset_nm(some, n, 5) for n in range(1, 6)]
    assert sum(p.count() for p in parts) == 200
    x = some.select("id", ids.as_u32(F.col("id")).alias("u")).first()
    assert x.u == int.from_bytes(bytes.fromhex(x.id)[:4], "little")
    now = datetime(2024, 10, 11, 12)
    assert times.named_subset(now, "weekly", "year") == (40, 52) and times.named_subset(now, "daily", "week") == (4, 7) and times.named_subset(now, "hourly", "week") == (108, 168)
    sized = some.withColumn("size", F.lit(10).cast("long"))
    assert packing.subset_size(sized, limit=101).count() == 10 and packing.subset_size(sized, percent=50.0).count() == 99


def test_pack_sizes_and_reads(spark):
    sizes = spark.createDataFrame([(x,) for x in (0, 10, 1010, 101010, 201010, 301010, 10301010)], "n long")
    tree, data = PackSizing(4194304, 32, 5 * 1024 * 1024), PackSizing(33554432, 32)
    assert [r[0] for r in sizes.select(packing.target_size(F.col("n"), tree)).collect()] == [4194304, 4194400, 4195296, 4204448, 4208640, 4211840, 4296992]
    assert [r[0] for r in sizes.select(packing.target_size(F.col("n"), data)).collect()][:3] == [33554432, 33554528, 33555424]
    kib, mib = 1024, 1024 * 1024
    for a, n, b, m, want in ((12, 123, 134, 123, None), (12, 123, 135, 123, 246), (12, 123, 135 + 256 * kib, 123, 246 + 256 * kib), (12, 123, 136 + 256 * kib, 123, None), (0, 20 * mib, 20 * mib, 20 * mib, 40 * mib), (0, 20 * mib, 20 * mib, 20 * mib + 1, None)):
        got = packing.coalesced(spark.createDataFrame([("p", a, n), ("p", b, m)], "pack_id string, offset long, length long")).collect()
        assert [r.length for r in got] == ([want] if want else [n, m])
    got = packing.filled(spark.createDataFrame([("w", i, x) for i, x in enumerate([5, 5, 5, 12, 1, 1, 1])], "writer string, pos int, length long"), "writer", ["pos"], 10, 3).orderBy("pos").collect()
    assert [r.pack_no for r in got] == [0, 0, 1, 1, 2, 2, 2]


def test_chunks(spark):
    rnd = random.Random(5)
    data = bytes(rnd.randrange(256) for _ in range(60_000))
    options = dict(size=1024, least=256, most=4096)
    ends = chunks.cuts(data, **options)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(256 <= s <= 4096 for s in sizes[:-1]) and 40 < len(sizes) < 120
    shifted = chunks.cuts(b"xyz" * 30 + data, **options)
    assert len({e - 90 for e in shifted} & set(ends)) > len(ends) * 0.8
    assert chunks.cuts(b"") == [] and chunks.cuts(b"ab") == [2] and chunks.cuts(bytes(10_000), **options)[0] == 256
    # The hash by its definition, bit by bit.
    window = int.from_bytes(data[ends[0] - 64 : ends[0]], "big")
    assert chunks._reduce(window, chunks.POLYNOMIAL) & 1023 == 0
    df = spark.createDataFrame([("f", bytearray(data)), ("e", bytearray(b"")), ("n", None)], "path string, content binary")
    got = chunks.content_defined(df, **options).orderBy("pos").collect()
    assert [r.offset + r.length for r in got] == ends and got[0].blob_id == hashlib.sha256(data[: ends[0]]).hexdigest()
    fixed = chunks.fixed(df, 25_000)
    assert [(r.pos, r.length) for r in fixed.orderBy("pos").collect()] == [(0, 25000), (1, 25000), (2, 10000)]
    with pytest.raises(ValueError):
        chunks.cuts(data, size=1000)


NODES = "tree_id string, name string, type string, size long, subtree string, content array<string>"


def small_trees(spark):
    return spark.createDataFrame([
        ("r1", "a", "dir", None, "s", None), ("r1", "f", "file", 3, None, ["b1", "b2"]), ("r2", "b", "dir", None, "s", None), ("r2", "c", "dir", None, "e", None),
        ("s", "x", "file", 5, None, ["b2", "b3"]), ("s", "d", "dir", None, "u", None), ("u", "y.txt", "file", 7, None, ["b4"]),
    ], NODES)


def test_trees(spark):
    nodes, roots = small_trees(spark), spark.createDataFrame([("1", "r1"), ("2", "r2")], "root string, tree_id string")
    assert {(r.tree_id, r.depth) for r in trees.reachable(roots, nodes).collect()} == {("r1", 0), ("r2", 0), ("s", 1), ("e", 1), ("u", 2)}
    every = trees.closure(roots, nodes)
    assert [r.path for r in trees.listed(every.where("root = '1'")).orderBy("pos").collect()] == ["a", "a/d", "a/d/y.txt", "a/x", "f"]
    assert {r.path for r in trees.listed(every, ["!d"]).collect()} == {"a", "a/d/y.txt", "a/x", "f", "b", "b/d/y.txt", "b/x", "c"} - set()
    assert {(r.root, r["size"]) for r in trees.at_path(roots, nodes, "a/d/y.txt").collect()} == {("1", 7), ("2", None)}
    assert [r.path for r in trees.matching(every.where("root = '1'"), F.col("path").startswith("a")).orderBy("pos").collect()] == ["a/d/y.txt", "a/d", "a/x", "a"]
    assert {r.blob_id for r in trees.used_blobs(roots, nodes).collect()} == {"r1", "r2", "s", "e", "u", "b1", "b2", "b3", "b4"}
    new = {(r.root, r.path): r.tree_id for r in trees.rewritten(every).collect()}
    assert new["1", "a"] == new["2", "b"] and new["1", ""] != new["2", ""]
    cut = {(r.root, r.path) for r in trees.rewritten(every, ["!d"]).collect()}
    assert ("1", "a/d") not in cut and ("1", "a") in cut
    assert {(r.root, r.files, r.dirs, r["size"]) for r in trees.tree_summary(every).collect()} == {("1", 3, 2, 15), ("2", 2, 3, 12)}


def test_paths_and_events(spark):
    df = spark.createDataFrame([(p, "dir" if p == "a/b" else "file") for p in ("a/b", "a/b/c", "a/b/d", "f")], "path string, type string")
    assert [(r.event, r.path) for r in trees.events(df).orderBy("pos").collect()] == [("NewTree", "a"), ("NewTree", "a/b"), ("Other", "a/b/c"), ("Other", "a/b/d"), ("EndTree", "a/b"), ("EndTree", "a"), ("Other", "f")]
    assert {r.path for r in trees.roots_of(spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d",), ("/c/d",)], "path string")).collect()} == {"/a", "/ab", "/c/d"}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(paths.clean(F.lit("./test/"))) == "test" and one(paths.is_below(F.lit("/a/b"), F.lit("/a"))) and not one(paths.is_below(F.lit("/ab"), F.lit("/a")))
    for p, globs, out in (("/a/b.txt", ["!*.txt"], True), ("/a/b.txt", ["!*.txt", "b.txt"], False), ("/a/b.md", ["*.txt"], True), ("/a/b", ["!/a/*"], True), ("/a/b/c", ["!/a/*"], False), ("/a/b/c", ["!/a/**"], True), ("/x", [], False)):
        assert one(paths.excluded(F.lit(p), globs)) == out, (p, globs)
    for raw in (b"plain", b"tab\there", b"bad\xff\xfe", "é\\x".encode(), b'"\n\r\x07'):
        assert paths.unescape_name(paths.escape_name(raw)) == raw


def test_merge_compare_restore(spark):
    s = "path string, type string, mtime long, source int"
    rows = [("a", "dir", 1, 0), ("a/x", "file", 1, 0), ("a", "file", 2, 1), ("b", "dir", 1, 0), ("b", "dir", 5, 1), ("b/y", "file", 3, 0), ("b/y", "file", 3, 1)]
    got = {r.path: (r.type, r.source) for r in trees.merged(spark.createDataFrame(rows, s), F.col("mtime")).collect()}
    assert got == {"a": ("file", 1), "b": ("dir", 1), "b/y": ("file", 1)}
    n = "path string, type string, size long, mtime long, ctime long, inode long, content array<string>"
    new = spark.createDataFrame([("f", "file", 1, 1, 1, 5, None), ("g", "file", 1, 1, 1, 5, None), ("h", "file", 1, 1, 1, 5, None)], n)
    old = spark.createDataFrame([("f", "file", 1, 1, 1, 6, ["x"], 0), ("f", "file", 1, 1, 1, 5, ["y"], 1), ("g", "file", 1, 2, 1, 5, [], 0)], n + ", parent_pos int")
    status = lambda **k: {r.path: (r.status, r.parent_pos) for r in trees.compared(new, old, **k).collect()}
    assert status() == {"f": ("unmodified", 0), "g": ("changed", None), "h": ("new", None)}
    assert status(ignore_inode=True)["f"] == ("unmodified", 1)
    assert status(contents=spark.createDataFrame([("y",)], "blob_id string"))["f"] == ("new", None)
    want = spark.createDataFrame([("a", "file", 0, 1), ("b", "file", 2, 1), ("c", "file", 2, 1), ("d", "file", 2, 1), ("e", "dir", None, 1)], "path string, type string, size long, mtime long")
    there = spark.createDataFrame([("a", "file", 0, 9), ("b", "file", 2, 1), ("c", "file", 2, 9), ("z", "file", 2, 1), ("e", "file", 1, 1)], "path string, type string, size long, mtime long")
    plan = {r.path: r.action for r in restore.planned(want, there).collect()}
    assert plan == {"a": "unchanged", "b": "unchanged", "c": "verify", "d": "restore", "e": "modify", "z": "additional"}
    assert {r.path: r.action for r in restore.planned(want, there, verify=True).collect()}["b"] == "verify"


INDEX = "index_id string, pack_id string, to_delete boolean, pack_time timestamp_ntz, blob_pos int, blob_id string, blob_type string, offset long, length long, uncompressed_length long"


def entry(i, p, blobs, gone=False, time=None, kind="data"):
    at, rows = 0, []
    for n, (b, size) in enumerate(blobs):
        rows.append((i, p, gone, time and datetime.fromisoformat(time), n, b, kind, at, size, None))
        at += size
    return rows


def test_index_and_check(spark):
    rows = entry("i1", "p1", [("a", 10), ("b", 20)]) + entry("i1", "p2", [("t", 5)], kind="tree") + entry("i2", "p1", [("a", 10), ("b", 20)], gone=True) + [("i3", "p3", True, None, 0, "c", "data", 7, 5, 9), ("i3", "p3", True, None, 1, "d", "tree", 12, 5, None)]
    blobs = spark.createDataFrame(rows, INDEX)
    size = {(r.pack_id, r.to_delete): r.pack_size for r in index.packs(blobs).collect()}
    assert size == {("p1", False): 36 + 30 + 74, ("p2", False): 36 + 5 + 37, ("p1", True): 36 + 30 + 74, ("p3", True): 36 + 10 + 78}
    infos = {(r.to_delete, r.blob_type): (r["count"], r.size, r.data_size) for r in index.blob_infos(blobs).collect()}
    assert infos == {(False, "data"): (2, 30, -34), (False, "tree"): (1, 5, -27), (True, "data"): (4, 40, -52), (True, "tree"): (0, 0, 0)}
    files = spark.createDataFrame([("p1", 140), ("p2", 1), ("p9", 3)], "id string, size long")
    found = {(r.level, r.kind, r.pack_id) for r in check.metadata(blobs, files).collect()}
    assert found == {("error", "PackBlobOffsetMismatch", "p3"), ("error", "PackBlobTypesMismatch", "p3"), ("error", "PackTimeNotSet", "p1"), ("error", "PackTimeNotSet", "p3"), ("error", "PackSizeMismatchIndex", "p2"), ("error", "NoPack", "p3"), ("warning", "PackNotReferenced", "p9")}
    nodes = spark.createDataFrame([("f", "file", ["a", "0" * 64, "q"], None), ("g", "file", None, None), ("d", "dir", None, None), ("e", "dir", None, "t"), ("h", "dir", None, "no")], "path string, type string, content array<string>, subtree string")
    assert {(r.kind, r.path) for r in check.contents(nodes, blobs).collect()} == {("FileBlobHasNullId", "f"), ("FileBlobNotInIndex", "f"), ("FileHasNoContent", "g"), ("NoSubTree", "d"), ("SubTreeMissingInIndex", "h")}
    assert {r.pack_id: r.action for r in check.index_repair(index.packs(blobs), files).collect()} == {"p1": "keep", "p2": "reread", "p3": "drop", "p9": "add"}
    fixed = {r.path: (r.content, r.missing, r.suffix) for r in check.snapshot_repair(nodes.withColumn("size", F.lit(1)), blobs).collect()}
    assert fixed["f"] == (["a"], 2, ".repaired")


def test_prune(spark):
    used = spark.createDataFrame([("a",), ("b",), ("c",), ("t",), ("m",)], "blob_id string")
    old, young = "2020-01-01T00:00:00", "2020-02-01T00:00:00"
    rows = (
        entry("i1", "p1", [("a", 40), ("x", 4)], time=old) + entry("i1", "p2", [("b", 10), ("a", 40)], time=old) + entry("i1", "p3", [("y", 10)], time=old) + entry("i2", "p4", [("c", 10)], time=old) + entry("i2", "p5", [("t", 10)], time=old, kind="tree")
        + entry("i2", "d1", [("z", 10)], True, old) + entry("i2", "d2", [("z", 10)], True, young) + entry("i2", "d3", [("m", 10)], True, old) + entry("i2", "d4", [("z", 10)], True, None)
    )
    blobs = spark.createDataFrame(rows, INDEX)
    owned = {(r.pack_id, r.blob_id): r.used for r in prune.ownership(blobs, used).collect()}
    assert owned["p1", "a"] is False and owned["p2", "a"] and owned["p2", "b"]
    now = F.lit(datetime(2020, 2, 1, 10)).cast("timestamp_ntz")
    plan = prune.plan(blobs, used, now, prune.Options(no_resize=True))
    todo = {r.pack_id: r.todo for r in plan.collect()}
    assert todo == {"p1": "MarkDelete", "p2": "Keep", "p3": "MarkDelete", "p4": "Keep", "p5": "Keep", "d1": "Delete", "d2": "KeepMarked", "d3": "Recover", "d4": "KeepMarkedAndCorrect"}
    after = {(r.pack_id, r.to_delete) for r in prune.new_index(blobs, plan, now).select("pack_id", "to_delete").collect()}
    assert ("d1", True) not in after and {("p1", True), ("d3", False), ("p2", False)} <= after
    assert {r.index_id: r.rebuild for r in prune.index_files(plan).collect()} == {"i1": True, "i2": True}
    with pytest.raises(LookupError):
        prune.plan(blobs, spark.createDataFrame([("nowhere",)], "blob_id string"), now)


def test_claims():
    assert prune.claim([("p", ["a", "b"]), ("q", ["b", "a"])], {"a": 2, "b": 2}) == {"p": [False, False], "q": [True, True]}
    assert prune.claim([("p", ["a", "b", "a"]), ("q", ["a"])], {"a": 3, "b": 1}) == {"p": [True, True, False], "q": [False]}
    assert prune.claim([("p", ["a", "a"])], {"a": 2}) == {"p": [False, True]}
    fold = prune.Fold(71, 100, 5)
    assert [fold("data", "PartlyUsed", u, n) for u, n in ((50, 50), (80, 20), (10, 1))] == ["Repack", "Keep", "Repack"]
    fold = prune.Fold(0, 1000, 0)
    assert [fold("data", "SizeMismatch", 10, 0), fold("tree", "SizeMismatch", 10, 0), fold("tree", "ToCompress", 10, 0)] == [None, None, "Repack"]
    assert fold.grown({"tree": 100, "data": 10}) == {"tree": True, "data": False} and fold.grown({"tree": 100, "data": 9})["data"]


def test_ownership_by_rounds_is_the_fold(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        ids = [f"b{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 6))]
        rows += entry(f"i{rnd.randrange(3)}", f"p{k:02}", [(b, 10 + k) for b in ids], rnd.random() < 0.3, "2020-01-01T00:00:00")
    rows += [r for k in range(300) for r in entry("many", f"q{k:03}", [("hot", 10)])]
    rows += [r for k in range(6) for r in entry("chain", f"c{k}", [(f"l{k}", 5), (f"l{k + 1}", 5)])]  # each depends on the one before it
    blobs = spark.createDataFrame(rows, INDEX)
    used = spark.createDataFrame([(f"b{i}",) for i in range(30)] + [("hot",), *((f"l{k}",) for k in range(1, 6))], "blob_id string")
    shown = lambda n: sorted((r.index_id, r.pack_id, r.to_delete, r.blob_pos, r.used) for r in prune.ownership(blobs, used, fold_rows=n).collect())
    folded = shown(1 << 18)
    assert len(folded) == len(rows) and shown(0) == folded
    assert [p for _, p, _, _, u in folded if u and p.startswith("q")] == ["q254"]


def test_prune_order_and_accounts(spark):
    """Shares that differ in the seventh digit are told apart; unused bytes of packs deleted now, marked before, stay in the account; marked packs count for sizes."""
    kinds = "index_id string, pack_id string, to_delete boolean, blob_type string, pack_size long, blobs long, pack_time timestamp_ntz, used_blobs long, unused_blobs long, used_size long, unused_size long, uncompressed boolean"
    old = datetime(2020, 1, 1)
    rows = [("i", str(k), False, "data", 6_000_100, 2, old, 1, 1, 3_000_000, 3_000_000 + k, False) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, kinds)
    assert [r.pack_id for r in df.orderBy(*prune.repack_order()).collect()] == ["3", "2", "1"]
    now = F.lit(datetime(2020, 2, 1)).cast("timestamp_ntz")
    options = prune.Options(max_repack=prune.Limit(), max_unused=prune.Limit(size=52), data_sizing=PackSizing(0, 0))
    rows = [("i", "a", False, "data", 100, 2, old, 1, 1, 900, 5, False), ("i", "d", True, "data", 100, 1, old, 0, 1, 0, 100, False)]
    entries = prune.decided(spark.createDataFrame(rows, kinds), now, options)
    assert {r.pack_id: r.todo for r in prune.repacked(entries, options).collect()} == {"a": "Repack", "d": "Delete"}
    assert {r.pack_id: r.status for r in entries.collect()} == {"a": ["HasUnusedBlobs", "HasUsedBlobs"], "d": ["TooYoung", "Marked"]}
    done = prune.repacked(entries, options)
    g = prune.gains(done).first()
    assert (g.remove_size, g.repack_size, g.repackrm_size, g.unused_after_size) == (0, 905, 5, 100)
    s = prune.pack_stats(done).first()
    assert (s.partly_used, s.repack, s.marked_remove, s.marked_remove_size) == (1, 1, 1, 100)
    sizing = prune.Options(data_sizing=PackSizing(0, 10, min_percent=100))
    full = [("i", "a", False, "data", 100, 1, old, 1, 0, 50, 0, False), ("i", "d", True, "data", 9_900, 1, old, 0, 1, 0, 100, False)]
    assert [r.reason for r in prune.decided(spark.createDataFrame(full, kinds), now, sizing).where("pack_id = 'a'").collect()] == ["SizeMismatch"]


def test_index_files_of_a_plan(spark):
    kinds = "index_id string, pack_id string, to_delete boolean, todo string, blobs long"
    shown = lambda rows, **k: {r.index_id: r.rebuild for r in prune.index_files(spark.createDataFrame(rows, kinds), least=10, **k).collect()}
    assert shown([("a", "1", False, "Keep", 50), ("b", "2", False, "Keep", 3)]) == {"a": False, "b": False}
    assert shown([("a", "1", False, "Keep", 5), ("b", "2", False, "Keep", 3)]) == {"a": True, "b": True}
    assert shown([("a", "1", False, "Repack", 50), ("b", "2", False, "Keep", 3)]) == {"a": True, "b": True}
    assert shown([("a", "1", True, "KeepMarked", 50)]) == {"a": False} and shown([("a", "1", True, "KeepMarked", 50)], instant_delete=True) == {"a": True}
    twice = spark.createDataFrame([("a", "1", False), ("b", "1", False), ("b", "2", True)], "index_id string, pack_id string, to_delete boolean")
    assert [tuple(r) for r in prune.duplicates(twice).collect()] == [("b", "1", False)]
    assert shown([("a", "1", False, "Keep", 50), ("b", "2", True, "KeepMarked", 50)], dropped=prune.duplicates(twice)) == {"a": False, "b": True}


def test_virtual_paths(spark):
    rows = [("h/a/1", "tree", "root", None), ("h/a/2", "link", None, "1"), ("g/1", "tree", "R0", None)]
    df = spark.createDataFrame(rows, "path string, kind string, tree string, target string")
    asked = spark.createDataFrame([("/h/a/1/x/y",), ("h/a",), ("",), ("h/a/2/q",), ("h/b",), ("h/a/1",)], "path string")
    got = {r.path: (r.kind, r.tree, r.rest, r.target) for r in vfs.resolved(df, asked).collect()}
    assert got == {"/h/a/1/x/y": ("tree", "root", "x/y", None), "h/a": ("dir", None, None, None), "": ("dir", None, None, None), "h/a/2/q": ("link", None, None, "1"), "h/b": (None,) * 4, "h/a/1": ("tree", "root", "", None)}
    assert {tuple(r) for r in vfs.listed(df, "/h/a").collect()} == {("1", "dir", None), ("2", "symlink", "1")} and {r.name for r in vfs.listed(df, "").collect()} == {"h", "g"}
    nodes = spark.createDataFrame([("root", "x", "dir", "sub"), ("sub", "y", "file", None)], "tree_id string, name string, type string, subtree string")
    assert tuple(vfs.node_at(df, nodes, "h/a/1/x/y").first()) == ("tree", "y", "file", None) and tuple(vfs.node_at(df, nodes, "h").first())[2] == "dir"
    assert vfs.node_at(df, nodes, "h/a/1/z").count() == 0 and vfs.node_at(df, nodes, "nowhere").count() == 0
    assert [r.name for r in vfs.dir_entries(df, nodes, "h/a/1/x").collect()] == ["y"] and [r.name for r in vfs.dir_entries(df, nodes, "h/a/1").collect()] == ["x"]
    assert {r.name for r in vfs.dir_entries(df, nodes, "h").collect()} == {"a"} and vfs.dir_entries(df, nodes, "h/a/1/x/y").count() == 0
    with pytest.raises(NotADirectoryError):
        vfs.dir_entries(df, nodes, "h/a/2")


def test_merged_snapshots_keep_topmost_paths(spark):
    rows = [("1", datetime(2020, 1, 1), ["/a/b", "/ab"], ["x"]), ("2", datetime(2020, 1, 2), ["/a"], None), ("3", None, None, ["y", "x"])]
    got = snapshots.merged(spark.createDataFrame(rows, "id string, time timestamp_ntz, paths array<string>, tags array<string>")).first()
    assert (got.time, got.paths, got.tags, got.parents) == (datetime(2020, 1, 2), ["/a", "/ab"], ["x", "y"], ["1", "2", "3"])


def pack_rows(i, pack):
    return [(f"i{i}", hashlib.sha256(pack).hexdigest(), False, None, k, b[4], b[3], b[0], b[1], b[2]) for k, b in enumerate(packfile.header(pack))]


def test_packs_are_verified_and_read_again(spark):
    import zstandard

    good = packfile.built([("data", b"hello"), ("tree", b"{}")])
    zipped = packfile.built([("data", b"x" * 1000)], zstandard.ZstdCompressor().compress)
    blob_wrong = good[:16] + b"j" + good[17:]
    cut, wrong_length = good[:-1], good[:-4] + b"\1\0\0\0"
    name = lambda p: hashlib.sha256(p).hexdigest()
    rows = pack_rows(1, good) + pack_rows(2, zipped)
    rows += [(r[0], name(blob_wrong), *r[2:]) for r in pack_rows(3, good)] + [(r[0], name(wrong_length), *r[2:]) for r in pack_rows(4, good)] + [(r[0], name(cut), *r[2:]) for r in pack_rows(5, good)]
    swapped = packfile.built([("data", b"hellu"), ("tree", b"{}")])
    rows += [(r[0], name(swapped), *r[2:]) for r in pack_rows(6, good)] + [(r[0], "f" * 64, *r[2:]) for r in pack_rows(7, good)]
    short = packfile.built([("data", b"x" * 1000)], lambda b: zstandard.ZstdCompressor().compress(b[:-1]))
    rows += [(*r[:5], hashlib.sha256(b"x" * 999).hexdigest(), *r[6:]) for r in pack_rows(8, short)]
    index_rows = spark.createDataFrame([(*r[:3], r[3], *r[4:]) for r in rows], INDEX)
    packs_ = [(name(p), bytearray(p)) for p in (good, zipped, blob_wrong, wrong_length, cut, swapped, short)] + [("f" * 64, bytearray(good))]
    files = spark.createDataFrame(packs_, "id string, content binary")
    found = {(r.pack_id, r.kind) for r in check.verified_packs(files, index_rows).collect()}
    assert found == {
        (name(blob_wrong), "PackBlobHashMismatch"), (name(wrong_length), "PackHeaderLengthMismatch"), (name(cut), "PackSizeMismatch"), (name(swapped), "PackHeaderMismatchIndex"), ("f" * 64, "PackHashMismatch"),
        (name(short), "PackHeaderMismatchIndex"),
    }
    listed = [(*packfile.header(short)[0][:4], hashlib.sha256(b"x" * 1000).hexdigest())]
    assert [k for k, *_ in packfile.findings(name(short), short, listed)] == ["PackBlobLengthMismatch", "PackBlobHashMismatch"]
    sizes = files.select(F.lit("pack").alias("tpe"), "id", F.length("content").cast("long").alias("size"))
    broken = index_rows.withColumn("length", F.when(F.col("pack_id") == name(zipped), F.col("length") + 1).otherwise(F.col("length"))).where(F.col("pack_id") != name(swapped))
    new = check.index_rebuilt(broken, sizes, lambda ids: files.join(ids, "id")).where(F.col("pack_id").isin(name(good), name(zipped), name(swapped), name(cut)))
    assert {(r.index_id, r.pack_id, r.blob_pos, r.blob_id, r.length) for r in new.collect()} == {
        *((r[0], r[1], r[4], r[5], r[8]) for r in pack_rows(1, good)), *(("rebuilt", r[1], r[4], r[5], r[8]) for r in pack_rows(2, zipped) + pack_rows(6, swapped)),
    }
    with pytest.raises(ValueError):
        packfile.header(b"ab")


def test_source_filters(spark):
    from palimpsest.sources.filters import filtered

    rows = [
        ("r/.git", "dir", None, 1, None, None), ("r/.gitignore", "file", 9, 1, None, "*.o\n!keep.o\nbuild/\n/top\n# no\n\n"), ("r/a.o", "file", 1, 1, None, None), ("r/keep.o", "file", 1, 1, None, None),
        ("r/build/x", "file", 1, 1, None, None), ("r/build/keep.o", "file", 1, 1, None, None), ("r/s/top", "file", 1, 1, None, None), ("r/top", "file", 1, 1, None, None), ("r/s/.gitignore", "file", 5, 1, None, "!a.o\n"), ("r/s/a.o", "file", 1, 1, None, None),
        ("r/.git/info/exclude", "file", 3, 1, None, "*.tmp"), ("r/t.tmp", "file", 1, 1, None, None), ("q/.gitignore", "file", 3, 1, None, "*"), ("q/b", "file", 7, 1, None, None), ("q/CACHE", "file", 1, 1, ["user.no"], None),
        ("m", "dir", None, 2, None, None), ("m/z", "file", 1, 2, None, None), ("q/.own", "file", 1, 1, None, "b"),
    ]
    df = spark.createDataFrame(rows, "path string, type string, size long, device_id long, xattrs array<string>, content string")
    every = {r[0] for r in rows}
    gone = lambda **k: every - {r.path for r in filtered(df, **k).collect()}
    assert gone() == set()
    assert gone(git_ignore=True) == {"r/a.o", "r/build/x", "r/build/keep.o", "r/top", "r/t.tmp"}
    assert gone(git_ignore=True, no_require_git=True) == gone(git_ignore=True) | {"q/.gitignore", "q/b", "q/CACHE", "q/.own"}
    assert gone(custom_ignorefiles=[".own"]) == {"q/b"}
    assert gone(exclude_if_present=["CACHE"]) == {"q/.gitignore", "q/b", "q/CACHE", "q/.own"}
    assert gone(exclude_if_xattr=["user.no"]) == {"q/CACHE"}
    assert gone(one_file_system=True) in ({"m", "m/z"}, every - {"m", "m/z"}) and gone(exclude_larger_than=6) == {"q/b", "r/.gitignore"}


def test_plugged_in_source(spark):
    from palimpsest.sources import entries

    class Numbers(entries.Entries):
        def parts(self):
            return ["a", "b"]

        def entries(self, part):
            yield from ((f"{part}/{i}", "file", i, datetime(2020, 1, 1), bytes(i)) for i in range(3))

    got = entries.read(spark, Numbers(), "numbers")
    assert sorted((r.path, r.size, len(r.content)) for r in got.collect()) == [(f"{p}/{i}", i, i) for p in "ab" for i in range(3)]


def test_vfs_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", datetime(2020, 1, 1), "t1", "h"), ("2", datetime(2020, 1, 2), "t1", "h"), ("3", datetime(2020, 1, 3), "t2", "h")], "id string, time timestamp_ntz, tree string, hostname string")
    got = {r.path: (r.kind, r.tree, r.target) for r in vfs.entries(df, F.concat_ws("/", "hostname", "id"), "link", True).collect()}
    assert got == {"h/1": ("tree", "t1", None), "h/2": ("link", None, "1"), "h/3": ("tree", "t2", None), "h/latest": ("link", None, "3")}
    data = tmp_path / "data" / "ab"
    data.mkdir(parents=True)
    (data / ("ab" + "0" * 62)).write_bytes(b"12345")
    (data / "other").write_bytes(b"x")
    assert [tuple(r) for r in store.listing(spark, str(tmp_path), "pack").collect()] == [("pack", "ab" + "0" * 62, 5)]
    assert [r["size"] for r in store.walked(spark, str(tmp_path), marker="other").collect()] == []
    assert store.root_of("s3:bucket/x") == "s3a://bucket/x" and store.root_of("/a") == "/a"
    with pytest.raises(ValueError):
        Config().apply(chunk_size=1000)


def test_repository(spark):
    from palimpsest.model import FILES
    from palimpsest.repository import Repository

    nodes = small_trees(spark).withColumn("pos", F.lit(0))
    snaps = spark.createDataFrame([snap(1, "2020-01-01T00:00:00", "r1"), snap(2, "2020-01-02T00:00:00", "r2")], SNAPS)
    rows = entry("i", "pd", [("b1", 40), ("b2", 50), ("b3", 60), ("b4", 70)]) + entry("i", "pt", [("r1", 33), ("r2", 33), ("s", 33), ("u", 33), ("e", 33)], kind="tree")
    files = spark.createDataFrame([("pack", "pd", 220 + 36 + 148), ("pack", "pt", 165 + 36 + 185), ("snapshot", "x", 3)], FILES)
    repo = Repository(spark, snaps, nodes, spark.createDataFrame(rows, INDEX), files, content=spark.createDataFrame([("b1", "he"), ("b2", "llo")], "blob_id string, chunk string"))
    assert repo.check().count() == 0
    assert [r.name for r in repo.node_from_snapshot_path("latest~1:f").collect()] == ["f"]
    assert {r.path for r in repo.ls(repo.get_snapshot_from_str("latest~1")).collect()} == {"a", "a/d", "a/d/y.txt", "a/x", "f"}
    assert [r.content for r in repo.dump(nodes.where("name = 'f'").withColumnRenamed("name", "path")).collect()] == ["hello"]
    gone = repo.delete_snapshots(repo.snapshots.where("tree = 'r1'").select("id"))
    assert {r.blob_id for r in gone.used_blobs().collect()} == {"r2", "s", "e", "u", "b2", "b3", "b4"}
    now = F.lit(datetime(2020, 2, 1)).cast("timestamp_ntz")
    assert {r.pack_id: r.todo for r in gone.prune_plan(now, prune.Options(max_repack=prune.Limit(), max_unused=prune.Limit(size=0))).collect()} == {"pd": "Repack", "pt": "Repack"}
    copied, needed = Repository(spark, snaps.limit(0), nodes.limit(0), repo.blobs.where("pack_id = 'pd'"), files).copy(repo)
    assert copied.count() == 2 and {r.blob_id for r in needed.collect()} == {"r1", "r2", "s", "u", "e"}
    source = spark.createDataFrame([("f", "file", 4, 1, bytearray(b"abcd")), ("g", "file", 2, 1, bytearray(b"ab"))], "path string, type string, size long, mtime long, content binary")
    judged, cut, new = repo.backup(source, size=2)
    assert cut.count() == 3 and new.count() == 2 and {r.status for r in judged.collect()} == {"new"}
    assert {(r.kind, r.path) for r in replace(repo, nodes=nodes.where("tree_id <> 's'"), blobs=repo.blobs.where("blob_id <> 's'")).check().collect()} >= {("ErrorCheckingTrees", "a"), ("SubTreeMissingInIndex", "a")}
    new, made = repo.rewrite_snapshots_and_trees(["!f"])
    assert {(r.id, r.tags == ["rewrite"], r.tree != "r1") for r in new.collect()} == {(snaps.first().id, True, True)} and made.where("path = ''").count() == 2
    assert repo.rewrite_snapshots_and_trees()[0].count() == 0 and repo.rewrite_snapshots_and_trees(label="other")[0].count() == 2
    assert '"name":"f"' in repo.cat_tree("latest~1").first().content and '"name":"y.txt"' in repo.cat_tree("latest~1:a/d").first().content
    assert repo.drop_data_from_index().blobs.count() == 5 and repo.drop_index().blobs.count() == 0
    assert repo.rewrite_snapshots(add_tags=["x"]).select("tags").first().tags == ["rewrite", "x"]
    with pytest.raises(PermissionError):
        repo.apply_config(append_only=True).prune(None, now)
    assert {(r.tpe, r["count"]) for r in repo.infos_files().collect()} == {("pack", 2), ("snapshot", 1), ("key", 0), ("index", 0)}


def test_merged_lists_do_not_pass_the_driver(spark):
    rows = [("1", datetime(2020, 1, 1), ["/a/b", "/ab", None], ["x"]), ("2", datetime(2020, 1, 2), ["/a"], None), ("2", None, None, ["y", "x"]), (None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, paths array<string>, tags array<string>")
    assert "ubquery" not in snapshots.merged(df)._jdf.queryExecution().toString()
    got = snapshots.merge_counted(df).first()
    assert (got.time, got.paths, got.tags, got.parents) == (datetime(2020, 1, 2), ["/a", "/ab"], ["x", "y"], 2)
    assert sorted(tuple(r) for r in snapshots.merge_members(df).collect()) == [("parents", "1"), ("parents", "2"), ("paths", "/a"), ("paths", "/ab"), ("tags", "x"), ("tags", "y")]
    none = snapshots.merged(df.limit(0)).first()
    assert (none.time, none.paths, none.tags, none.parents) == (None, [], [], [])


@pytest.mark.parametrize("limit", [0, 1, 40, 700, 5_000, 40_000, 1_000_000])
def test_subsets_by_size_are_folded_in_parts(spark, limit):
    """No task gets more than a part of the packs, and what is taken is what one walk takes."""
    rnd = random.Random(limit)
    packs = [(f"{i}", rnd.choice((0, 1, 5, 7, 50, rnd.randrange(300)))) for i in range(1500)]
    rest, want = limit, []
    for name, size in sorted(packs, key=lambda p: hashlib.sha256(f"3:{p[0]}".encode()).hexdigest()):
        if rest > size:
            want.append((name, size))
            rest -= size
    df = spark.createDataFrame(packs, "id string, size long")
    for n in (100, 1 << 18):
        assert sorted(tuple(r) for r in packing.subset_size(df, limit=limit, seed=3, fold_rows=n).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_ownership_in_rounds_and_a_walk_is_the_claim(spark, seed, monkeypatch):
    """Rounds, a walk over what they leave and both together claim what the plain walk does; a chain of entries doesn't take a round each."""
    rnd, rows = random.Random(seed), []
    for k in range(90):
        ids = [f"b{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 7))]
        rows += entry(f"i{rnd.randrange(3)}", f"p{k:02}", [(b, 10 + k) for b in ids], rnd.random() < 0.3, "2020-01-01T00:00:00")
    rows += [r for k in range(30) for r in entry("chain", f"c{k:02}", [(f"l{k:02}", 5), (f"l{k + 1:02}", 5)])]
    used = {f"b{i}" for i in range(45)} | {f"l{k:02}" for k in range(1, 30)}
    blobs, each = spark.createDataFrame(rows, INDEX), {}
    for r in blobs.where("blob_id IS NOT NULL").orderBy(~F.col("to_delete"), "index_id", "pack_id", "blob_pos").collect():
        each.setdefault((r.index_id, r.pack_id, r.to_delete), []).append((r.blob_pos, r.blob_id))
    copies = {}
    for b in (b for own in each.values() for _, b in own if b in used):
        copies[b] = copies.get(b, 0) + 1
    kept = {k: [x for x in own if x[1] in used] for k, own in each.items()}
    claimed = prune.claim(((k, [b for _, b in own]) for k, own in kept.items()), copies)
    want = {(*k, pos) for k, own in kept.items() for (pos, _), yes in zip(own, claimed[k], strict=True) if yes}
    tables, settled = [], prune.settled
    monkeypatch.setattr(prune, "settled", lambda df: tables.append(0) or settled(df))
    for n in (0, 25, 140):
        tables.clear()
        got = prune.ownership(blobs, spark.createDataFrame([(b,) for b in used], "blob_id string"), fold_rows=n).where("used").collect()
        assert {(r.index_id, r.pack_id, r.to_delete, r.blob_pos) for r in got} == want and len(got) == len(want)
        assert n < 140 or len(tables) < 15


@pytest.mark.parametrize("seed", range(6))
def test_repacking_is_folded_in_parts(spark, seed):
    """No task gets more than a part of the candidates, and what is repacked is what one fold says."""
    kinds = "index_id string, pack_id string, to_delete boolean, blob_type string, pack_size long, used_size long, unused_size long, todo string, reason string"
    rnd = random.Random(seed)
    rows = []
    for k in range(400):
        reason = rnd.choice(("PartlyUsed", "PartlyUsed", "SizeMismatch", "ToCompress", None))
        u, n = rnd.randrange(1, 50), rnd.randrange(1, 50) if reason == "PartlyUsed" else 0
        rows.append((f"i{k % 3}", f"p{k}", False, rnd.choice(("tree", "data")), u + n, u, n, "Repack" if reason else rnd.choice(("Keep", "MarkDelete")), reason))
    options = prune.Options(max_repack=prune.Limit(percent=(10, 40, 70, 95, None, 1)[seed]), max_unused=prune.Limit(percent=(5, 20, 30, 0, 10, 99)[seed]), no_resize=seed == 2, data_sizing=PackSizing(100, 1), tree_sizing=PackSizing(100_000, 1))
    df = spark.createDataFrame(rows, kinds)
    shown = lambda n: sorted(map(tuple, prune.repacked(df, options, fold_rows=n).select("pack_id", "todo", "blob_type").collect()))
    ordered = [r for r in df.where("todo = 'Repack'").orderBy(*prune.repack_order()).collect()]
    used, unused = sum(r[5] for r in rows), sum(r[6] for r in rows)
    most = float("inf") if options.max_repack.percent is None else options.max_repack.percent * (used + unused) // 100
    fold = prune.Fold(unused - sum(r[6] for r in rows if r[7] == "MarkDelete"), most, options.max_unused.percent * used // (100 - options.max_unused.percent), options.no_resize)
    said = {r.pack_id: fold(r.blob_type, r.reason, r.used_size, r.unused_size) for r in ordered}
    grown = fold.grown({"tree": 100_000 + int(sum(r[4] for r in rows if r[3] == "tree") ** 0.5), "data": 100 + int(sum(r[4] for r in rows if r[3] == "data") ** 0.5)})
    want = sorted((r[1], (said[r[1]] or ("Repack" if grown[r[3]] else "Keep")) if r[7] == "Repack" else r[7], r[3]) for r in rows)
    assert shown(1 << 18) == want and shown(60) == want


def test_values_of_the_row_before_need_no_join_of_rows(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.randrange(20), rnd.choice((None, "a", "b" * 30))) for k in range(700)]
    df = spark.createDataFrame(rows, "k int, g int, v string").repartition(5)
    found = order.with_previous(df, ["g", "k"], ["k", "v"])
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {r[0]: (b[0], b[2]) for b, r in zip([(None,) * 3, *ordered], ordered, strict=False)}
    assert {r.k: (r._k, r._v) for r in found.collect()} == want


def test_virtual_paths_of_several_depths(spark):
    df = spark.createDataFrame([("a/b/c", "tree", "1", None), ("d", "tree", "2", None), ("a/b/c", "tree", "1", None), ("d/e", "tree", "3", None)], "path string, kind string, tree string, target string")
    asked = spark.createDataFrame([("d/e/f",), ("a/b/c/x",), ("a/b",), ("/d",), ("a/b/c",), ("a/b/c",), (None,)], "path string")
    got = sorted(((r.path, r.kind, r.tree, r.rest) for r in vfs.resolved(df, asked).collect()), key=str)
    assert got == sorted([("d/e/f", "tree", "2", "e/f"), ("a/b/c/x", "tree", "1", "x"), ("a/b", "dir", None, None), ("/d", "tree", "2", ""), ("a/b/c", "tree", "1", ""), (None, None, None, None)], key=str)


def test_closure_joins_nodes_once_a_level(spark, monkeypatch):
    """Nodes are not joined again below the last level, and nothing is looked for below excluded files; below excluded directories all goes."""
    rows = [("r", "d", "dir", None, "t"), ("r", "o1", "file", 1, None), ("t", "o2", "file", 2, None), ("t", "x", "dir", None, "u"), ("u", "y", "file", 3, None), ("u", "z", "file", 3, None)]
    nodes = spark.createDataFrame([(*r, ["c"]) for r in rows], "tree_id string, name string, type string, size long, subtree string, content array<string>")
    roots, tables, settled = spark.createDataFrame([("a", "r")], "root string, tree_id string"), [], trees.settled
    monkeypatch.setattr(trees, "settled", lambda df: tables.append(0) or settled(df))
    found = trees.closure(roots, nodes)
    assert len(tables) == 3 and {r.path: r.depth for r in found.collect()} == {"d": 1, "o1": 1, "d/o2": 2, "d/x": 2, "d/x/y": 3, "d/x/z": 3}
    whole = {r.path: r.tree_id for r in trees.rewritten(found).collect()}
    for globs, left in ((["!z"], {"", "d", "d/x"}), (["!x"], {"", "d"}), (["!d"], {""})):
        got = {r.path: r.tree_id for r in trees.rewritten(found, globs).collect()}
        assert set(got) == left and all(got[p] != whole[p] for p in left)


def test_rabin_holds_a_block_of_hashes(spark):
    import tracemalloc

    data = random.Random(4).randbytes(3_000_000)
    want = chunks.cuts(data[:400_000], 1024, 512, 8192)
    tracemalloc.start()
    got = chunks.cuts(data, 1024, 512, 8192)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[: len(want) - 1] == want[:-1] and got[-1] == len(data) and peak < 12_000_000
    df = spark.createDataFrame([("a", data), ("b", None), ("c", b"")], "path string, content binary")
    rows = chunks.content_defined(df, size=64, least=64, most=8192).orderBy("pos").collect()  # more rows than are handed on at a time
    start = 0
    for r, stop in zip(rows, chunks.cuts(data, 64, 64, 8192), strict=True):
        assert (r.path, r.offset, r.length, r.blob_id) == ("a", start, stop - start, hashlib.sha256(data[start:stop]).hexdigest())
        start = stop
    assert len(rows) > chunks.ROWS
