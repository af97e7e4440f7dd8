"""Directory trees: a Merkle graph of nodes, walked level by level.

Nodes: tree_id, name, type, subtree and whatever else describes a node. A level joins the trees reached so far with their nodes; each
level is settled as a table, and where a tree needs visiting once only, trees seen before are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import excluded, lineage, parts
from palimpsest.operators.order import numbered, numbered_within
from palimpsest.session import settled


def reachable(roots: DataFrame, nodes: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """tree_id, depth (the least), path (one of that depth, the same in every run; empty for a root) of every tree under roots (tree_id), each visited once.

    Null ids lead nowhere; a tree that has no nodes, as one that can't be read, is in the result and ends there."""
    edges = nodes.where("subtree IS NOT NULL").select("tree_id", "name", "subtree")
    seen = level = settled(roots.where("tree_id IS NOT NULL").select("tree_id").distinct().withColumns({"depth": F.lit(0), "path": F.lit("")}))
    path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
    for depth in range(1, max_depth):
        found = level.select("tree_id", "path").join(edges, "tree_id").groupBy(F.col("subtree").alias("tree_id")).agg(F.min(path).alias("path"))
        level = settled(found.join(seen.select("tree_id"), "tree_id", "left_anti").select("tree_id", F.lit(depth).alias("depth"), "path"))
        if not level.limit(1).count():
            return seen
        seen = seen.unionByName(level)
    raise RecursionError("trees are deeper than max_depth")


def once(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """All columns of nodes with path and depth, each tree under roots listed once, at its first path, however many snapshots and folders share it."""
    found = reachable(roots, nodes).select(F.col("tree_id").alias("_t"), F.col("depth").alias("_d"), F.col("path").alias("_above"))
    path = F.when(F.col("_above") == "", F.col("name")).otherwise(F.concat_ws("/", "_above", "name"))
    return nodes.join(found, F.col("tree_id") == F.col("_t")).withColumns({"path": path, "depth": F.col("_d") + 1}).drop("_t", "_d", "_above")


def unresolved(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree_id, depth, path of trees that are reached but have no nodes: empty ones, and those that a walk can't read."""
    return reachable(roots, nodes).join(nodes.select("tree_id").distinct(), "tree_id", "left_anti")


def closure(roots: DataFrame, nodes: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """All columns of nodes with root, path and depth for every path under roots (root, tree_id). Shared trees appear under each path."""
    out, level = None, roots.select("root", "tree_id", F.lit("").alias("above"))
    for depth in range(1, max_depth):
        found = settled(level.join(nodes, "tree_id").withColumn("path", F.when(F.col("above") == "", F.col("name")).otherwise(F.concat_ws("/", "above", "name"))).withColumn("depth", F.lit(depth)).drop("above"))
        out = found if out is None else out.unionByName(found)
        level = found.where("subtree IS NOT NULL").select("root", F.col("subtree").alias("tree_id"), F.col("path").alias("above"))
        if not level.limit(1).count():  # asked before nodes are joined once more, all of them for nothing
            return out
    raise RecursionError("trees are deeper than max_depth")


def listed(paths: DataFrame, globs: list[str] = [], recursive: bool = True) -> DataFrame:  # noqa: B006
    """Paths of a closure in depth-first order (pos). Excluded paths aren't shown, but what lies below them is unless excluded too."""
    rows = paths.where(~excluded(F.col("path"), globs)) if globs else paths
    rows = rows if recursive else rows.where("depth = 1")
    return numbered_within(rows.withColumn("_at", parts(F.col("path"))), ["root"], ["_at"], "pos").drop("_at")


def at_path(roots: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """root, and the node at one path, null columns where a root has none: a join for each component, each tree looked into once."""
    names = [x for x in path.split("/") if x]
    level = roots.select("root", "tree_id")
    for i, name in enumerate(names):
        here = nodes.where(F.col("name") == name)
        if i == len(names) - 1:
            return roots.select("root").join(level.join(here.withColumnRenamed("tree_id", "_t"), F.col("tree_id") == F.col("_t")).drop("_t", "tree_id"), "root", "left")
        level = level.join(here.select("tree_id", "subtree"), "tree_id").where("subtree IS NOT NULL").select("root", F.col("subtree").alias("tree_id"))
    return level


def matching(paths: DataFrame, condition: Column) -> DataFrame:
    """Paths of a closure that fulfil a condition, what lies in a directory before the directory."""
    at = F.concat(parts(F.col("path")), F.array(F.lit("\U0010ffff")))
    return numbered_within(paths.where(condition).withColumn("_at", at), ["root"], ["_at"], "pos").drop("_at")


def encoded(found: DataFrame, node: list[str]) -> DataFrame:
    """found with path_no and node_no: numbers of distinct paths and of distinct nodes, in their order, null first."""
    for name, columns in (("path_no", ["path"]), ("node_no", node)):
        own = numbered(found.select(*columns).distinct(), columns, name).select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)), name)
        same = F.lit(True)
        for i, c in enumerate(columns):
            same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
        found = found.join(own, same).drop(*(f"_{i}" for i in range(len(columns))))
    return found


def used_blobs(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """blob_id, blob_type of all trees and contents that roots (tree_id) reach."""
    trees = reachable(roots, nodes)
    held = nodes.join(trees.select("tree_id"), "tree_id", "left_semi").select(F.explode("content").alias("blob_id")).distinct()
    return trees.select(F.col("tree_id").alias("blob_id"), F.lit("tree").alias("blob_type")).unionByName(held.select("blob_id", F.lit("data").alias("blob_type")))


def ancestors(paths: DataFrame) -> DataFrame:
    """path, ancestor, distance for each path and all directories above it."""
    rows = paths.select("path", F.posexplode(F.reverse(lineage(F.col("path")))).alias("distance", "ancestor"))
    return rows.where("distance > 0").select("path", "ancestor", "distance")


def events(paths: DataFrame) -> DataFrame:
    """What an archiver sees of sorted paths (path, type): NewTree and EndTree around directories, Other for the rest; missing parents are made up with mode 0755.

    Order is that of (at, kind): a directory is entered at its path and left after all below it."""
    missing = paths.select(F.explode(F.slice(lineage(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)).alias("path")).distinct().join(paths.select("path"), "path", "left_anti")
    dirs = paths.where("type = 'dir'").select("path", F.lit(False).alias("made_up")).unionByName(missing.withColumn("made_up", F.lit(True)))
    p = parts(F.col("path"))
    mode = F.when(F.col("made_up"), F.lit(0o755))
    rows = dirs.select(p.alias("at"), F.lit(0).alias("n"), F.lit("NewTree").alias("event"), "path", mode.alias("mode"))
    rows = rows.unionByName(dirs.select(F.concat(p, F.array(F.lit("\U0010ffff"))).alias("at"), F.lit(1).alias("n"), F.lit("EndTree").alias("event"), "path", F.lit(None).cast("int").alias("mode")))
    rows = rows.unionByName(paths.where("type <> 'dir'").select(p.alias("at"), F.lit(0).alias("n"), F.lit("Other").alias("event"), "path", F.lit(None).cast("int").alias("mode")))
    return numbered(rows, ["at", "n"], "pos").select("pos", "event", "path", "mode")


def roots_of(paths: DataFrame) -> DataFrame:
    """Distinct paths without those that lie below another."""
    rows = paths.select("path").distinct()
    below = rows.select("path", F.explode(F.slice(lineage(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)).alias("over")).join(rows.select(F.col("path").alias("over")), "over", "left_semi")
    return rows.join(below.select("path").distinct(), "path", "left_anti")


def merged(paths: DataFrame, rank: Column) -> DataFrame:
    """One node for each path of several trees (path, type, source): that of the highest rank, then the highest source. What lies below a path won by other
    than a directory goes."""
    winner = paths.groupBy("path").agg(F.max_by(F.struct(*[c for c in paths.columns if c != "path"]), F.struct(rank.alias("rank"), F.col("source"))).alias("w")).select("path", "w.*")
    blocked = winner.where("type <> 'dir'").select(F.col("path").alias("over"))
    lost = winner.select("path", F.explode(F.slice(lineage(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)).alias("over")).join(blocked, "over", "left_semi").select("path").distinct()
    return winner.join(lost, "path", "left_anti")


def compared(nodes: DataFrame, parents: DataFrame, ignore_ctime: bool = False, ignore_inode: bool = False, contents: DataFrame | None = None) -> DataFrame:
    """nodes with status against parents (path, parent_pos and the same columns): new, changed or unmodified, and the parent_pos that matched, the first if several.

    Type, size and mtime must agree; ctime unless ignored or missing; the inode only if ignore_inode is set (sic), where neither is 0. A file whose content
    isn't wholly in contents (blob_id) counts as new.
    """
    columns = ("type", "size", "mtime", "ctime", "inode", "content")
    old = parents.select(F.col("path").alias("_path"), "parent_pos", *(F.col(c).alias(f"_{c}") for c in columns if c in parents.columns))
    same = F.col("type").eqNullSafe(F.col("_type")) & F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    if not ignore_ctime and "ctime" in nodes.columns:
        same = same & F.coalesce(F.col("ctime") == F.col("_ctime"), F.lit(True))
    if ignore_inode and "inode" in nodes.columns:
        same = same & ((F.col("_inode") == 0) | (F.col("inode") == 0) | (F.col("inode") == F.col("_inode")))
    hits = nodes.join(old, F.col("path") == F.col("_path"), "left").withColumn("_same", F.col("_path").isNotNull() & same)
    first = F.min(F.when(F.col("_same"), F.col("parent_pos")))
    keys = [c for c in nodes.columns]
    rows = hits.groupBy(*keys).agg(F.count("_path").alias("_n"), first.alias("parent_pos"))
    status = F.when(F.col("_n") == 0, F.lit("new")).when(F.col("parent_pos").isNull(), F.lit("changed")).otherwise(F.lit("unmodified"))
    rows = rows.withColumn("status", status).drop("_n")
    if contents is not None:
        gone = parents.select("path", "parent_pos", F.explode("content").alias("blob_id")).join(contents.select("blob_id"), "blob_id", "left_anti").select(F.col("path").alias("p"), F.col("parent_pos").alias("q")).distinct()
        rows = rows.join(gone, (F.col("path") == F.col("p")) & (F.col("parent_pos") == F.col("q")), "left")
        rows = rows.withColumn("status", F.when(F.col("p").isNotNull(), F.lit("new")).otherwise(F.col("status"))).withColumn("parent_pos", F.when(F.col("p").isNull(), F.col("parent_pos"))).drop("p", "q")
    return rows


def statuses_of_dirs(files: DataFrame) -> DataFrame:
    """path, type (dir), status of all directories above entries (path, status): new if all below is new, unmodified if all is, else changed.

    Stands for the comparison of tree ids where trees of the parent aren't at hand."""
    above = files.select("status", F.explode(F.slice(lineage(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)).alias("path"))
    status = F.when(F.bool_and(F.col("status") == "new"), "new").when(F.bool_and(F.col("status") == "unmodified"), "unmodified").otherwise("changed")
    return above.groupBy("path").agg(status.alias("status")).select("path", F.lit("dir").alias("type"), "status")


def backup_summary(compared_nodes: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """One row: files (all but directories) and directories by status and in all, and bytes processed, of nodes (type, status, size).

    added: blobs that were stored (blob_type, length, packed): their number by type, bytes before and after packing, in all and by type; zeros without."""
    is_dir = F.col("type") == "dir"
    count = lambda d, s: F.count_if((is_dir if d else ~is_dir) & (F.col("status") == s))
    names = [(k, s) for k in ("file", "dir") for s in ("new", "changed", "unmodified")]
    rows = compared_nodes.agg(
        *(count(k == "dir", s).alias(f"{k}s_{s}") for k, s in names), F.count_if(~is_dir).alias("files_processed"), F.count_if(is_dir).alias("dirs_processed"),
        F.coalesce(F.sum(F.when(~is_dir, F.col("size"))), F.lit(0)).alias("bytes_processed"),
    )
    of = lambda t: F.lit(True) if t is None else F.col("blob_type") == t
    total = lambda c, t: F.coalesce(F.sum(F.when(of(t), F.col(c))), F.lit(0)).cast("long")
    added = compared_nodes.sparkSession.createDataFrame([], "blob_type string, length long, packed long") if added is None else added
    sums = added.agg(
        F.count_if(of("data")).alias("data_blobs"), F.count_if(of("tree")).alias("tree_blobs"), total("length", None).alias("data_added"), total("packed", None).alias("data_added_packed"),
        *(total(c, t).alias(f"data_added_{n}{x}") for t, n in (("data", "files"), ("tree", "trees")) for c, x in (("length", ""), ("packed", "_packed"))),
    )
    return rows.join(F.broadcast(sums))  # one row beside one row


def tree_summary(paths: DataFrame) -> DataFrame:
    """root, files (all but directories), dirs, size (of regular files)."""
    return paths.groupBy("root").agg(F.count_if(F.col("type") != "dir").alias("files"), F.count_if(F.col("type") == "dir").alias("dirs"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("size"))), F.lit(0)).alias("size"))


def rewritten(paths: DataFrame, globs: list[str] = [], change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:  # noqa: B006
    """Trees made anew from a closure (root, path, depth, name, type, size, content), without excluded paths and what is below them, nodes changed by a function.

    root, path (empty for the root itself), tree_id: ids come bottom-up from a level's nodes in the order of names. Equal trees have equal ids.
    """
    rows = paths.select("root", "path", "depth", "name", "type", "size", "content")
    if globs:
        gone = excluded(F.col("path"), globs)
        # What lies below is looked for only if something can.
        deepest = rows.agg(F.max("depth")).first()[0] or 0
        out = settled(rows.where(gone & (F.col("depth") < deepest)).select("root", F.col("path").alias("over")))
        rows = rows.where(~gone)
        if out.limit(1).count():
            lost = rows.select("root", "path", F.explode(lineage(F.col("path"))).alias("over")).join(out, ["root", "over"], "left_semi").select("root", "path").distinct()
            rows = rows.join(lost, ["root", "path"], "left_anti")
    rows = settled(change(rows) if change else rows)
    above = F.array_join(F.slice(parts(F.col("path")), F.lit(1), F.col("depth") - 1), "/")
    made = None
    below = rows.limit(0).select("root", "path", F.lit("").alias("subtree"))
    for depth in range(rows.agg(F.max("depth")).first()[0] or 0, 0, -1):
        level = rows.where(F.col("depth") == depth).join(below, ["root", "path"], "left")
        empty = F.when(F.col("type") == "dir", F.coalesce("subtree", F.sha2(F.lit("[]"), 256)))
        line = F.struct("name", "type", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.array_join("content", ","), F.lit("")).alias("content"), F.coalesce(empty, F.lit("")).alias("subtree"))
        below = settled(level.groupBy("root", above.alias("path")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(line))), 256).alias("subtree")))
        made = below if made is None else made.unionByName(below)
    return (made if made is not None else below).withColumnRenamed("subtree", "tree_id")


def with_policy(nodes: DataFrame, atime: str = "mtime", ctime: str = "keep", device_id: str = "hardlink", xattrs: str = "keep") -> DataFrame:
    """Nodes as they are to be stored. atime, ctime: keep, mtime (take that time) or none; device_id: keep, none or hardlink (only where a file has several
    links); xattrs: keep or none."""

    def timed(c: str, how: str) -> Column:
        if how not in ("keep", "mtime", "none"):
            raise ValueError(f"unknown policy {how}")
        return F.col(c) if how == "keep" else F.col("mtime") if how == "mtime" else F.lit(None).cast(nodes.schema[c].dataType)

    if device_id not in ("keep", "none", "hardlink") or xattrs not in ("keep", "none"):
        raise ValueError("unknown policy")
    device = {"keep": F.col("device_id"), "none": F.lit(0), "hardlink": F.when(F.col("links") > 1, F.col("device_id")).otherwise(0)}[device_id].cast("bigint")
    new = {"atime": timed("atime", atime), "ctime": timed("ctime", ctime), "device_id": device}
    if xattrs == "none" and "xattrs" in nodes.columns:
        new["xattrs"] = F.array().cast(nodes.schema["xattrs"].dataType)
    return nodes.withColumns(new)
