"""Snapshots as a virtual directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import lineage, parts
from palimpsest.operators.order import with_previous
from palimpsest.operators.trees import at_path


def entries(snapshots: DataFrame, path: Column, latest: str = "no", identical_as_link: bool = False) -> DataFrame:
    """path, kind (tree or link), tree, target: an entry for each snapshot, oldest first, and one named latest in each directory if latest is link or dir.

    A snapshot at the path of the one before it adds nothing. One with the same tree and directory as the one before becomes a link to that, if asked for.
    """
    p = parts(F.col("path"))
    cut = lambda p: (F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/"), F.element_at(p, -1))
    rows = with_previous(snapshots.select("id", "time", "tree", path.alias("path")), ["time", "id"], ["path", "tree"] if identical_as_link else ["path"])
    dir_, name = cut(p)
    rows = rows.withColumns({"dir": dir_, "name": name})
    fresh = rows.where(~F.coalesce(F.col("_path") == F.col("path"), F.lit(False)))
    if identical_as_link:
        was_dir, was = cut(parts(F.col("_path")))
        link = F.coalesce((was_dir == F.col("dir")) & (F.col("_tree") == F.col("tree")), F.lit(False))
    else:
        link, was = F.lit(False), F.lit(None).cast("string")
    out = fresh.select("path", F.when(link, "link").otherwise("tree").alias("kind"), F.when(~link, F.col("tree")).alias("tree"), F.when(link, was).alias("target"))
    if latest != "no":
        top = rows.groupBy("dir").agg(F.max_by(F.struct("tree", "name"), F.struct("time", "id")).alias("t"))
        as_link = F.lit(latest == "link")
        at = F.when(F.col("dir") == "", F.lit("latest")).otherwise(F.concat_ws("/", "dir", F.lit("latest")))
        out = out.unionByName(top.select(at.alias("path"), F.when(as_link, "link").otherwise("tree").alias("kind"), F.when(~as_link, F.col("t.tree")).alias("tree"), F.when(as_link, F.col("t.name")).alias("target")))
    return out


def folders(entries: DataFrame) -> DataFrame:
    """path of every virtual directory: all above entries, and the root, which is empty."""
    above = entries.select(F.explode(F.slice(lineage(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)).alias("path"))
    return above.unionByName(entries.sparkSession.createDataFrame([("",)], "path string")).distinct()


def resolved(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """paths (path) with kind, tree, rest, target. kind: tree, where a snapshot's tree is met on the way, rest being what of the path lies in it; link likewise (what
    follows a link is not looked at); dir for a virtual directory; null where there is nothing."""
    # Only paths above that are as deep as some entry can be one.
    depths = sorted(r[0] for r in entries.select(F.size(parts(F.col("path"))).alias("n")).distinct().collect() if r[0] and r[0] > 0)  # as many rows as there are depths
    asked = paths.select("path").distinct()
    p = parts(F.col("path"))
    above = F.filter(F.array(*(F.when(F.size(p) >= n, F.array_join(F.slice(p, 1, n), "/")) for n in depths)), lambda x: x.isNotNull()) if depths else F.array().cast("array<string>")
    steps = asked.select(F.col("path").alias("_q"), F.explode(above).alias("_at"))
    own = entries.groupBy(F.col("path").alias("_e")).agg(F.min(F.struct("kind", "tree", "target")).alias("m")).select("_e", "m.*")
    met = steps.join(own, F.col("_at") == F.col("_e")).select("_q", "_e", "kind", "tree", "target")
    if len(depths) > 1:
        met = met.groupBy("_q").agg(F.min_by(F.struct("_e", "kind", "tree", "target"), F.length("_e")).alias("m")).select("_q", "m.*")
    rows = asked.join(met, F.col("path") == F.col("_q"), "left").withColumn("_p", F.array_join(p, "/")).join(folders(entries).select(F.col("path").alias("_f")), F.col("_p") == F.col("_f"), "left")
    rows = rows.withColumn("rest", F.expr("ltrim('/', substring(_p, length(_e) + 1))"))
    kind = F.coalesce("kind", F.when(F.col("_f").isNotNull(), F.lit("dir")))
    return rows.select("path", kind.alias("kind"), "tree", F.when(F.col("kind") == "tree", F.col("rest")).alias("rest"), "target")


def listed(entries: DataFrame, path: str) -> DataFrame:
    """name, type (dir or symlink), target of what a virtual directory holds; empty if it isn't one."""
    at = "/".join(x for x in path.split("/") if x not in ("", "."))
    n = len(at.split("/")) if at else 0
    p = parts(F.col("path"))
    inside = entries.where((F.size(p) > n) & (F.array_join(F.slice(p, F.lit(1), F.lit(n)), "/") == at)) if n else entries
    own = F.size(p) == n + 1
    rows = inside.select(F.element_at(p, n + 1).alias("name"), F.when(own & (F.col("kind") == "link"), "symlink").otherwise("dir").alias("type"), F.when(own, F.col("target")).alias("target"))
    return rows.distinct()


def node_at(entries: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path of the virtual directory: kind, name, type, subtree; within a snapshot's tree, the stored node. No row if there is none."""
    spark = entries.sparkSession
    found = resolved(entries, spark.createDataFrame([(path,)], "path string")).where("kind IS NOT NULL").first()
    kinds = "kind string, name string, type string, subtree string"
    if found is None:
        return spark.createDataFrame([], kinds)
    if found.kind != "tree" or not found.rest:
        return spark.createDataFrame([(found.kind, "", "symlink" if found.kind == "link" else "dir", found.tree)], kinds)
    inner = at_path(spark.createDataFrame([("", found.tree)], "root string, tree_id string"), nodes, found.rest)
    return inner.where("name IS NOT NULL").select(F.lit("tree").alias("kind"), "name", "type", "subtree")


def dir_entries(entries: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """name, type of what lies at a path: entries of a virtual or a stored directory, none of a file; a link is refused."""
    spark = entries.sparkSession
    found = resolved(entries, spark.createDataFrame([(path,)], "path string")).first()
    if found.kind == "link":
        raise NotADirectoryError(f"{path} is a link")
    if found.kind != "tree":
        return listed(entries, path).select("name", "type")
    tree = found.tree
    if found.rest:
        node = node_at(entries, nodes, path).first()
        tree = node.subtree if node else None
    return nodes.where(F.col("tree_id") == F.lit(tree)).select("name", "type")
