"""A store as one object: its tables, and what can be asked of them. Every method returns DataFrames; nothing runs before they are used, except where a
request names a snapshot that must be looked up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import packfile
from palimpsest.model import Config, guard
from palimpsest.operators import check, chunks, index, packing, prune, restore, retention, snapshots, trees, vfs
from palimpsest.session import settled
from palimpsest.sources import entries, store
from palimpsest.sources.entries import Entries


@dataclass(frozen=True)
class Repository:
    """snapshots (SNAPSHOTS), nodes (TREE_NODES), blobs (INDEX_BLOBS), files (FILES), and where there are such: hot (FILES of the hot part), content (blob_id, chunk)."""

    spark: SparkSession
    snapshots: DataFrame
    nodes: DataFrame
    blobs: DataFrame
    files: DataFrame
    hot: DataFrame | None = None
    content: DataFrame | None = None
    config: Config = Config()

    # files

    def list(self, tpe: str) -> DataFrame:
        return self.files.where(F.col("tpe") == tpe).select("id", "size")

    def find_ids(self, tpe: str, requests: Sequence[str]) -> list[str]:
        return snapshots.find_ids(self.list(tpe), requests)

    def infos_files(self) -> DataFrame:
        return index.file_infos(self.files)

    def warm_up(self, ids: DataFrame, batch: int = 1) -> DataFrame:
        return packing.batches(ids, batch)

    def apply_config(self, **changes) -> Repository:
        guard(self.config, "changing the configuration")
        return replace(self, config=self.config.apply(**changes))

    def repair_hotcold_except_packs(self) -> DataFrame:
        rest = lambda f: f.where("tpe <> 'pack'").select("id", "size")
        return check.hot_cold_repair(rest(self.files), rest(self.hot))

    def repair_hotcold_packs(self) -> DataFrame:
        tree = index.deduplicated(index.packs(self.blobs)).where("blob_type = 'tree'").select(F.col("pack_id").alias("id"))
        return check.hot_cold_repair(self.list("pack").join(tree, "id", "left_semi"), self.hot.where("tpe = 'pack'").select("id", "size"))

    def config_id(self) -> DataFrame:
        return self.list("config").select("id")

    def cat_file(self, root: str, tpe: str, request: str) -> DataFrame:
        """id, content of the file of a type under a location that an id or the start of one names."""
        return store.get(store.files(self.spark, root, tpe), self.find_ids(tpe, [request])[0])

    def stream_files(self, root: str, tpe: str, schema: str) -> DataFrame:
        return store.documents(self.spark, root, tpe, schema)

    def stream_files_list(self, root: str, tpe: str, schema: str, ids: DataFrame) -> DataFrame:
        return store.documents(self.spark, root, tpe, schema, ids)

    # snapshots

    def get_snapshot_from_str(self, request: str, condition: Column | None = None) -> DataFrame:
        return snapshots.requested(self.snapshots, [request], condition)

    def get_snapshots_from_strs(self, requests: Sequence[str], condition: Column | None = None) -> DataFrame:
        return snapshots.requested(self.snapshots, requests, condition)

    def get_snapshots(self, requests: Sequence[str]) -> DataFrame:
        whole = snapshots.find_ids(self.snapshots, requests)
        return self.snapshots.join(self.spark.createDataFrame([(x,) for x in whole], "id string"), "id")

    def get_all_snapshots(self) -> DataFrame:
        return self.snapshots

    def get_matching_snapshots(self, condition: Column) -> DataFrame:
        return snapshots.matching(self.snapshots, condition)

    def update_snapshots(self, held: DataFrame, ids: DataFrame, condition: Column | None = None) -> DataFrame:
        return snapshots.refreshed(held, ids, self.snapshots, condition)

    def update_all_snapshots(self, held: DataFrame, condition: Column | None = None) -> DataFrame:
        return snapshots.refreshed(held, self.snapshots.select("id"), self.snapshots, condition)

    update_matching_snapshots = update_snapshots

    def relevant_copy_snapshots(self, source: DataFrame) -> DataFrame:
        return snapshots.to_copy(source, self.snapshots)

    def delete_snapshots(self, ids: DataFrame) -> Repository:
        return replace(self, snapshots=snapshots.without(self.snapshots, ids, self.config))

    def save_snapshots(self, rows: DataFrame) -> Repository:
        return replace(self, snapshots=self.snapshots.unionByName(snapshots.saved(rows), allowMissingColumns=True))

    def rewrite_snapshots(self, forget: bool = False, tag: str = "rewrite", **changes) -> DataFrame:
        """Changed snapshots, tagged unless the old ones are forgotten or tags are set anyway."""
        if forget:
            guard(self.config, "forgetting rewritten snapshots")
        elif "set_tags" not in changes:
            changes["add_tags"] = [*changes.get("add_tags", ()), tag]
        return snapshots.saved(snapshots.modified(self.snapshots, **changes)).where("changed")

    def forget(self, keep: retention.Keep, by: Sequence[str] = snapshots.DEFAULT_CRITERION, now: Column | None = None) -> DataFrame:
        return retention.retained(self.snapshots, keep, by=by, now=now)

    def merge_snapshots(self, condition: Column | None = None) -> DataFrame:
        return snapshots.merged(snapshots.matching(self.snapshots, condition))

    # index

    def infos_index(self) -> tuple[DataFrame, DataFrame]:
        return index.blob_infos(self.blobs), index.pack_infos(self.blobs)

    def to_indexed(self, checked: bool = False) -> DataFrame:
        """Live rows of the index; if checked, of packs only that have a file of their size."""
        live = self.blobs.where("NOT to_delete")
        if not checked:
            return live
        good = check.index_repair(index.packs(self.blobs), self.list("pack")).where("action = 'keep'").select("pack_id")
        return live.join(good, "pack_id", "left_semi")

    def to_indexed_ids(self, checked: bool = False) -> DataFrame:
        return self.to_indexed(checked).select("blob_type", "blob_id")

    def without_data(self) -> DataFrame:
        return self.to_indexed().where("blob_type = 'tree'")

    def get_index_entry(self, wanted: DataFrame) -> DataFrame:
        return index.lookup(wanted, self.blobs)

    def repair_index(self, read=None, read_all: bool = False, opened=packfile.unsealed) -> DataFrame:
        """What is to be done about each pack; with read, from ids to pack files (id, content), the index as it is after that."""
        if read is None:
            return check.index_repair(index.packs(self.blobs), self.list("pack"), self.config)
        return check.index_rebuilt(self.blobs, self.list("pack"), read, self.config, read_all, opened)

    def drop_data_from_index(self) -> Repository:
        return replace(self, blobs=self.blobs.where("blob_type = 'tree'"))

    def drop_index(self) -> Repository:
        return replace(self, blobs=self.blobs.limit(0))

    # trees

    def roots(self, rows: DataFrame | None = None) -> DataFrame:
        return (self.snapshots if rows is None else rows).select(F.col("id").alias("root"), F.col("tree").alias("tree_id"))

    def get_tree(self, tree_id: str) -> DataFrame:
        return self.nodes.where(F.col("tree_id") == tree_id).orderBy("pos")

    def node_from_path(self, tree_id: str, path: str) -> DataFrame:
        return trees.at_path(self.spark.createDataFrame([("", tree_id)], "root string, tree_id string"), self.nodes, path)

    def node_from_snapshot_path(self, request: str, condition: Column | None = None) -> DataFrame:
        """The node that snapshot:path names; without a path, the snapshot's root directory."""
        name, _, path = request.partition(":")
        return trees.at_path(self.roots(self.get_snapshot_from_str(name, condition)), self.nodes, path)

    def node_from_snapshot_and_path(self, snapshot: DataFrame, path: str) -> DataFrame:
        return trees.at_path(self.roots(snapshot), self.nodes, path)

    def cat_tree(self, request: str, condition: Column | None = None) -> DataFrame:
        """tree_id, content: the tree that snapshot:path names as JSON, its nodes by position; without a path, the snapshot's root."""
        at = self.node_from_snapshot_path(request, condition)
        column = "subtree" if request.partition(":")[2].strip("/") else "tree_id"
        own = self.nodes.join(at.select(F.col(column).alias("_t")), F.col("tree_id") == F.col("_t"), "left_semi")
        line = F.struct("pos", F.struct(*(c for c in self.nodes.columns if c not in ("tree_id", "pos"))).alias("node"))
        return own.groupBy("tree_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(line), lambda a, b: (a["pos"] - b["pos"]).cast("int")), lambda x: x["node"]).alias("nodes"))).alias("content"))

    def find_nodes_from_path(self, path: str, rows: DataFrame | None = None) -> DataFrame:
        return trees.at_path(self.roots(rows), self.nodes, path)

    def find_matching_nodes(self, condition: Column, rows: DataFrame | None = None) -> DataFrame:
        return trees.matching(trees.closure(self.roots(rows), self.nodes), condition)

    def ls(self, rows: DataFrame | None = None, globs: Sequence[str] = (), recursive: bool = True) -> DataFrame:
        return trees.listed(trees.closure(self.roots(rows), self.nodes), [*globs], recursive)

    def merge_trees(self, rank: Column, rows: DataFrame | None = None) -> DataFrame:
        return trees.merged(trees.closure(self.roots(rows), self.nodes).withColumnRenamed("root", "source").drop("tree_id", "pos"), rank)

    def rewrite_trees(self, globs: Sequence[str] = (), change=None, rows: DataFrame | None = None) -> DataFrame:
        return trees.rewritten(trees.closure(self.roots(rows), self.nodes), [*globs], change)

    def rewrite_snapshots_and_trees(self, globs: Sequence[str] = (), change=None, rows: DataFrame | None = None, forget: bool = False, tag: str = "rewrite", **changes) -> tuple[DataFrame, DataFrame]:
        """Snapshots with trees made anew and fields changed, those that changed only, as they are to be saved; and the trees (root, path, tree_id).

        A snapshot changed if a field did or its new tree isn't the one that its old tree's nodes give. Tags as in rewrite_snapshots()."""
        if forget:
            guard(self.config, "forgetting rewritten snapshots")
        elif "set_tags" not in changes:
            changes["add_tags"] = [*changes.get("add_tags", ()), tag]
        own = self.snapshots if rows is None else rows
        paths = settled(trees.closure(self.roots(own), self.nodes))
        made, was = settled(trees.rewritten(paths, [*globs], change)), trees.rewritten(paths)
        top = lambda t, name: t.where("path = ''").select(F.col("root").alias(f"_{name}_of"), F.col("tree_id").alias(f"_{name}"))
        both = own.join(top(made, "new"), F.col("id") == F.col("_new_of"), "left").join(top(was, "old"), F.col("id") == F.col("_old_of"), "left")
        other = ~F.coalesce("_new", F.lit("")).eqNullSafe(F.coalesce("_old", F.lit("")))
        tagless = {k: v for k, v in changes.items() if k != "add_tags" or [t for t in v if t != tag]}
        fields = snapshots.modified(own, **tagless).where("changed").select(F.col("id").alias("_changed_id")) if tagless else own.limit(0).select(F.col("id").alias("_changed_id"))
        both = both.withColumn("_other", other).join(fields, F.col("id") == F.col("_changed_id"), "left").where(F.col("_other") | F.col("_changed_id").isNotNull())
        tree = F.when(F.col("_other"), F.coalesce("_new", F.sha2(F.lit("[]"), 256))).otherwise(F.col("tree"))
        out = snapshots.modified(both.withColumn("tree", tree).select(*own.columns), **changes)
        return snapshots.saved(out.drop("changed")), made

    def virtual_node(self, entries: DataFrame, path: str) -> DataFrame:
        return vfs.node_at(entries, self.nodes, path)

    def virtual_entries(self, entries: DataFrame, path: str) -> DataFrame:
        return vfs.dir_entries(entries, self.nodes, path)

    def virtual(self, template: str, latest: str = "no", identical_as_link: bool = False) -> DataFrame:
        return vfs.entries(self.snapshots, snapshots.path_of(template), latest, identical_as_link)

    # content

    def lengths(self) -> DataFrame:
        return self.to_indexed().groupBy("blob_id").agg(F.min(index.data_length()).alias("length"))

    def open_file(self, files: DataFrame) -> DataFrame:
        return chunks.content_offsets(files, self.lengths())

    def read_file_at(self, files: DataFrame, first: int, n: int) -> DataFrame:
        return chunks.read_at(self.open_file(files), first, n)

    def dump(self, files: DataFrame) -> DataFrame:
        return chunks.dumped(files, self.content)

    def cat_blob(self, blob_id: str) -> DataFrame:
        return self.content.where(F.col("blob_id") == blob_id).limit(1)

    get_blob_cached = cat_blob  # Spark's own caching, content.cache(), is what a cache of blobs is here

    # whole operations

    def used_blobs(self, rows: DataFrame | None = None) -> DataFrame:
        return trees.used_blobs(self.roots(rows), self.nodes)

    def check(self, rows: DataFrame | None = None) -> DataFrame:
        """Findings about packs, trees and, where there is a hot part, its agreement with the cold one. Each tree is looked at once, at its first path."""
        return self.check_with_trees(self.roots(rows))

    def check_with_trees(self, roots: DataFrame, packs: DataFrame | None = None, opened=packfile.unsealed) -> DataFrame:
        """The same for given trees (tree_id). packs: whole pack files (id, content), to be verified byte by byte."""
        found = check.metadata(self.blobs, self.list("pack")).unionByName(check.contents(trees.once(roots, self.nodes), self.blobs)).unionByName(check.unread_trees(roots, self.nodes, self.blobs))
        if packs is not None:
            found = found.unionByName(check.verified_packs(packs, self.blobs, opened))
        if self.hot is not None:
            rest = lambda f: f.where("tpe <> 'pack'").select("id", "size")
            found = found.unionByName(check.hot_listing(index.packs(self.blobs), self.hot.where("tpe = 'pack'").select("id", "size"))).unionByName(check.hot_cold(rest(self.files), rest(self.hot)))
        return found

    def prune_plan(self, now: Column, options: prune.Options = prune.Options()) -> DataFrame:  # noqa: B008
        return prune.plan(self.blobs, self.used_blobs(), now, options)

    def prune(self, plan: DataFrame, now: Column) -> Repository:
        guard(self.config, "pruning")
        return replace(self, blobs=prune.new_index(self.blobs, plan, now))

    def prepare_restore(self, there: DataFrame, rows: DataFrame | None = None, verify: bool = False) -> DataFrame:
        return restore.planned(trees.closure(self.roots(rows), self.nodes), there, verify)

    def copy(self, source: Repository, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Snapshots of another store that this one lacks, as they would be saved here, and the blobs to bring along."""
        new = settled(snapshots.to_copy(source.snapshots if rows is None else rows, self.snapshots).where("relevant").drop("relevant"))
        return snapshots.copied(new), index.unknown(trees.used_blobs(source.roots(new), source.nodes), self.blobs)

    def repair_snapshots(self, rows: DataFrame | None = None) -> DataFrame:
        return check.snapshot_repair(trees.once(self.roots(rows), self.nodes), self.blobs)

    def archive(self, source: Entries, parent: DataFrame | None = None, size: int | None = None, name: str = "entries") -> tuple[DataFrame, DataFrame, DataFrame]:
        """backup() of a source that is plugged in."""
        return self.backup(entries.read(self.spark, source, name), parent, size)

    def backup(self, source: DataFrame, parent: DataFrame | None = None, size: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entries of a source (path, type, size, mtime, content as bytes): their status against parent nodes, their chunks, and the blobs to store.

        Chunks are of a fixed size if the store says so or one is given, else content-defined. Unmodified files aren't cut again.
        """
        nodes = source.drop("content")
        if parent is None:
            judged = nodes.withColumns({"parent_pos": F.lit(None).cast("int"), "status": F.lit("new")})
        else:
            judged = trees.compared(nodes, parent, contents=self.to_indexed_ids())
        fresh = source.join(judged.where("status <> 'unmodified' AND type = 'file'").select("path"), "path", "left_semi")
        c = self.config
        if size or c.chunker == "fixed":
            cut = chunks.fixed(fresh, size or c.chunk_size).drop("chunk")
        else:
            cut = chunks.content_defined(fresh, size=c.chunk_size, least=c.chunk_min_size, most=c.chunk_max_size, poly=c.chunker_polynomial)
        return judged, cut, index.unknown(cut, self.blobs)
