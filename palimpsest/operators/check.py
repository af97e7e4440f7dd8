"""Consistency: findings of metadata checks, each a query, and repairs that follow from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import packfile
from palimpsest.functions.ids import is_null_id
from palimpsest.model import Config, guard
from palimpsest.operators.index import ENTRY, deduplicated, packs
from palimpsest.operators.trees import unresolved
from palimpsest.session import ship


def finding(level: str, kind: str | Column, **values: Column) -> list[Column]:
    kinds = {"pack_id": "string", "blob_id": "string", "path": "string", "expected": "string", "actual": "string"}
    return [F.lit(level).alias("level"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *((values[c].cast(t) if c in values else F.lit(None).cast(t)).alias(c) for c, t in kinds.items())]


def offsets(blobs: DataFrame) -> DataFrame:
    """PackBlobOffsetMismatch: blobs of a pack, by offset, must follow each other without gaps."""
    order = Window.partitionBy(*ENTRY).orderBy("offset", "length", "blob_id", "blob_pos")
    expected = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blobs.where("blob_id IS NOT NULL").withColumn("_expected", expected).where("offset <> _expected")
    return rows.select(*finding("error", "PackBlobOffsetMismatch", pack_id=F.col("pack_id"), blob_id=F.col("blob_id"), expected=F.col("_expected"), actual=F.col("offset")))


def blob_types(blobs: DataFrame) -> DataFrame:
    """PackBlobTypesMismatch: all blobs of a pack have the type of its first."""
    first = F.first("blob_type").over(Window.partitionBy(*ENTRY).orderBy("blob_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = blobs.where("blob_id IS NOT NULL").withColumn("_first", first).where("blob_type <> _first")
    return rows.select(*finding("error", "PackBlobTypesMismatch", pack_id=F.col("pack_id"), blob_id=F.col("blob_id"), expected=F.col("_first"), actual=F.col("blob_type")))


def pack_times(entries: DataFrame) -> DataFrame:
    return entries.where("to_delete AND pack_time IS NULL").select(*finding("error", "PackTimeNotSet", pack_id=F.col("pack_id")))


def _differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, expected (size left), actual (size right) of files missing on a side or of two sizes."""
    l, r = left.select(F.col("id").alias("l"), F.col("size").alias("expected")), right.select(F.col("id").alias("r"), F.col("size").alias("actual"))
    return l.join(r, F.col("l") == F.col("r"), "full_outer").where("l IS NULL OR r IS NULL OR expected <> actual").select(F.coalesce("l", "r").alias("id"), F.col("l").isNull().alias("no_left"), F.col("r").isNull().alias("no_right"), "expected", "actual")


def listing(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Packs of the index against files found: NoPack, PackSizeMismatchIndex, and as a warning PackNotReferenced."""
    own = deduplicated(entries).select(F.col("pack_id").alias("id"), F.col("pack_size").alias("size"))
    rows = _differences(own, files.select("id", "size"))
    kind = F.when(F.col("no_left"), F.lit("PackNotReferenced")).when(F.col("no_right"), F.lit("NoPack")).otherwise(F.lit("PackSizeMismatchIndex"))
    out = finding("error", kind, pack_id=F.col("id"), expected=F.col("expected"), actual=F.col("actual"))
    return rows.select(F.when(F.col("no_left"), F.lit("warning")).otherwise(F.lit("error")).alias("level"), *out[1:])


def hot_listing(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """The same for the hot part, which has tree packs only."""
    own = deduplicated(entries).select(F.col("pack_id").alias("id"), F.col("pack_size").alias("size"), "blob_type")
    data = hot.join(own.where("blob_type = 'data'").select("id"), "id", "left_semi").select(*finding("warning", "HotDataPack", pack_id=F.col("id")))
    rest = hot.join(own.where("blob_type = 'data'").select("id"), "id", "left_anti")
    rows = _differences(own.where("blob_type = 'tree'").select("id", "size"), rest.select("id", "size"))
    kind = F.when(F.col("no_left"), F.lit("HotPackNotReferenced")).when(F.col("no_right"), F.lit("NoHotPack")).otherwise(F.lit("HotPackSizeMismatchIndex"))
    out = finding("error", kind, pack_id=F.col("id"), expected=F.col("expected"), actual=F.col("actual"))
    return data.unionByName(rows.select(F.when(F.col("no_left"), F.lit("warning")).otherwise(F.lit("error")).alias("level"), *out[1:]))


def hot_cold(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Files other than packs must be in both parts: NoHotFile, NoColdFile, HotFileSizeMismatch."""
    rows = _differences(cold, hot)
    kind = F.when(F.col("no_left"), F.lit("NoColdFile")).when(F.col("no_right"), F.lit("NoHotFile")).otherwise(F.lit("HotFileSizeMismatch"))
    return rows.select(*finding("error", kind, pack_id=F.col("id"), expected=F.col("expected"), actual=F.col("actual")))


def contents(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """What nodes (path, type, content, subtree) refer to: FileHasNoContent, FileBlobHasNullId, FileBlobNotInIndex, NoSubTree, NullSubTree,
    SubTreeMissingInIndex. Only live packs count."""
    live = blobs.where("NOT to_delete").select("blob_id", "blob_type").distinct()
    files, dirs = nodes.where("type = 'file'"), nodes.where("type = 'dir'")
    each = files.select("path", F.explode("content").alias("blob_id"))
    at = {"path": F.col("path"), "blob_id": F.col("blob_id")}
    subtrees = dirs.where("subtree IS NOT NULL").select("path", F.col("subtree").alias("blob_id"))
    of = lambda t: live.where(F.col("blob_type") == t).select("blob_id")
    return reduce(DataFrame.unionByName, [
        files.where("content IS NULL").select(*finding("error", "FileHasNoContent", path=F.col("path"))),
        each.where(is_null_id(F.col("blob_id"))).select(*finding("error", "FileBlobHasNullId", **at)),
        each.where(~is_null_id(F.col("blob_id"))).join(of("data"), "blob_id", "left_anti").select(*finding("error", "FileBlobNotInIndex", **at)),
        dirs.where("subtree IS NULL").select(*finding("error", "NoSubTree", path=F.col("path"))),
        subtrees.where(is_null_id(F.col("blob_id"))).select(*finding("error", "NullSubTree", **at)),
        subtrees.where(~is_null_id(F.col("blob_id"))).join(of("tree"), "blob_id", "left_anti").select(*finding("error", "SubTreeMissingInIndex", **at)),
    ])


def cached(cache: DataFrame, stored: DataFrame) -> DataFrame:
    """CacheMismatch: cached files (id, content) that differ from what is stored."""
    both = cache.select("id", F.sha2("content", 256).alias("a")).join(stored.select("id", F.sha2("content", 256).alias("b")), "id")
    return both.where("a <> b").select(*finding("error", "CacheMismatch", pack_id=F.col("id"), expected=F.col("b"), actual=F.col("a")))


def verified_packs(files: DataFrame, blobs: DataFrame, opened: Callable[[bytes], bytes] = packfile.unsealed) -> DataFrame:
    """What is wrong in pack files read whole (id, content), against the index: PackSizeMismatch, PackHashMismatch, PackHeaderLengthMismatch, PackHeaderMismatchIndex, each of
    which ends a pack's check; then of its blobs PackBlobLengthMismatch and PackBlobHashMismatch; ErrorReadingPack where a piece can't be opened.

    opened: from a sealed piece to its content. Files that the index doesn't know are left out, see listing(); of several entries of a pack the deduplicated() one counts.
    A pack's blobs, limited in number, come together in one row.
    """
    ship(files.sparkSession)
    own = deduplicated(packs(blobs)).select(*ENTRY)
    held = blobs.where("blob_id IS NOT NULL").join(own, list(ENTRY), "left_semi").groupBy("pack_id").agg(F.collect_list(F.struct("offset", "length", "uncompressed_length", "blob_type", "blob_id")).alias("blobs"))
    known = own.select("pack_id").join(held, "pack_id", "left").select(F.col("pack_id").alias("id"), "blobs")
    rows = files.select("id", F.col("content").cast("binary").alias("content")).join(known, "id")
    names = ["kind", "pack_id", "blob_id", "expected", "actual"]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = []
            for i, content, held in zip(pdf["id"], pdf["content"], pdf["blobs"], strict=True):
                listed = sorted((int(b["offset"]), int(b["length"]), None if pd.isna(b["uncompressed_length"]) else int(b["uncompressed_length"]), b["blob_type"], b["blob_id"]) for b in (() if held is None else held))
                found += [(kind, i, *rest) for kind, *rest in packfile.findings(i, bytes(content), listed, opened)]
            yield pd.DataFrame(found, columns=names)

    out = rows.mapInPandas(run, ", ".join(f"{n} string" for n in names))
    return out.select(F.lit("error").alias("level"), "kind", "pack_id", "blob_id", F.lit(None).cast("string").alias("path"), "expected", "actual")


def headers(files: DataFrame, opened: Callable[[bytes], bytes] = packfile.unsealed) -> DataFrame:
    """pack_id, blob_pos, blob_id, blob_type, offset, length, uncompressed_length as the headers of pack files (id, content) say; files whose header can't be read have no rows."""
    ship(files.sparkSession)
    schema = "pack_id string, blob_pos int, blob_id string, blob_type string, offset long, length long, uncompressed_length long"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = []
            for i, content in zip(pdf["id"], pdf["content"], strict=True):
                try:
                    listed = packfile.header(bytes(content), opened)
                except ValueError:
                    continue
                found += [(i, k, b, t, o, n, plain) for k, (o, n, plain, t, b) in enumerate(listed)]
            out = pd.DataFrame(found, columns=[x.split()[0] for x in schema.split(", ")])
            yield out.astype({"uncompressed_length": "Int64"})

    return files.select("id", F.col("content").cast("binary").alias("content")).mapInPandas(run, schema)


def metadata(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """All findings about packs that need no file's content."""
    entries = packs(blobs)
    return reduce(DataFrame.unionByName, [offsets(blobs), blob_types(blobs), pack_times(entries), listing(entries, files)])


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level", "kind").agg(F.count("*").alias("count"))


def is_ok(findings: DataFrame) -> DataFrame:
    return findings.agg((F.count_if(F.col("level") == "error") == 0).alias("is_ok"))


def cache_to_drop(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cached files that aren't listed or have another size."""
    return cache.join(files.select("id", "size"), ["id", "size"], "left_anti").select("id")


def index_repair(entries: DataFrame, files: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """pack_id, action: keep, drop (no file), reread (sizes differ), add (not in the index)."""
    guard(config, "repairing the index")
    own, there = deduplicated(entries).select("pack_id", "pack_size"), files.select(F.col("id").alias("file"), "size")
    action = F.when(F.col("file").isNull(), F.lit("drop")).when(F.col("pack_id").isNull(), F.lit("add")).when(F.col("pack_size") != F.col("size"), F.lit("reread")).otherwise(F.lit("keep"))
    return own.join(there, F.col("pack_id") == F.col("file"), "full_outer").select(F.coalesce("pack_id", "file").alias("pack_id"), action.alias("action"))


def index_rebuilt(blobs: DataFrame, files: DataFrame, read: Callable[[DataFrame], DataFrame], config: Config = Config(), read_all: bool = False, opened: Callable[[bytes], bytes] = packfile.unsealed) -> DataFrame:  # noqa: B008
    """INDEX_BLOBS after a repair: entries of packs that have a file of their size stay, once each; packs of another size, or not in the index, are entered anew from
    their headers, live and without a time, in an index called rebuilt; others go, and so do files without a header that can be read.

    files: FILES of packs. read: from ids (id) to whole files (id, content); only files that need it are read, or all if read_all."""
    judged = index_repair(packs(blobs), files, config)
    again = ("reread", "add", "keep") if read_all else ("reread", "add")
    stays = judged.where("action = 'keep'").select("pack_id") if not read_all else judged.limit(0).select("pack_id")
    first = deduplicated(blobs.select(*ENTRY).distinct()).join(stays, "pack_id", "left_semi")
    kept = blobs.join(first, list(ENTRY), "left_semi")
    fresh = headers(read(judged.where(F.col("action").isin(*again)).select(F.col("pack_id").alias("id"))), opened)
    fresh = fresh.withColumns({"index_id": F.lit("rebuilt"), "to_delete": F.lit(False), "pack_time": F.lit(None).cast(blobs.schema["pack_time"].dataType)})
    return kept.unionByName(fresh.select(*blobs.columns))


def unread_trees(roots: DataFrame, nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """ErrorCheckingTrees: trees that roots (tree_id) lead to, that have no nodes and that no live pack has, so that they aren't merely empty; each once, with the first path
    found."""
    live = blobs.where("NOT to_delete AND blob_type = 'tree'").select(F.col("blob_id").alias("tree_id"))
    return unresolved(roots, nodes).join(live, "tree_id", "left_anti").select(*finding("error", "ErrorCheckingTrees", path=F.col("path"), blob_id=F.col("tree_id")))


def hot_cold_repair(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """id, action: copy to the hot part what it lacks or has in another size, remove from it what isn't in the cold part."""
    return _differences(cold, hot).select("id", F.when(F.col("no_left"), F.lit("remove")).otherwise(F.lit("copy")).alias("action"))


def snapshot_repair(nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files (path, size, content) without missing blobs: path, content, size, name suffix where anything went. Size follows what is left."""
    plain = F.coalesce(F.col("uncompressed_length"), F.col("length") - 32)
    live = blobs.where("NOT to_delete AND blob_type = 'data'").groupBy("blob_id").agg(F.min(plain).alias("bytes"))
    each = nodes.where("type = 'file'").select("path", F.posexplode_outer("content").alias("pos", "blob_id"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "blob_id", "bytes"))), lambda x: x["bytes"].isNotNull())
    rows = each.join(live, "blob_id", "left").groupBy("path").agg(kept.alias("kept"), F.count_if(F.col("blob_id").isNotNull() & F.col("bytes").isNull()).alias("missing"))
    return rows.select("path", F.transform("kept", lambda x: x["blob_id"]).alias("content"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["bytes"]).alias("size"), "missing", F.when(F.col("missing") > 0, F.lit(".repaired")).otherwise(F.lit("")).alias("suffix"))
