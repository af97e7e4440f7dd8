"""Garbage collection: which packs to keep, repack, mark, delete or recover, and what it gains."""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import BLOBS_PER_PACK, DATA_SIZING, TREE_SIZING, PackSizing
from palimpsest.operators.index import ENTRY, deduplicated, is_first, packs
from palimpsest.operators.order import numbered, of_part, ranged
from palimpsest.operators.packing import target_size, too_large, too_small
from palimpsest.session import settled, ship

#: Orders an entry's blobs among all: entries marked for deletion first.
ORDER = ("live", "index_id", "pack_id", "blob_pos")
#: Copies of a blob are counted up to this number (a fixed value of the format's reference behaviour).
MOST_COPIES = 255
#: Up to so many rows ownership is a fold in one task; beyond, rounds of joins.
FOLD_ROWS = 1 << 18

# What a pack's status can hold, in order.
STATUSES = ("NotCompressed", "TooYoung", "TimeNotSet", "TooLarge", "TooSmall", "HasUnusedBlobs", "HasUsedBlobs", "Marked")


@dataclass(frozen=True)
class Limit:
    """A number of bytes, a percentage, or (both None) no limit."""

    size: int | None = None
    percent: int | None = None


@dataclass(frozen=True)
class Options:
    max_repack: Limit = Limit(percent=10)
    max_unused: Limit = Limit(percent=5)
    keep_pack: str = "INTERVAL 0 SECONDS"
    keep_delete: str = "INTERVAL 23 HOURS"
    instant_delete: bool = False
    repack_uncompressed: bool = False
    repack_all: bool = False
    repack_cacheable_only: bool = False
    no_resize: bool = False
    tree_sizing: PackSizing = TREE_SIZING
    data_sizing: PackSizing = DATA_SIZING


def missing(used: DataFrame, blobs: DataFrame) -> DataFrame:
    """Used blobs that no entry has; a plan can't be made while there are any."""
    return used.select("blob_id").distinct().join(blobs.select("blob_id"), "blob_id", "left_anti")


def claim(entries: Iterable[tuple[object, list[str]]], copies: dict[str, int]) -> dict[object, list[bool]]:
    """Which blobs of each entry count as used, entries being visited in order. copies: how many there are of each used blob; it is used up.

    An entry is needed if, going through its blobs, it meets the last copy of one. It then claims every blob it holds that no entry before
    has claimed. Entries that aren't needed only lower the counts.
    """
    found = {}
    for key, ids in entries:
        last = None
        for at, b in enumerate(ids):
            if copies.get(b):
                copies[b] -= 1
                if not copies[b]:
                    last = at
                    break
        taken = [at == last for at in range(len(ids))]
        if last is not None:
            for at, b in enumerate(ids):
                if copies.get(b):
                    taken[at], copies[b] = True, 0
        found[key] = taken
    return found


def _folded(shared: DataFrame) -> DataFrame:
    """Which of shared (an entry's used blobs, ORDER, blob_id, copies) count, by one fold over all of them; for tables of a checked size."""
    import pandas as pd

    ship(shared.sparkSession)

    def run(batches):
        pdf = pd.concat([*batches], ignore_index=True)
        left = dict(zip(pdf["blob_id"], pdf["copies"].clip(upper=MOST_COPIES).tolist(), strict=True))
        entry = pdf[["live", "index_id", "pack_id"]]
        starts = [*(entry != entry.shift()).any(axis=1).to_numpy().nonzero()[0].tolist(), len(pdf)]
        ids = pdf["blob_id"].tolist()
        taken = claim(((i, ids[i:j]) for i, j in zip(starts, starts[1:], strict=False)), left)
        yield pdf[[x for own in taken.values() for x in own]][["blob_id", *ORDER]]

    return shared.repartition(1).sortWithinPartitions(*ORDER).mapInPandas(run, shared.select("blob_id", *ORDER).schema)


def _walked(open_: DataFrame) -> DataFrame:
    """e of entries that are needed, by one walk over rows b, e, decides of entries that aren't known yet; for tables of a checked size."""
    import pandas as pd

    def run(batches):
        pdf = pd.concat([*batches], ignore_index=True)
        taken, needed = set(), []
        for e, own in pdf.groupby("e", sort=True):
            if not taken.issuperset(own["b"][own["decides"]]):
                needed.append(e)
                taken.update(own["b"])
        yield pd.DataFrame({"e": pd.Series(needed, dtype="int64")})

    return open_.repartition(1).mapInPandas(run, "e long")


def _needed(held: DataFrame, known: DataFrame, fold_rows: int) -> DataFrame:
    """e of entries that are needed. held: b, e, decides (a blob, an entry that holds it, and whether this is the last that may, the one that decides); known: e of entries that are needed
    anyway.

    An entry is needed if it decides on a blob that no needed entry before it holds. So it is if nobody else is left to hold the blob; what a needed entry holds is decided, and
    entries without a blob to decide on are not needed. Each round leaves these out, until what is left fits in one walk.
    """
    out, found, rows = known, known, held.select("b", "e", "decides")
    while True:
        rows = rows.join(rows.join(found, "e", "left_semi").select("b").distinct(), "b", "left_anti")
        rows = settled(rows.join(rows.where("decides").select("e").distinct(), "e", "left_semi"))
        n = rows.count()
        if n <= fold_rows:
            return out.unionByName(settled(_walked(rows))) if n else out
        found = settled(rows.groupBy("b").agg(F.count("*").alias("n"), F.max("e").alias("e")).where("n = 1").select("e").distinct())
        out = out.unionByName(found)


def _rounds(rows: DataFrame, several: DataFrame, fold_rows: int) -> DataFrame:
    """The same by rounds of joins, for any number of rows and without a task that holds a group. several: blob_id and copies of used blobs with more than one.

    A copy decides if it is a blob's last one, or the MOST_COPIES-th of more. Only entries that hold one of these can be needed, and an entry that holds the only copy of a blob is.
    From there on entries and blobs are numbers.
    """
    entry = ["live", "index_id", "pack_id"]
    several = settled(several.withColumn("b", F.monotonically_increasing_id()))
    every = settled(rows.where("_used").join(several, "blob_id", "left").select("b", "copies", *ORDER))
    shared, alone = every.where("b IS NOT NULL"), every.where("b IS NULL").groupBy(*entry).agg(F.min("blob_pos").alias("alone"))
    last = shared.where(F.col("copies") <= MOST_COPIES).groupBy("b").agg(F.max(F.struct(*ORDER)).alias("d")).select("b", "d.*")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(*ORDER))
    last = last.unionByName(shared.where(F.col("copies") > MOST_COPIES).withColumn("k", nth).where(F.col("k") <= MOST_COPIES).where(F.col("k") == MOST_COPIES).select("b", *ORDER))
    last = settled(last)
    able = last.select(*entry).distinct().withColumn("alone", F.lit(None).cast(alone.schema["alone"].dataType)).unionByName(alone.join(shared.select(*entry), entry, "left_semi"))
    able = settled(numbered(able.groupBy(*entry).agg(F.min("alone").alias("alone")), entry, "e"))
    decides = last.join(able, entry).select("b", F.col("e").alias("de"), F.col("blob_pos").alias("dpos"))
    held = shared.join(able, entry).groupBy("b", "e", "alone").agg(F.min("blob_pos").alias("first")).join(decides, "b").where("e <= de")
    held = settled(held.select("b", "e", "alone", "first", (F.col("e") == F.col("de")).alias("decides"), F.when(F.col("e") == F.col("de"), F.col("dpos")).alias("at")))
    needed = _needed(held, able.where("alone IS NOT NULL").select("e"), fold_rows)
    owners = held.join(needed, "e").groupBy("b").agg(F.min_by(F.struct("e", "alone", "first", "at"), "e").alias("o")).select("b", "o.*")
    # The blob at which an entry is found to be needed counts where it was met, others where the entry holds them first.
    met = owners.groupBy("e").agg(F.least(F.min("at"), F.min("alone")).alias("met"))
    owners = owners.join(met, "e").select("b", "e", F.when(F.col("at") == F.col("met"), F.col("at")).otherwise(F.col("first")).alias("blob_pos"))
    return owners.join(able, "e").join(several, "b").select("blob_id", *ORDER)


def ownership(blobs: DataFrame, used: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """blobs with used: whether this copy is the one that counts.

    Blobs with one copy need a join only. Where used blobs have further copies, the entries that hold these are taken in order, after those marked for deletion
    (see claim()): in one fold where their used blobs are no more than fold_rows, else in rounds of joins. Rows without a blob are left out.
    """
    flags = used.select("blob_id").distinct().withColumn("_used", F.lit(True))
    rows = blobs.where("blob_id IS NOT NULL").join(flags, "blob_id", "left")
    rows = settled(rows.withColumns({"live": ~F.col("to_delete"), "_used": F.col("_used").isNotNull()}))
    several = settled(rows.where("_used").groupBy("blob_id").agg(F.count("*").alias("copies")).where("copies > 1"))
    n = several.agg(F.sum("copies")).first()[0]
    if not n:
        return rows.select(*blobs.columns, F.col("_used").alias("used"))
    owners = None
    if n <= fold_rows:
        contested = rows.where("_used").join(several, "blob_id", "left_semi").select(*ENTRY).distinct()
        shared = rows.where("_used").join(contested, list(ENTRY), "left_semi").join(several, "blob_id", "left")
        shared = settled(shared.select(*ORDER, "blob_id", F.coalesce("copies", F.lit(1)).alias("copies")))
        if shared.count() <= fold_rows:
            owners = _folded(shared).join(several.select("blob_id"), "blob_id", "left_semi")
    if owners is None:
        owners = _rounds(rows, several, fold_rows)
    # A row for each blob with several copies, one of which counts; an only copy does.
    owners = settled(owners.select("blob_id", F.struct(*ORDER).alias("_owner")))
    mine = F.col("_used") & (F.col("_owner").isNull() | F.struct(*ORDER).eqNullSafe(F.col("_owner")))
    return rows.join(owners, "blob_id", "left").select(*blobs.columns, mine.alias("used"))


def usage(owned: DataFrame) -> DataFrame:
    """Entries of packs() with used_blobs, unused_blobs, used_size, unused_size, uncompressed (whether any blob is)."""
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0))
    return packs(
        owned, F.count_if("used").alias("used_blobs"), F.count_if(~F.col("used")).alias("unused_blobs"), total(F.col("used")).alias("used_size"), total(~F.col("used")).alias("unused_size"),
        F.bool_or(F.col("uncompressed_length").isNull()).alias("uncompressed"),
    )


def sizes_of(entries: DataFrame) -> dict[str, int]:
    """All bytes of packs of each type, those marked for deletion and duplicates included: what a pack's size is judged against."""
    found = {r.blob_type: int(r.n) for r in entries.groupBy("blob_type").agg(F.sum("pack_size").alias("n")).collect()}
    return {t: found.get(t, 0) for t in ("tree", "data")}


def decided(entries: DataFrame, now: Column, options: Options = Options(), sizes: dict[str, int] | None = None) -> DataFrame:  # noqa: B008
    """entries of usage() with todo: Keep, Repack (a candidate, see repacked()), MarkDelete, Delete, KeepMarked, KeepMarkedAndCorrect or Recover; reason;
    and status, what was found about the pack, in the order of STATUSES.

    sizes: sizes_of() all entries of the index, before duplicates went; else those of entries count.
    """
    sizes = sizes_of(entries) if sizes is None else sizes
    either = lambda f: F.when(F.col("blob_type") == "tree", f(F.col("pack_size"), F.lit(sizes["tree"]), options.tree_sizing)).otherwise(f(F.col("pack_size"), F.lit(sizes["data"]), options.data_sizing))
    small, large, marked = either(too_small), either(too_large), F.col("to_delete")
    young = F.coalesce(F.col("pack_time") > now - F.expr(options.keep_pack), F.lit(False))
    fixed = young | (F.lit(options.repack_cacheable_only) & (F.col("blob_type") == "data"))
    uncompressed = F.lit(options.repack_uncompressed) & F.col("uncompressed")
    used, unused = F.col("used_blobs") > 0, F.col("unused_blobs") > 0
    old = F.coalesce(now - F.expr(options.keep_delete) >= F.col("pack_time"), F.lit(False))
    say = lambda todo, reason=None: F.struct(F.lit(todo).alias("todo"), F.lit(reason).cast("string").alias("reason"))
    of_live = (
        F.when(~used & young, say("Keep")).when(~used, say("MarkDelete")).when(fixed, say("Keep")).when(~unused & (uncompressed | F.lit(options.repack_all)), say("Repack", "ToCompress"))
        .when(~unused & (small | large), say("Repack", "SizeMismatch")).when(~unused, say("Keep")).otherwise(say("Repack", "PartlyUsed"))
    )
    of_marked = F.when(used, say("Recover")).when(old, say("Delete")).when(F.col("pack_time").isNull(), say("KeepMarkedAndCorrect")).otherwise(say("KeepMarked"))
    holds = {
        "NotCompressed": uncompressed, "TooYoung": F.when(marked, ~used & old).otherwise(young), "TimeNotSet": marked & ~used & F.col("pack_time").isNull(), "TooLarge": large, "TooSmall": small,
        "HasUnusedBlobs": ~marked & (~used | unused), "HasUsedBlobs": used, "Marked": marked,
    }
    status = F.filter(F.array(*(F.when(holds[s], F.lit(s)) for s in STATUSES)), lambda x: x.isNotNull())
    return entries.withColumns({"_d": F.when(marked, of_marked).otherwise(of_live), "status": status}).select(*[c for c in entries.columns if c != "status"], "_d.todo", "_d.reason", "status")


def share() -> Column:
    """Unused bytes of all, as a fraction of 2^64 that is exact enough to order any two packs: sizes below 2^32 differ by over 2^-64 or not at all."""
    whole = F.greatest(F.col("used_size") + F.col("unused_size"), F.lit(1)).cast("decimal(10,0)")
    scaled = F.col("unused_size").cast("decimal(10,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
    # Long division in whole numbers: a decimal quotient would be rounded.
    return F.floor((scaled - scaled % whole) / whole).cast("decimal(20,0)")


def repack_order() -> list[Column]:
    """Trees first, then the largest share of unused bytes, then index and pack."""
    return [F.when(F.col("blob_type") == "tree", 0).otherwise(1), share().desc(), F.col("index_id"), F.col("pack_id")]


class Fold:
    """Keep, Repack or None (its type decides, see grown) for each candidate, in order. after: unused bytes that stay for certain."""

    def __init__(self, after: int, max_repack: float, max_unused: float, no_resize: bool = False):
        self.after, self.max_repack, self.max_unused, self.no_resize = after, max_repack, max_unused, no_resize
        self.bytes_of, self.repacks = {"tree": 0, "data": 0}, set()

    def __call__(self, blob_type: str, reason: str, used_size: int, unused_size: int) -> str | None:
        resize = reason == "SizeMismatch"
        enough = self.after < self.max_unused and reason == "PartlyUsed" and blob_type == "data"
        if sum(self.bytes_of.values()) + used_size >= self.max_repack or enough or (resize and self.no_resize):
            return "Keep"
        self.bytes_of[blob_type] += used_size
        if resize:
            return None
        self.repacks.add(blob_type)
        self.after -= unused_size
        return "Repack"

    def whole(self, p) -> bool | None:
        """Whether all of a part of the order is kept (False) or taken (True), which then counts; None if its rows have to be looked at. p: type and types, least and sum of used_size, n, wrong (of
        wrong size), free (data partly used), and sum of the unused_size of rows of a right size."""
        room = self.max_repack - sum(self.bytes_of.values())
        if p.least >= room or (self.no_resize and p.wrong == p.n) or (self.after < self.max_unused and p.free == p.n):
            return False
        if p.types > 1 or p.used >= room or (self.no_resize and p.wrong) or (p.free and self.after - p.unused < self.max_unused):
            return None
        self.bytes_of[p.type] += p.used
        self.repacks |= {p.type} if p.wrong < p.n else set()
        self.after -= p.unused
        return True

    def grown(self, targets: dict[str, int]) -> dict[str, bool]:
        """Whether packs of a type that only have a wrong size are repacked: if others of it are anyway, or a whole pack comes together."""
        return {t: t in self.repacks or n > targets[t] for t, n in self.bytes_of.items()}


def repacked(entries: DataFrame, options: Options = Options(), sizes: dict[str, int] | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:  # noqa: B008
    """decided() entries with candidates settled: Repack or Keep, by limits on what is repacked and what may stay unused.

    Each candidate depends on the sums before it. Their order is cut into parts of about fold_rows, of which the driver has a row of sums each; parts that are kept or taken as a whole are told by
    these, and only others are folded, one after the other, each in a task of its own. A limit of 100 percent unused or more is no limit.
    """
    spark = entries.sparkSession
    ship(spark)
    entries = settled(entries)
    sizes = sizes_of(entries) if sizes is None else sizes
    is_candidate = F.coalesce(F.col("todo") == "Repack", F.lit(False))
    sums = entries.agg(
        F.sum("used_size").alias("used"), F.sum("unused_size").alias("unused"), F.sum(F.when(F.col("todo") == "MarkDelete", F.col("unused_size")).otherwise(0)).alias("gone"), F.count_if(is_candidate).alias("n")
    ).first()
    used, unused, gone = (int(x or 0) for x in sums[:3])
    inf = float("inf")
    cap, rest = options.max_repack, options.max_unused
    max_repack = cap.size if cap.size is not None else inf if cap.percent is None else cap.percent * (used + unused) // 100
    max_unused = 0 if options.repack_uncompressed or options.repack_all else rest.size if rest.size is not None else inf if rest.percent is None or rest.percent >= 100 else rest.percent * used // (100 - rest.percent)
    targets = spark.range(1).select(target_size(F.lit(sizes["tree"]), options.tree_sizing).alias("tree"), target_size(F.lit(sizes["data"]), options.data_sizing).alias("data")).first().asDict()
    if not sums.n:
        return entries
    rows = ranged(entries.where(is_candidate), repack_order(), -(-sums.n // fold_rows))
    wrong, free = F.col("reason") == "SizeMismatch", (F.col("reason") == "PartlyUsed") & (F.col("blob_type") == "data")
    parts = rows.groupBy("_part").agg(
        F.min("blob_type").alias("type"), F.count_distinct("blob_type").alias("types"), F.min("used_size").alias("least"), F.sum("used_size").alias("used"), F.count("*").alias("n"),
        F.count_if(wrong).alias("wrong"), F.count_if(free).alias("free"), F.coalesce(F.sum(F.when(~wrong, F.col("unused_size"))), F.lit(0)).alias("unused"),
    )
    fold = Fold(unused - gone, max_repack, max_unused, options.no_resize)
    taken, folded = [], {}
    for p in sorted(parts.collect(), key=lambda p: p["_part"]):
        what = fold.whole(p)
        if what is None:
            folded[p["_part"]], fold = _folded_part(of_part(rows, p["_part"]), fold)
        else:
            taken.append((p["_part"], what))
    grown = fold.grown(targets)
    resized = F.when(F.col("blob_type") == "tree", F.lit(grown["tree"])).otherwise(F.lit(grown["data"]))
    todo = lambda repack: F.when(~repack, "Keep").when(~wrong | resized, "Repack").otherwise("Keep")
    out = entries.where(~is_candidate)
    if taken:
        said = F.broadcast(spark.createDataFrame(taken, "_of long, _yes boolean"))  # at most a row for each part
        out = out.unionByName(rows.join(said, F.col("_part") == F.col("_of")).withColumn("todo", todo(F.col("_yes"))).select(*entries.columns))
    for part, said in folded.items():
        out = out.unionByName(of_part(rows, part).join(said, "_id").withColumn("todo", todo(F.col("_yes"))).select(*entries.columns))
    return out


def _folded_part(rows: DataFrame, fold: Fold) -> tuple[DataFrame, Fold]:
    """_id and _yes (taken for repacking, if only its type grows) of candidates, folded along _id in one task that holds a batch at a time; and the fold after them."""
    import pandas as pd

    def run(batches):
        here = pickle.loads(before)
        for pdf in batches:
            yes = [here(*row) != "Keep" for row in zip(pdf["blob_type"], pdf["reason"], pdf["used_size"].tolist(), pdf["unused_size"].tolist(), strict=True)]
            yield pd.DataFrame({"_id": pdf["_id"], "_yes": yes, "_after": None})
        yield pd.DataFrame({"_id": [-1], "_yes": [False], "_after": [pickle.dumps(here)]})

    before = pickle.dumps(fold)
    rows = rows.select("_id", "blob_type", "reason", "used_size", "unused_size").repartition(1).sortWithinPartitions("_id")
    said = settled(rows.mapInPandas(run, "_id long, _yes boolean, _after binary"))
    after = said.where("_id < 0").first()["_after"]
    return said.where("_id >= 0").select("_id", "_yes"), pickle.loads(bytes(after))


def existing(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Files of packs that a plan doesn't know (to be removed, unindexed) and packs that it keeps but that have no file or another size."""
    own = deduplicated(entries).select("pack_id", "pack_size", "todo")
    rows = own.join(files.select(F.col("id").alias("file"), "size"), F.col("pack_id") == F.col("file"), "full_outer")
    state = F.when(F.col("pack_id").isNull(), F.lit("unindexed")).when(F.col("file").isNull() & ~F.col("todo").isin("Delete"), F.lit("missing")).when(F.col("size") != F.col("pack_size"), F.lit("size mismatch"))
    return rows.select(F.coalesce("pack_id", "file").alias("pack_id"), state.alias("state")).where("state IS NOT NULL")


def duplicates(entries: DataFrame) -> DataFrame:
    """Entries that deduplicated() drops: other entries of the same packs."""
    return entries.select(*ENTRY).join(deduplicated(entries.select(*ENTRY)), list(ENTRY), "left_anti")


def index_files(entries: DataFrame, instant_delete: bool = False, least: int = BLOBS_PER_PACK, dropped: DataFrame | None = None) -> DataFrame:
    """index_id, rebuild: an index is written anew if a pack in it isn't simply kept, if duplicates() were dropped from it, or if it has fewer than least blobs. If
    all that is left to write is one index that is only too small, it stays."""
    changes = ~F.col("todo").isin("Keep", *(() if instant_delete else ("KeepMarked",)))
    rows = entries.select("index_id", changes.alias("changed"), F.col("blobs").alias("n"))
    if dropped is not None:
        rows = rows.unionByName(dropped.select("index_id", F.lit(True).alias("changed"), F.lit(0).cast("long").alias("n")))
    rows = rows.groupBy("index_id").agg(F.bool_or("changed").alias("changed"), F.sum("n").alias("n"))
    rows = rows.withColumn("rebuild", F.col("changed") | (F.col("n") < least))
    lone = rows.agg((~F.coalesce(F.bool_or("changed"), F.lit(False)) & (F.count_if("rebuild") == 1)).alias("lone"))
    return rows.select("index_id", (F.col("rebuild") & ~lone.scalar()).alias("rebuild"))


def stats(entries: DataFrame) -> DataFrame:
    """blob_type, todo, status, packs, used_blobs, unused_blobs, used_size, unused_size."""
    sums = ("used_blobs", "unused_blobs", "used_size", "unused_size")
    return entries.groupBy("blob_type", "todo", "status").agg(F.count("*").alias("packs"), *(F.sum(c).alias(c) for c in sums))


def gains(entries: DataFrame) -> DataFrame:
    """blob_type; of sizes and of blobs: used, unused, remove (unused, in packs that are marked now), repack (all of repacked packs), repackrm (their unused part) and unused_after.

    Packs marked before and deleted now have their own statistics, see pack_stats().
    """
    total = lambda c, *todo: F.coalesce(F.sum(F.when(F.col("todo").isin(*todo), c)), F.lit(0))
    out = []
    for unit in ("size", "blobs"):
        u, n = F.col(f"used_{unit}"), F.col(f"unused_{unit}")
        remove, gone = total(n, "MarkDelete"), total(n, "Repack")
        out += [F.sum(u).alias(f"used_{unit}"), F.sum(n).alias(f"unused_{unit}"), remove.alias(f"remove_{unit}"), total(u + n, "Repack").alias(f"repack_{unit}"), gone.alias(f"repackrm_{unit}"), (F.sum(n) - remove - gone).alias(f"unused_after_{unit}")]
    return entries.groupBy("blob_type").agg(*out)


def pack_stats(entries: DataFrame) -> DataFrame:
    """One row: live packs that are used, partly_used, unused, to repack, to keep; packs marked before that are removed, recovered or stay marked, and their bytes."""
    live, used, unused = ~F.col("to_delete"), F.col("used_blobs") > 0, F.col("unused_blobs") > 0
    of = {"remove": ("Delete",), "recover": ("Recover",), "keep": ("KeepMarked", "KeepMarkedAndCorrect")}
    return entries.agg(
        F.count_if(live & used & ~unused).alias("used"), F.count_if(live & used & unused).alias("partly_used"), F.count_if(live & ~used).alias("unused"),
        F.count_if(F.col("todo") == "Repack").alias("repack"), F.count_if(F.col("todo") == "Keep").alias("keep"),
        *(F.count_if(F.col("todo").isin(*t)).alias(f"marked_{k}") for k, t in of.items()),
        *(F.coalesce(F.sum(F.when(F.col("todo").isin(*t), F.col("pack_size"))), F.lit(0)).alias(f"marked_{k}_size") for k, t in of.items()),
    )


def plan(blobs: DataFrame, used: DataFrame, now: Column, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The whole plan; raises if used blobs are missing."""
    if missing(used, blobs).limit(1).count():
        raise LookupError("used blobs are missing in the index")
    first = blobs.withColumn("_first", is_first()).where("_first").drop("_first")
    sizes = sizes_of(packs(blobs))
    return repacked(decided(usage(ownership(first, used)), now, options, sizes), options, sizes)


def new_index(blobs: DataFrame, planned: DataFrame, now: Column) -> DataFrame:
    """Index rows after a plan: deleted packs go, repacked and unused ones are marked with the time, recovered ones are live again."""
    rows = blobs.join(planned.select(*ENTRY, "todo"), list(ENTRY)).where("todo <> 'Delete'")
    marks = F.col("todo").isin("MarkDelete", "Repack")
    gone = F.when(marks, F.lit(True)).when(F.col("todo") == "Recover", F.lit(False)).otherwise(F.col("to_delete"))
    at = F.when(marks | (F.col("todo") == "KeepMarkedAndCorrect"), now).otherwise(F.col("pack_time"))
    return rows.withColumns({"to_delete": gone, "pack_time": at}).drop("todo")
