"""Which snapshots a retention policy keeps, and why.

Counting rules as windows: a snapshot is a candidate for a rule if its period differs from that of the next newer snapshot, or if it has no
newer or no older one. The first n candidates, newest first, are kept. Snapshots decided otherwise are passed over but still
count as the neighbour of what follows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.snapshots import has_tags, must_delete, must_keep


def periods(t: Column) -> dict[str, tuple[Column, ...]]:
    """What must be equal for two times to fall into one period of each rule, in the order of reasons.

    Weeks are ISO weeks with the calendar's year, so the last days of December can meet the first of their own year. Minutely
    compares the minute of the hour within half a year.
    """
    year, month = F.year(t), F.month(t)
    return {
        "last": (),
        "minutely": (year, F.floor((month - 1) / 6), F.minute(t)),
        "hourly": (year, F.dayofyear(t), F.hour(t)),
        "daily": (year, F.dayofyear(t)),
        "weekly": (year, F.weekofyear(t)),
        "monthly": (year, month),
        "quarter-yearly": (year, F.floor((month - 1) / 3)),
        "half-yearly": (year, F.floor((month - 1) / 6)),
        "yearly": (year,),
    }


RULES = ("last", "minutely", "hourly", "daily", "weekly", "monthly", "quarter-yearly", "half-yearly", "yearly")


@dataclass(frozen=True)
class Keep:
    """counts: rule to number, negative for all. within: rule to a Spark interval such as "INTERVAL 7 DAYS"."""

    counts: dict[str, int] = field(default_factory=dict)
    within: dict[str, str] = field(default_factory=dict)
    tags: Sequence[Sequence[str]] = ()
    ids: Sequence[str] = ()
    none: bool = False
    delete_unchanged: bool = False

    def check(self) -> None:
        if unknown := [r for r in (*self.counts, *self.within) if r not in RULES]:
            raise ValueError(f"unknown rule {unknown[0]}")
        if not (self.counts or self.within or self.tags or self.ids or self.none or self.delete_unchanged):
            raise ValueError("at least one keep option is needed")


def _beside(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what their cell's row adds; null keys are keys."""
    there = cells.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in cells.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(there, same).drop(*(f"_k{i}" for i in range(len(keys))))


def retained(snapshots: DataFrame, keep: Keep, by: Sequence[str] = (), now: Column | None = None, order: Sequence[str] = ("id",), cell: str | None = "month") -> DataFrame:
    """snapshots with keep and reasons (in a fixed order). by: columns that make groups; order: breaks ties of equal times.

    Columns used where present: time_local (else time) for calendar periods, tags, tree, delete_kind, delete_after. now is needed for the
    latter two only.

    Tasks sort cells of a group, such as its months: what a cell needs of its neighbours, their outermost snapshots and how many candidates they have, comes
    from tables with a row for each cell. With None as cell a group is sorted in one task; the result is the same. Null times make a cell of their own, the oldest.
    """
    keep.check()
    columns = snapshots.columns
    keys = [*by, "_cell"] if cell else [*by]
    group = Window.partitionBy(*keys)
    newest = group.orderBy(F.desc("time"), *map(F.asc, order))
    so_far = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.col("time_local" if "time_local" in columns else "time")
    flags, tree = "delete_kind" in columns, F.col("tree") if keep.delete_unchanged else F.lit(None).cast("string")
    now = F.current_timestamp() if now is None else now
    never = F.lit(False)
    rows = snapshots.withColumn("_cell", F.date_trunc(cell, "time")) if cell else snapshots
    rows = rows.withColumns({
        "_kept": must_keep(now) if flags else never,
        "_gone": must_delete(now) if flags else never,
        "_newer": F.lag(local).over(newest),
        "_older": F.lead(local).over(newest),
        "_older_tree": F.lead(tree).over(newest),
        "_latest": F.max("time").over(group),
    })
    if cell:
        outer = rows.where("_newer IS NULL").select(*keys, local.alias("_f"), tree.alias("_ft"), F.col("_latest").alias("_most"))
        outer = _beside(outer, rows.where("_older IS NULL").select(*keys, local.alias("_l")), keys)
        along = Window.partitionBy(*by).orderBy(F.desc("_cell"))
        cells = outer.select(*keys, F.lag("_l").over(along).alias("_cn"), F.lead("_f").over(along).alias("_co"), F.lead("_ft").over(along).alias("_ct"), F.max("_most").over(Window.partitionBy(*by)).alias("_cm"))
        rows = _beside(rows, cells, keys).withColumns({
            "_newer": F.coalesce("_newer", "_cn"), "_older_tree": F.when(F.col("_older").isNull(), F.col("_ct")).otherwise(F.col("_older_tree")), "_older": F.coalesce("_older", "_co"), "_latest": F.col("_cm"),
        })
    same = F.coalesce(F.col("_older_tree") == F.col("tree"), never) if keep.delete_unchanged else never
    rows = rows.withColumn("_same", same)
    judged = ~F.col("_kept") & ~F.col("_gone") & ~F.col("_same")
    mine, other = periods(local), periods(F.col("_newer"))
    equal = {r: (F.struct(*mine[r]) == F.struct(*other[r])) if mine[r] else never for r in keep.counts}
    candidate = {r: judged & (F.col("_older").isNull() | F.col("_newer").isNull() | ~equal[r]) for r in keep.counts}
    rows = rows.withColumns({f"_n_{r}": F.sum(c.cast("int")).over(so_far) for r, c in candidate.items()})
    if cell and candidate:
        before = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(*keys).agg(*(F.max(f"_n_{r}").alias(f"_c_{r}") for r in candidate))
        counts = counts.select(*keys, *(F.coalesce(F.sum(f"_c_{r}").over(before), F.lit(0)).alias(f"_b_{r}") for r in candidate))
        rows = _beside(rows, counts, keys).withColumns({f"_n_{r}": F.col(f"_n_{r}") + F.col(f"_b_{r}") for r in candidate})
    said: list[Column] = []
    if keep.ids:
        said.append(F.when(F.lit(False) | F.rlike("id", F.lit("^(?:" + "|".join(keep.ids) + ")")), F.lit("id")))
    if keep.tags:
        said.append(F.when(has_tags(F.col("tags"), keep.tags), F.lit("tags")))
    for r in RULES:
        if r in keep.counts:
            n = keep.counts[r]
            said.append(F.when(candidate[r] & (F.lit(n < 0) | (F.col(f"_n_{r}") <= n)), F.lit(r)))
        if r in keep.within:
            said.append(F.when(F.col("time") + F.expr(keep.within[r]) > F.col("_latest"), F.lit("within" if r == "last" else f"within {r}")))
    found = F.filter(F.array(*said), lambda x: x.isNotNull()) if said else F.array().cast("array<string>")
    reasons = F.when(F.col("_kept") | F.col("_gone"), F.array(F.lit("snapshot"))).when(F.col("_same"), F.array(F.lit("unchanged"))).otherwise(found)
    kept = F.col("_kept") | (judged & (F.size(found) > 0))
    return rows.select(*columns, kept.alias("keep"), reasons.alias("reasons"))


def forced(snapshots: DataFrame, now: Column) -> DataFrame:
    """An explicit list to forget: all go but those that must be kept."""
    return snapshots.withColumns({"keep": must_keep(now), "reasons": F.array(F.when(must_keep(now), F.lit("snapshot")).otherwise(F.lit("if argument")))})


def forgotten(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("keep")).select("id")
