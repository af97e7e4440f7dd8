"""Selecting, grouping, changing and copying snapshots."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.ids import is_full_id
from palimpsest.model import Config, guard
from palimpsest.operators.trees import roots_of

CRITERIA = ("hostname", "label", "paths", "tags")
#: Names of the criteria as users write them.
NAMES = {"host": "hostname", "label": "label", "paths": "paths", "tags": "tags"}


class NotFound(LookupError):
    pass


class NotUnique(LookupError):
    pass


def canonical(s: Column) -> Column:
    """A string list as the ordered set that it is."""
    return F.array_sort(F.array_distinct(F.coalesce(s, F.array().cast("array<string>"))))


def has_tags(tags: Column, wanted: Sequence[Sequence[str]]) -> Column:
    """Whether all tags of any of the lists are there. No lists: yes."""
    found = F.lit(not wanted)
    for each in wanted:
        found = found | (F.size(F.array_except(F.array(*map(F.lit, each)).cast("array<string>"), tags)) == 0)
    return found


def matching(snapshots: DataFrame, condition: Column | None = None) -> DataFrame:
    return snapshots if condition is None else snapshots.where(condition)


def newest_first(*more: str) -> list[Column]:
    """Equal times are told apart by id."""
    return [F.desc("time"), F.asc("id"), *map(F.asc, more)]


def ranked(snapshots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """back: 0 for the newest snapshot (of each group), 1 for the one before it, and so on."""
    return snapshots.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first())) - 1)


def latest(snapshots: DataFrame, n: int = 0, condition: Column | None = None) -> DataFrame:
    """The n-th snapshot before the newest: a bounded top-k, then its last row. Empty if there are fewer."""
    top = matching(snapshots, condition).orderBy(*newest_first()).limit(n + 1)
    return ranked(top).where(F.col("back") == n).drop("back")


def by_prefix(table: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, matches, id (where one matches, else null) for each row of prefixes (prefix).

    An equi-join: each id is offered under the lengths that prefixes have, of which there are at most as many as an id has characters."""
    own = prefixes.select("prefix").distinct()
    lengths = [r.n for r in own.select(F.length("prefix").alias("n")).distinct().where("n IS NOT NULL").collect()]
    cut = table.select("id", F.explode(F.array(*(F.substring("id", 1, n) for n in lengths)).cast("array<string>")).alias("cut")).where(F.length("id") >= F.length("cut"))
    hits = own.join(cut, F.col("prefix") == F.col("cut"), "left")
    return hits.groupBy("prefix").agg(F.count("id").alias("matches"), F.min("id").alias("id")).select("prefix", "matches", F.when(F.col("matches") == 1, F.col("id")).alias("id"))


def find_ids(table: DataFrame, requests: Sequence[str]) -> list[str]:
    """Ids for ids or prefixes. If all are whole ids they are taken as they are; else each must be the start of one id."""
    if all(map(is_full_id, requests)):
        return list(requests)
    found = {r.prefix: r for r in by_prefix(table, table.sparkSession.createDataFrame([(x,) for x in requests], "prefix string")).collect()}
    for x in requests:
        if not found[x].matches:
            raise NotFound(f"No suitable id found for `{x}`.")
        if found[x].matches > 1:
            raise NotUnique(f"Id `{x}` is not unique.")
    return [found[x].id for x in requests]


def parse_request(text: str) -> tuple[str, int | str]:
    """('latest', n) for latest and latest~n, ('id', text) for a whole id, ('start', text) else."""
    if m := re.fullmatch(r"latest(?:~(\d+))?", text):
        return "latest", int(m[1] or 0)
    return ("id" if is_full_id(text) else "start"), text


def requested(snapshots: DataFrame, requests: Sequence[str], condition: Column | None = None) -> DataFrame:
    """A row for each request, in their order (pos), repeats included. The condition holds for latest~n."""
    spark, asked = snapshots.sparkSession, [parse_request(x) for x in requests]
    backs = [(i, n) for i, (kind, n) in enumerate(asked) if kind == "latest"]
    ids = [(i, x) for i, (kind, x) in enumerate(asked) if kind != "latest"]
    out = None
    if backs:
        most = max(n for _, n in backs)
        top = ranked(matching(snapshots, condition).orderBy(*newest_first()).limit(most + 1))
        have = top.count()
        for i, n in backs:
            if n >= have:
                raise NotFound(f"No snapshots found for {requests[i]}.")
        out = spark.createDataFrame(backs, "pos int, back int").join(top, "back").drop("back")
    if ids:
        whole = find_ids(snapshots, [x for _, x in ids])
        named = spark.createDataFrame([(i, x) for (i, _), x in zip(ids, whole, strict=True)], "pos int, id string").join(snapshots, "id")
        out = named if out is None else out.unionByName(named)
    return out.orderBy("pos") if out is not None else snapshots.limit(0).withColumn("pos", F.lit(0))


def criterion(text: str) -> tuple[str, ...]:
    """The columns of a criterion such as host,label."""
    names = [x for x in text.split(",") if x]
    if unknown := [x for x in names if x not in NAMES]:
        raise ValueError(f"unknown criterion {unknown[0]}")
    return tuple(c for c in CRITERIA if c in [NAMES[x] for x in names])


DEFAULT_CRITERION = criterion("host,label,paths")


def group_key(by: Sequence[str] = DEFAULT_CRITERION) -> Column:
    """What a snapshot is grouped by: each field if it counts, else null."""
    of = {"hostname": "string", "label": "string", "paths": "array<string>", "tags": "array<string>"}
    value = lambda c: canonical(F.col(c)) if c == "tags" else F.col(c)
    return F.struct(*((value(c) if c in by else F.lit(None)).cast(of[c]).alias(c) for c in CRITERIA))


def grouped(snapshots: DataFrame, by: Sequence[str] = DEFAULT_CRITERION) -> DataFrame:
    """group, snapshots (their number), newest, oldest, in the order of groups, null before all else."""
    rows = snapshots.select(group_key(by).alias("group"), "time")
    return rows.groupBy("group").agg(F.count("*").alias("snapshots"), F.max("time").alias("newest"), F.min("time").alias("oldest")).orderBy(*(F.asc_nulls_first(f"group.{c}") for c in CRITERIA))


def members(snapshots: DataFrame, by: Sequence[str] = DEFAULT_CRITERION) -> DataFrame:
    """snapshots with group, what each is grouped by: the flat form of groups. Grouping that anew by other criteria regroups it."""
    return snapshots.withColumn("group", group_key(by))


def in_group(group: dict) -> Column:
    """Whether a snapshot belongs to a group; fields that are null there fit all."""
    found = F.lit(True)
    for c, v in group.items():
        if v is not None:
            found = found & ((canonical(F.col(c)) if c == "tags" else F.col(c)) == (F.array(*map(F.lit, sorted(v) if c == "tags" else v)) if isinstance(v, (list, tuple)) else F.lit(v)))
    return found


def must_keep(now: Column) -> Column:
    return (F.col("delete_kind") == "Never") | ((F.col("delete_kind") == "After") & (F.col("delete_after") >= now))


def must_delete(now: Column) -> Column:
    return (F.col("delete_kind") == "After") & (F.col("delete_after") < now)


def modified(
    snapshots: DataFrame, set_tags: Sequence[str] | None = None, add_tags: Sequence[str] = (), remove_tags: Sequence[str] = (), label: str | None = None, hostname: str | None = None,
    time: Column | None = None, description: str | None = None, delete: str | None = None, delete_after: Column | None = None,
) -> DataFrame:
    """Snapshots with changes made, and changed. Tags are set, then added, then removed; delete is NotSet, Never or After (with a time)."""
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    new: dict[str, Column] = {}
    tags = canonical(lit(set_tags)) if set_tags is not None else canonical(F.col("tags"))
    if set_tags is not None or add_tags or remove_tags:
        new["tags"] = canonical(F.array_except(F.array_union(tags, lit(add_tags)), lit(remove_tags)))
    new |= {c: F.lit(v) for c, v in (("label", label), ("hostname", hostname), ("description", description)) if v is not None}
    if time is not None:
        new["time"] = time
    if delete is not None:
        new["delete_kind"] = F.lit(delete)
        new["delete_after"] = delete_after if delete == "After" else F.lit(None).cast(snapshots.schema["delete_after"].dataType)
    same = F.lit(True)
    for c, v in new.items():
        same = same & v.eqNullSafe(canonical(F.col(c)) if c == "tags" else F.col(c))
    return snapshots.withColumn("changed", ~same).withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in new.items()})


def saved(snapshots: DataFrame) -> DataFrame:
    """As written anew: the first id stays in original, ids follow from content."""
    return snapshots.withColumn("original", F.coalesce("original", "id") if "original" in snapshots.columns else F.col("id"))


def refreshed(held: DataFrame, listing: DataFrame, stored: DataFrame, condition: Column | None = None) -> DataFrame:
    """Held rows whose id is still listed, and those listed that weren't held, read from stored. Only the latter are filtered."""
    ids = listing.select("id")
    fresh = stored.join(ids.join(held.select("id"), "id", "left_anti"), "id", "left_semi")
    return held.join(ids, "id", "left_semi").unionByName(matching(fresh, condition))


def without(snapshots: DataFrame, ids: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    guard(config, "deleting snapshots")
    return snapshots.join(ids.select("id"), "id", "left_anti")


def to_copy(snapshots: DataFrame, there: DataFrame) -> DataFrame:
    """Snapshots with relevant: whether the destination has none of the same time, which is how snapshots compare."""
    times = there.select(F.col("time").alias("there")).distinct()
    return snapshots.join(times, F.col("time") == F.col("there"), "left").withColumn("relevant", F.col("there").isNull()).drop("there")


def copied(snapshots: DataFrame) -> DataFrame:
    """Rows for the destination: ids and parents don't hold there."""
    gone = {c: F.lit(None).cast(snapshots.schema[c].dataType) for c in ("id", "parent") if c in snapshots.columns}
    return saved(snapshots).withColumns(gone | ({"parents": F.array().cast("array<string>")} if "parents" in snapshots.columns else {}))


def parents_of(new: DataFrame, snapshots: DataFrame, by: Sequence[str] = DEFAULT_CRITERION, force: bool = False) -> DataFrame:
    """new with parent: the newest snapshot of its group, none if forced."""
    if force:
        return new.withColumn("parent", F.lit(None).cast("string"))
    top = snapshots.groupBy(group_key(by).alias("g")).agg(F.max_by("id", F.struct("time", "id")).alias("found"))
    return new.drop("parent").join(top, group_key(by).eqNullSafe(F.col("g")), "left").drop("g").withColumnRenamed("found", "parent")


def merge_members(snapshots: DataFrame) -> DataFrame:
    """What a merge of snapshots records, a row for each: kind (paths, tags or parents) and value, each distinct, paths without those below others. Null lists and null values
    add nothing."""
    each = lambda c: snapshots.select(F.explode(c).alias("value"))
    of = {"paths": roots_of(each("paths").where("value IS NOT NULL").withColumnRenamed("value", "path")).withColumnRenamed("path", "value"), "tags": each("tags").distinct(), "parents": snapshots.select(F.col("id").alias("value")).distinct()}
    rows = [df.where("value IS NOT NULL").select(F.lit(kind).alias("kind"), "value") for kind, df in of.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _merged(snapshots: DataFrame, **columns: Column) -> DataFrame:
    """One row: the latest time and aggregates of merge_members(); no list goes through the driver."""
    rows = snapshots.select("time").unionByName(merge_members(snapshots), allowMissingColumns=True)
    return rows.agg(F.max("time").alias("time"), *(c.alias(k) for k, c in columns.items()))


def _listed(kind: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))


def merged(snapshots: DataFrame) -> DataFrame:
    """What a merge of snapshots records, one row: the latest time, all paths without those below others, all tags, all as parents.

    Each list is made distinct before it is collected; null lists and null paths add nothing; no snapshots: no time and empty lists. A row holds up to 2 GB, some 25 million
    parents; merge_members() has the same in rows, merge_counted() counts parents instead."""
    return _merged(snapshots, paths=_listed("paths"), tags=_listed("tags"), parents=_listed("parents"))


def merge_counted(snapshots: DataFrame) -> DataFrame:
    """merged() with the number of parents in place of their list."""
    return _merged(snapshots, paths=_listed("paths"), tags=_listed("tags"), parents=F.count_if(F.col("kind") == "parents"))


def path_of(template: str) -> Column:
    """A path for a snapshot from a template with {id}, {long_id}, {time}, {username}, {hostname}, {label}, {tags}, {backup_start}, {backup_end}."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd_HH-mm-ss")
    known = {
        "id": F.substring("id", 1, 8), "long_id": F.col("id"), "time": at("time"), "username": F.col("username"), "hostname": F.col("hostname"), "label": F.col("label"),
        "tags": F.array_join("tags", ","), "backup_start": at("backup_start"), "backup_end": at("backup_end"),
    }
    pieces = re.split(r"\{(\w+)\}", template)
    if unknown := [k for k in pieces[1::2] if k not in known]:
        raise KeyError(unknown[0])
    return F.concat(*(F.coalesce(known[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def durations(rows: DataFrame, start: str = "backup_start", end: str = "backup_end") -> DataFrame:
    """rows with duration: seconds between two times, to the microsecond."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.withColumn("duration", (micros(end) - micros(start)) / 1_000_000)
