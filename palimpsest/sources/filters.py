"""Which entries of a folder a backup takes: ignore files, markers, extended attributes, file systems, sizes.

Entries: path, type (dir or file) and where used size, device_id, xattrs (array of names), content of ignore files. Directories may be left out
of the table; those above an entry count as such.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.paths import glob_regex, lineage, parts
from palimpsest.session import ship


def _rule(line: str) -> tuple[str, bool, bool] | None:
    """Regular expression, whether it takes back, whether for directories only; None for blank lines and comments."""
    line = line.rstrip("\r\n")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    glob = line[1:] if back else line
    glob = glob[1:] if glob[:2] in ("\\#", "\\!") else glob
    only_dirs, glob = glob.endswith("/"), glob.rstrip("/")
    return (glob_regex(glob), back, only_dirs) if glob.strip("/") else None


def rules(entries: DataFrame, names: Sequence[str], rank: int) -> DataFrame:
    """folder, rank, at (line), regex, back, only_dirs of all lines of ignore files of some names (path, content)."""
    ship(entries.sparkSession)
    own = entries.where(F.element_at(parts(F.col("path")), -1).isin(*names)).select("path", F.col("content").cast("string").alias("content"))
    lines = own.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.posexplode(F.split("content", "\n")).alias("at", "line"))

    @F.pandas_udf("regex string, back boolean, only_dirs boolean")
    def parsed(line: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_rule(x) or (None, None, None) for x in line], columns=["regex", "back", "only_dirs"])

    rows = lines.withColumn("r", parsed("line")).select("folder", F.lit(rank).alias("rank"), "at", "r.*")
    return rows.where("regex IS NOT NULL")


def _above(path: Column) -> Column:
    """All folders above a path, the root (empty) included."""
    return F.concat(F.array(F.lit("")), F.slice(lineage(path), F.lit(1), F.greatest(F.size(parts(path)) - 1, F.lit(0))))


def ignored(entries: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """path of entries that rules() leave out: of the rules that match, the one of the highest rank, then of the deepest folder, then the last one
    decides. What lies in a folder that is left out is left out too, and can't be taken back."""
    every = entries.select("path", (F.col("type") == "dir").alias("is_dir"))
    every = every.unionByName(entries.select(F.explode(F.slice(lineage(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)).alias("path"), F.lit(True).alias("is_dir")))
    every = every.groupBy("path").agg(F.bool_or("is_dir").alias("is_dir"))
    pairs = every.select("path", "is_dir", F.explode(_above(F.col("path"))).alias("folder")).join(rule_rows, "folder")
    within = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    hits = pairs.where((F.col("is_dir") | ~F.col("only_dirs")) & F.rlike(within, F.col("regex")))
    last = hits.groupBy("path").agg(F.max_by("back", F.struct("rank", F.size(parts(F.col("folder"))).alias("depth"), "at")).alias("back"))
    out = last.where("NOT back").select(F.col("path").alias("over"))
    return entries.select("path", F.explode(lineage(F.col("path"))).alias("over")).join(out, "over", "left_semi").select("path").distinct()


def _in_repositories(rule_rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rules whose folder lies in one that holds .git."""
    tops = entries.select(F.explode(lineage(F.col("path"))).alias("p")).where(F.element_at(parts(F.col("p")), -1) == ".git").select(F.regexp_replace("p", "/?[.]git$", "").alias("top")).distinct()
    spots = rule_rows.select("folder").distinct().select("folder", F.explode(F.array_union(_above(F.col("folder")), F.array("folder"))).alias("top"))
    return rule_rows.join(spots.join(tops, "top", "left_semi").select("folder").distinct(), "folder", "left_semi")


def filtered(
    entries: DataFrame, git_ignore: bool = False, no_require_git: bool = False, custom_ignorefiles: Sequence[str] = (), exclude_if_present: Sequence[str] = (), exclude_if_xattr: Sequence[str] = (),
    one_file_system: bool = False, exclude_larger_than: int | None = None,
) -> DataFrame:
    """entries that a backup takes.

    git_ignore: by .gitignore and .git/info/exclude, within repositories unless no_require_git; custom_ignorefiles: by files of these names, which come before those. exclude_if_present:
    not folders that hold a file of such a name. exclude_if_xattr: not entries that have one of these attributes, nor what is below them. one_file_system: not what lies on another device than
    the topmost entries (least path). exclude_larger_than: not files above that size. Null sizes, devices and attributes exclude nothing.
    """
    out: list[DataFrame] = []
    found: list[DataFrame] = []
    if git_ignore:
        own = rules(entries, [".gitignore"], 1)
        info = rules(entries.where(F.endswith("path", F.lit(".git/info/exclude"))), ["exclude"], 0)
        info = info.withColumn("folder", F.regexp_replace("folder", "/?[.]git/info$", ""))
        own = own.unionByName(info)
        found.append(own if no_require_git else _in_repositories(own, entries))
    if custom_ignorefiles:
        found.append(rules(entries, custom_ignorefiles, 2))
    if found:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        out.append(ignored(entries, every))
    over: list[DataFrame] = []
    if exclude_if_present:
        over.append(entries.where(F.element_at(parts(F.col("path")), -1).isin(*exclude_if_present)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("over")))
    if exclude_if_xattr:
        over.append(entries.where(F.coalesce(F.arrays_overlap("xattrs", F.array(*map(F.lit, exclude_if_xattr))), F.lit(False))).select(F.col("path").alias("over")))
    if one_file_system:
        top = entries.agg(F.min_by("device_id", "path").alias("d"))
        over.append(entries.where(F.coalesce(F.col("device_id") != top.scalar(), F.lit(False))).select(F.col("path").alias("over")))
    if over:
        every = over[0]
        for more in over[1:]:
            every = every.unionByName(more)
        within = F.concat(F.array(F.lit("")), lineage(F.col("path")))
        out.append(entries.select("path", F.explode(within).alias("over")).join(every.distinct(), "over", "left_semi").select("path").distinct())
    rows = entries if exclude_larger_than is None else entries.where(F.coalesce((F.col("type") == "dir") | (F.col("size") <= exclude_larger_than), F.lit(True)))
    for gone in out:
        rows = rows.join(gone, "path", "left_anti")
    return rows
