"""URL filtering against dated lists: entries become validity intervals, and an as-of join judges every capture
by the entries in force when it was fetched. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The production list. key: a domain (with all below it) or a domain and the first part of a path;
# action: block, allow (takes pages out of a wider block) or lift (the key's last entry no longer holds).
ENTRIES = (
    ("cheap-pills.example.com", "2023-01-01", "block"),
    ("tionsh.example.net", "2024-02-01", "block"),
    ("tionsh.example.net", "2024-05-01", "lift"),
    ("tionsh.example.net", "2024-09-15", "block"),
    ("blog.tionsh.example.net", "2024-03-10", "allow"),
    ("tionsh.example.net/de", "2024-10-01", "allow"),
    ("tionble.example.com", "2024-04-01", "block"),
    ("tionble.example.com", "2024-08-01", "allow"),
    ("tiontion.example.com/fr", "2024-01-15", "block"),
    ("ththth.example.org", "2024-06-01", "block"),
    ("thther.example.org/en", "2024-07-01", "block"),
    ("m.thther.example.org", "2024-07-20", "allow"),
    ("example.org/es", "2024-11-01", "block"),
)


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, since, until (null: open) from entries (key, at, action).

    An entry holds until the next entry of its key. Of several at one instant the last by action's name holds; lifts,
    null keys and null dates hold nothing.
    """
    rows = entries.where("key IS NOT NULL AND at IS NOT NULL").groupBy(F.lower("key").alias("key"), "at").agg(F.max("action").alias("action"))
    until = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    return rows.select("key", "action", F.col("at").alias("since"), until.alias("until")).where(F.col("action").isin("allow", "block"))


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none or it is over 253 characters, which no name is."""
    name = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), r"\.$", "")
    return F.when(F.length(name) <= 253, F.lower(name)).otherwise(F.lit(""))


def keys(url: Column) -> Column:
    """What a list may say about a URL: every domain that holds the host, alone and with the path's first part."""
    name, section = host(url), F.lower(F.regexp_extract(url, r"^[^:]*://[^/?#]*/([^/?#]+)", 1))
    labels = F.split(name, r"\.")
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    both = F.concat(domains, F.when(section != "", F.transform(domains, lambda d: F.concat(d, F.lit("/"), section))).otherwise(F.array().cast("array<string>")))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(both)


def as_listed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with host, list_key, since (both null: nothing matched), blocked.

    Of the entries in force at fetch time that of the longest domain decides, and its section before the whole
    domain. Null or hostless URLs and null fetch times match nothing and pass. Repeated captures each get a row; no
    captures: no rows; no entries: all pass; other columns are not read.

    Captures are made distinct by (url, fetched) first; only those are expanded to keys and joined on the
    key with the intervals. Hot keys are left to Spark's splitting of skewed joins, as both sides come straight from
    their exchanges.
    """
    rows = captures.select("page_id", "url", "fetched")
    asked = rows.where("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    asked = asked.select("url", "fetched", F.explode(keys(F.col("url"))).alias("key"))
    held = intervals(entries)
    hits = asked.join(held, (asked["key"] == held["key"]) & (held["since"] <= asked["fetched"]) & (held["until"].isNull() | (asked["fetched"] < held["until"])))
    best = hits.groupBy("url", "fetched").agg(F.max(F.struct(F.length(F.split_part(held["key"], F.lit("/"), F.lit(1))).alias("n"), held["key"].alias("key"), "since", "action")).alias("best"))
    best = best.select(F.col("url").alias("u"), F.col("fetched").alias("f"), "best")
    out = rows.join(best, (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left")
    return out.select(
        "page_id", "url", "fetched",
        F.coalesce(host(F.col("url")), F.lit("")).alias("host"),
        F.col("best.key").alias("list_key"),
        F.col("best.since").alias("since"),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
    )
