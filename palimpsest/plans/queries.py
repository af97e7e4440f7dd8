"""One query for each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import ids, paths
from palimpsest.model import DATA_SIZING, TREE_SIZING
from palimpsest.operators import check, chunks, index, packing, prune, restore, retention, snapshots, trees, vfs
from palimpsest.plans import tables as t
from palimpsest.session import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 20)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def query(sql: str | None = None, *ctes: str):
    """Register a function under its name, with its SQL behind the tables it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if 'paths AS (' in ' '.join(ctes) else ''}{', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


# --- retention -------------------------------------------------------------------------------------------------------------------

# What must be equal within a period, in SQL.
PERIODS = {
    "last": "", "minutely": "year(time), (month(time) - 1) // 6, minute(time)", "hourly": "year(time), dayofyear(time), hour(time)", "daily": "year(time), dayofyear(time)", "weekly": "year(time), week(time)",
    "monthly": "year(time), month(time)", "quarter-yearly": "year(time), (month(time) - 1) // 3", "half-yearly": "year(time), (month(time) - 1) // 6", "yearly": "year(time)",
}


def retention_sql(source: str, counts: dict[str, int], within: dict[str, str] | None = None, extra: str = "", judged: str = "true") -> str:
    within = within or {}
    w = "OVER (PARTITION BY hostname ORDER BY time DESC, id)"
    flags, said = [], [extra] if extra else []
    for r in PERIODS:
        c = r.replace("-", "_")
        if r in counts:
            differs = f"coalesce(row({PERIODS[r]}) <> lag(row({PERIODS[r]})) {w}, true)" if PERIODS[r] else "true"
            flags.append(f"judged AND (lead(time) {w} IS NULL OR lag(time) {w} IS NULL OR {differs}) AS c_{c}")
            said.append(f"CASE WHEN c_{c} AND ({counts[r]} < 0 OR sum(c_{c}::INT) {w[:-1]} ROWS UNBOUNDED PRECEDING) <= {counts[r]}) THEN '{r}' END")
        if r in within:
            said.append(f"CASE WHEN time + {within[r]} > max(time) OVER (PARTITION BY hostname) THEN '{'within' if r == 'last' else 'within ' + r}' END")
    return f"""SELECT id, CASE forced WHEN 'keep' THEN true WHEN 'drop' THEN false WHEN 'same' THEN false ELSE len(found) > 0 END AS keep,
      CASE forced WHEN 'keep' THEN 'snapshot' WHEN 'drop' THEN 'snapshot' WHEN 'same' THEN 'unchanged' ELSE array_to_string(found, ',') END AS reasons
    FROM (SELECT id, forced, list_filter([{', '.join(said)}], lambda x: x IS NOT NULL) AS found FROM (SELECT *{''.join(', ' + x for x in flags)} FROM (SELECT *, {judged} AS forced, {judged} IS NULL AS judged FROM {source})))"""


def shown(judged: DataFrame) -> DataFrame:
    return judged.select("id", "keep", F.array_join("reasons", ",").alias("reasons"))


def _forget(name: str, source, cte: str, table: str, counts: dict[str, int]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = source(spark, sf).drop("delete_kind", "delete_after")
        return shown(retention.retained(rows, retention.Keep(counts=counts), by=["hostname"]))

    run.__name__ = name
    query(retention_sql(table, counts, judged="NULL::VARCHAR"), cte)(run)


for _name, _counts in (("last", {"last": 3}), ("minutely", {"minutely": 10}), ("hourly", {"hourly": 12}), ("daily", {"daily": 7}), ("weekly", {"weekly": 2}), ("daily_weekly", {"daily": 7, "weekly": 4}), ("unlimited", {"daily": -1, "yearly": 0})):
    _forget(f"forget_{_name}", t.snaps, t.SNAPS, "snaps", _counts)
for _name, _counts in (("monthly", {"monthly": 6}), ("quarter_yearly", {"quarter-yearly": 4}), ("half_yearly", {"half-yearly": 3}), ("yearly", {"yearly": 2}), ("combined", {"last": 1, "weekly": 5, "monthly": 6, "quarter-yearly": 3, "half-yearly": 2, "yearly": -1})):
    _forget(f"forget_{_name}", t.history, t.HISTORY, "history", _counts)


@query(retention_sql("snaps", {"last": 2, "daily": 7, "weekly": 4}, judged="NULL::VARCHAR"), t.SNAPS)
def forget_by_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows with no task sorting a whole group."""
    rows = t.snaps(spark, sf).drop("delete_kind", "delete_after")
    return shown(retention.retained(rows, retention.Keep(counts={"last": 2, "daily": 7, "weekly": 4}), by=["hostname"], cell="week"))


@query(retention_sql("snaps", {"daily": 1}, {"last": "INTERVAL 3 DAY", "daily": "INTERVAL 7 DAY"}, judged="NULL::VARCHAR"), t.SNAPS)
def forget_within(spark: SparkSession, sf: str) -> DataFrame:
    keep = retention.Keep(counts={"daily": 1}, within={"last": "INTERVAL 3 DAYS", "daily": "INTERVAL 7 DAYS"})
    return shown(retention.retained(t.snaps(spark, sf).drop("delete_kind", "delete_after"), keep, by=["hostname"]))


@query(retention_sql("snaps", {}, extra="CASE WHEN regexp_matches(id, '^(?:00|ab)') THEN 'id' END, CASE WHEN list_has_all(tags, ['click', 'small']) OR list_has_all(tags, ['error']) THEN 'tags' END", judged="NULL::VARCHAR"), t.SNAPS)
def forget_ids_tags(spark: SparkSession, sf: str) -> DataFrame:
    return shown(retention.retained(t.snaps(spark, sf).drop("delete_kind", "delete_after"), retention.Keep(ids=["00", "ab"], tags=[["click", "small"], ["error"]]), by=["hostname"]))


_MARK = f"TIMESTAMP '{NOW}'"


@query(
    retention_sql(
        "(SELECT *, lead(tree) OVER (PARTITION BY hostname ORDER BY time DESC, id) AS next_tree FROM snaps)", {"daily": 3},
        judged=f"CASE WHEN delete_kind = 'Never' OR (delete_kind = 'After' AND delete_after >= {_MARK}) THEN 'keep' WHEN delete_kind = 'After' THEN 'drop' WHEN coalesce(next_tree = tree, false) THEN 'same' END",
    ), t.SNAPS,
)
def forget_flags_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return shown(retention.retained(t.snaps(spark, sf), retention.Keep(counts={"daily": 3}, delete_unchanged=True), by=["hostname"], now=now()))


# --- snapshots -------------------------------------------------------------------------------------------------------------------


@query("SELECT id, time, hostname FROM snaps WHERE hostname = '1' ORDER BY time DESC, id LIMIT 1 OFFSET 2", t.SNAPS)
def snapshot_latest_n(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.latest(t.snaps(spark, sf), 2, F.col("hostname") == "1").select("id", "time", "hostname")


@query("SELECT hostname, id, time FROM snaps QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY time DESC, id) = 2", t.SNAPS)
def snapshot_latest_of_groups(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.ranked(t.snaps(spark, sf), ["hostname"]).where("back = 1").select("hostname", "id", "time")


@query("SELECT prefix, count(id) AS matches, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM (VALUES ('0'), ('5feceb'), ('6b86b2'), ('zz')) p(prefix) LEFT JOIN snaps ON starts_with(id, prefix) GROUP BY prefix", t.SNAPS)
def snapshot_prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.by_prefix(t.snaps(spark, sf), spark.createDataFrame([("0",), ("5feceb",), ("6b86b2",), ("zz",)], "prefix string"))


_IDS = "5feceb66ffc86f38d952786c6d696c79c2dbc239dd4e91b46729d73a27fb57e9"


@query(
    f"SELECT CAST(pos AS INTEGER) AS pos, id, time FROM (SELECT 0 AS pos, id, time FROM (SELECT * FROM snaps ORDER BY time DESC, id LIMIT 1 OFFSET 1) UNION ALL SELECT unnest([1, 3]), id, time FROM snaps WHERE id = '{_IDS}' UNION ALL SELECT 2, id, time FROM (SELECT * FROM snaps ORDER BY time DESC, id LIMIT 1))", t.SNAPS
)
def snapshot_requests(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.requested(t.snaps(spark, sf), ["latest~1", _IDS[:20], "latest", _IDS]).select("pos", "id", "time")


@query("SELECT id FROM snaps WHERE list_has_all(tags, ['click', 'large']) OR list_has_all(tags, ['view'])", t.SNAPS)
def snapshot_filter_tags(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.matching(t.snaps(spark, sf), snapshots.has_tags(F.col("tags"), [["click", "large"], ["view"]])).select("id")


@query("SELECT hostname, label, array_to_string(list_sort(tags), ',') AS tags, count(*) AS snapshots, max(time) AS newest, min(time) AS oldest FROM snaps GROUP BY hostname, label, list_sort(tags)", t.SNAPS)
def snapshot_group(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.grouped(t.snaps(spark, sf), snapshots.criterion("host,label,tags")).select("group.hostname", "group.label", F.array_join("group.tags", ",").alias("tags"), "snapshots", "newest", "oldest")


@query("SELECT id FROM snaps WHERE hostname = '3' AND label = 'click'", t.SNAPS)
def snapshot_group_matches(spark: SparkSession, sf: str) -> DataFrame:
    return t.snaps(spark, sf).where(snapshots.in_group({"hostname": "3", "label": "click", "paths": None, "tags": None})).select("id")


@query("SELECT id, array_to_string(new, ',') AS tags, new <> list_sort(list_distinct(tags)) AS changed FROM (SELECT id, tags, list_sort(list_distinct(list_filter(list_concat(tags, ['x', 'small']), lambda v: v <> 'view'))) AS new FROM snaps)", t.SNAPS)
def snapshot_modify_tags(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.modified(t.snaps(spark, sf), add_tags=["x", "small"], remove_tags=["view"]).select("id", F.array_join(snapshots.canonical(F.col("tags")), ",").alias("tags"), "changed")


@query(f"SELECT id, delete_kind <> 'Never' AS keepable, coalesce(delete_kind = 'Never' OR (delete_kind = 'After' AND delete_after >= {_MARK}), false) AS must_keep, coalesce(delete_kind = 'After' AND delete_after < {_MARK}, false) AS must_delete FROM snaps", t.SNAPS)
def snapshot_delete_flags(spark: SparkSession, sf: str) -> DataFrame:
    return t.snaps(spark, sf).select("id", (F.col("delete_kind") != "Never").alias("keepable"), F.coalesce(snapshots.must_keep(now()), F.lit(False)).alias("must_keep"), F.coalesce(snapshots.must_delete(now()), F.lit(False)).alias("must_delete"))


@query("SELECT id, time FROM snaps WHERE (label = 'click' AND hostname <> '1') OR (label <> 'click' AND hostname <> '1' AND tags[2] = 'small')", t.SNAPS)
def snapshot_update_incremental(spark: SparkSession, sf: str) -> DataFrame:
    stored = t.snaps(spark, sf)
    return snapshots.refreshed(stored.where("label = 'click'"), stored.where("hostname <> '1'").select("id"), stored, F.array_contains("tags", "small")).select("id", "time")


@query("SELECT a.id, NOT EXISTS (SELECT 1 FROM history b WHERE b.time = a.time AND b.label = '1-URGENT') AS relevant FROM history a WHERE a.label = '5-LOW'", t.HISTORY)
def copy_relevant(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.history(spark, sf)
    return snapshots.to_copy(rows.where("label = '5-LOW'"), rows.where("label = '1-URGENT'")).select("id", "relevant")


@query("SELECT s.id, arg_max(p.id, row(p.time, p.id)) AS parent FROM snaps s LEFT JOIN (SELECT * FROM snaps WHERE label <> 'error') p USING (hostname, label, paths) GROUP BY s.id", t.SNAPS)
def parent_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.snaps(spark, sf)
    return snapshots.parents_of(rows, rows.where("label <> 'error'")).select("id", "parent")


@query("SELECT max(time) AS time, array_to_string(list_sort(list_distinct(flatten(list(paths)))), ',') AS paths, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, len(list_distinct(list(id))) AS parents FROM snaps", t.SNAPS)
def snapshot_merge(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.merge_counted(t.snaps(spark, sf)).select("time", F.array_join("paths", ",").alias("paths"), F.array_join("tags", ",").alias("tags"), "parents")


@query("SELECT id, hostname || '/' || label || '/' || strftime(time, '%Y-%m-%d_%H-%M-%S') || '-' || substr(id, 1, 8) AS path FROM snaps", t.SNAPS)
def snapshot_path_template(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.snaps(spark, sf).withColumns({"username": F.lit(""), "backup_start": F.col("time"), "backup_end": F.col("time")})
    return rows.select("id", snapshots.path_of("{hostname}/{label}/{time}-{id}").alias("path"))


@query("SELECT id FROM snaps WHERE label <> 'click'", t.SNAPS)
def snapshot_delete(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.snaps(spark, sf)
    return snapshots.without(rows, rows.where("label = 'click'")).select("id")


# --- index, check ----------------------------------------------------------------------------------------------------------------


@query("SELECT index_id, pack_id, to_delete, blob_type, blobs, pack_size, pack_time FROM packs", t.BLOBS, t.PACKS)
def pack_size_formula(spark: SparkSession, sf: str) -> DataFrame:
    return index.packs(t.blobs(spark, sf)).select("index_id", "pack_id", "to_delete", "blob_type", "blobs", "pack_size", "pack_time")


@query("SELECT pack_id, index_id, to_delete FROM firsts", t.BLOBS, t.PACKS, t.FIRST)
def index_dedupe_packs(spark: SparkSession, sf: str) -> DataFrame:
    return index.deduplicated(index.packs(t.blobs(spark, sf))).select("pack_id", "index_id", "to_delete")


_KINDS = "(SELECT * FROM (VALUES (false), (true)) a(to_delete), (VALUES ('tree'), ('data')) b(blob_type)) k"


@query(f"SELECT k.to_delete, k.blob_type, count(b.blob_id) AS count, CAST(coalesce(sum(length), 0) AS BIGINT) AS size, CAST(coalesce(sum(coalesce(uncompressed_length, length - 32)), 0) AS BIGINT) AS data_size FROM {_KINDS} LEFT JOIN (SELECT b.*, p.blob_type AS pack_type FROM blobs b JOIN packs p USING (index_id, pack_id, to_delete)) b ON b.to_delete = k.to_delete AND b.pack_type = k.blob_type GROUP BY ALL", t.BLOBS, t.PACKS)
def index_infos_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return index.blob_infos(t.blobs(spark, sf))


@query(f"SELECT k.to_delete, k.blob_type, count(pack_id) AS count, min(pack_size) AS min_size, max(pack_size) AS max_size FROM {_KINDS} LEFT JOIN packs p ON p.to_delete = k.to_delete AND p.blob_type = k.blob_type GROUP BY ALL", t.BLOBS, t.PACKS)
def index_infos_packs(spark: SparkSession, sf: str) -> DataFrame:
    return index.pack_infos(t.blobs(spark, sf))


@query("SELECT blob_type, CAST(sum(pack_size) AS BIGINT) AS total_size FROM packs WHERE NOT to_delete GROUP BY blob_type", t.BLOBS, t.PACKS)
def index_total_size(spark: SparkSession, sf: str) -> DataFrame:
    return index.total_size(t.blobs(spark, sf))


@query("SELECT k.tpe, count(f.id) AS count, CAST(coalesce(sum(size), 0) AS BIGINT) AS size FROM (VALUES ('key'), ('snapshot'), ('index'), ('pack')) k(tpe) LEFT JOIN (SELECT 'pack' AS tpe, id, size FROM files UNION ALL SELECT 'snapshot', id, 1 FROM snaps) f USING (tpe) GROUP BY k.tpe", t.FILES, t.SNAPS)
def file_infos(spark: SparkSession, sf: str) -> DataFrame:
    found = t.pack_files(spark, sf).select(F.lit("pack").alias("tpe"), "id", "size").unionByName(t.snaps(spark, sf).select(F.lit("snapshot").alias("tpe"), "id", F.lit(1).cast("bigint").alias("size")))
    return index.file_infos(found)


@query('SELECT w.blob_type, w.blob_id, m.pack_id, m."offset", m.length, m.uncompressed_length FROM (SELECT CAST(p_partkey AS VARCHAR) AS blob_id, CASE WHEN p_size > 25 THEN \'tree\' ELSE \'data\' END AS blob_type FROM part) w LEFT JOIN (SELECT * FROM blobs WHERE NOT to_delete QUALIFY row_number() OVER (PARTITION BY blob_type, blob_id ORDER BY pack_id, "offset", length, uncompressed_length NULLS FIRST) = 1) m USING (blob_type, blob_id)', t.BLOBS)
def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("blob_id"), F.when(F.col("p_size") > 25, "tree").otherwise("data").alias("blob_type"))
    return index.lookup(wanted, t.blobs(spark, sf))


@query("SELECT DISTINCT CAST(l_partkey * 3 AS VARCHAR) AS blob_id FROM lineitem WHERE CAST(l_partkey * 3 AS VARCHAR) NOT IN (SELECT blob_id FROM blobs WHERE NOT to_delete)", t.BLOBS)
def index_unknown_blobs(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.read(spark, sf, "lineitem").select((F.col("l_partkey") * 3).cast("string").alias("blob_id"))
    return index.unknown(wanted, t.blobs(spark, sf)).select("blob_id")


@query('SELECT pack_id, blob_id, CAST(expected AS VARCHAR) AS expected, CAST("offset" AS VARCHAR) AS actual FROM (SELECT *, coalesce(sum(length) OVER (PARTITION BY index_id, pack_id, to_delete ORDER BY "offset", length, blob_id, blob_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM blobs) WHERE expected <> "offset"', t.BLOBS)
def pack_offsets_check(spark: SparkSession, sf: str) -> DataFrame:
    return check.offsets(t.blobs(spark, sf)).select("pack_id", "blob_id", "expected", "actual")


@query("SELECT pack_id, blob_id, p.blob_type AS expected, b.blob_type AS actual FROM blobs b JOIN packs p USING (index_id, pack_id, to_delete) WHERE p.blob_type <> b.blob_type", t.BLOBS, t.PACKS)
def pack_type_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return check.blob_types(t.blobs(spark, sf)).select("pack_id", "blob_id", "expected", "actual")


@query("SELECT pack_id FROM packs WHERE to_delete AND pack_time IS NULL", t.BLOBS, t.PACKS)
def pack_times_check(spark: SparkSession, sf: str) -> DataFrame:
    return check.pack_times(index.packs(t.blobs(spark, sf))).select("pack_id")


@query("SELECT CASE WHEN p.pack_id IS NULL THEN 'warning' ELSE 'error' END AS level, CASE WHEN p.pack_id IS NULL THEN 'PackNotReferenced' WHEN f.id IS NULL THEN 'NoPack' ELSE 'PackSizeMismatchIndex' END AS kind, coalesce(p.pack_id, f.id) AS pack_id, CAST(p.pack_size AS VARCHAR) AS expected, CAST(f.size AS VARCHAR) AS actual FROM firsts p FULL JOIN files f ON p.pack_id = f.id WHERE p.pack_id IS NULL OR f.id IS NULL OR p.pack_size <> f.size", t.BLOBS, t.PACKS, t.FIRST, t.FILES)
def pack_existence_diff(spark: SparkSession, sf: str) -> DataFrame:
    return check.listing(index.packs(t.blobs(spark, sf)), t.pack_files(spark, sf)).select("level", "kind", "pack_id", "expected", "actual")


@query("SELECT kind, count(*) AS count FROM (SELECT 'HotDataPack' AS kind FROM files JOIN firsts ON id = pack_id WHERE blob_type = 'data' UNION ALL SELECT CASE WHEN p.pack_id IS NULL THEN 'HotPackNotReferenced' WHEN f.id IS NULL THEN 'NoHotPack' ELSE 'HotPackSizeMismatchIndex' END FROM (SELECT * FROM firsts WHERE blob_type = 'tree') p FULL JOIN (SELECT * FROM files WHERE id NOT IN (SELECT pack_id FROM firsts WHERE blob_type = 'data')) f ON p.pack_id = f.id WHERE p.pack_id IS NULL OR f.id IS NULL OR p.pack_size <> f.size) GROUP BY kind", t.BLOBS, t.PACKS, t.FIRST, t.FILES)
def hot_packs_diff(spark: SparkSession, sf: str) -> DataFrame:
    return check.hot_listing(index.packs(t.blobs(spark, sf)), t.pack_files(spark, sf)).groupBy("kind").agg(F.count("*").alias("count"))


_HOT = "hot AS (SELECT CAST(o_orderkey * 2 AS VARCHAR) AS id, CAST(floor(o_totalprice) AS BIGINT) % 300 AS size FROM orders)"


@query("SELECT CASE WHEN c.id IS NULL THEN 'NoColdFile' WHEN h.id IS NULL THEN 'NoHotFile' ELSE 'HotFileSizeMismatch' END AS kind, coalesce(c.id, h.id) AS id, CASE WHEN c.id IS NULL THEN 'remove' ELSE 'copy' END AS action FROM files c FULL JOIN hot h ON c.id = h.id WHERE c.id IS NULL OR h.id IS NULL OR c.size <> h.size", t.FILES, _HOT)
def hotcold_diff(spark: SparkSession, sf: str) -> DataFrame:
    cold = t.pack_files(spark, sf)
    hot = t.read(spark, sf, "orders").select((F.col("o_orderkey") * 2).cast("string").alias("id"), (F.floor("o_totalprice").cast("bigint") % 300).alias("size"))
    return check.hot_cold(cold, hot).select("kind", F.col("pack_id").alias("id")).join(check.hot_cold_repair(cold, hot), "id").select("kind", "id", "action")


@query("SELECT id FROM hot WHERE (id, size) NOT IN (SELECT (id, size) FROM files)", t.FILES, _HOT)
def cache_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    hot = t.read(spark, sf, "orders").select((F.col("o_orderkey") * 2).cast("string").alias("id"), (F.floor("o_totalprice").cast("bigint") % 300).alias("size"))
    return check.cache_to_drop(hot, t.pack_files(spark, sf))


@query("SELECT coalesce(p.pack_id, f.id) AS pack_id, CASE WHEN f.id IS NULL THEN 'drop' WHEN p.pack_id IS NULL THEN 'add' WHEN p.pack_size <> f.size THEN 'reread' ELSE 'keep' END AS action FROM firsts p FULL JOIN files f ON p.pack_id = f.id", t.BLOBS, t.PACKS, t.FIRST, t.FILES)
def repair_index(spark: SparkSession, sf: str) -> DataFrame:
    return check.index_repair(index.packs(t.blobs(spark, sf)), t.pack_files(spark, sf))


_CONTENT = "held AS (SELECT root, path, type, subtree, unnest(CASE WHEN type = 'file' THEN content END) AS blob_id FROM paths WHERE root = 'all'), live AS (SELECT DISTINCT sha256(o_orderstatus || o_orderpriority) AS blob_id FROM orders WHERE o_orderstatus <> 'P')"


@query("SELECT 'FileBlobNotInIndex' AS kind, path, blob_id FROM held WHERE blob_id NOT IN (SELECT blob_id FROM live) UNION ALL SELECT 'SubTreeMissingInIndex', path, subtree FROM paths WHERE root = 'all' AND type = 'dir' AND subtree NOT LIKE 'R%'", t.NODES, _CONTENT)
def check_tree_contents(spark: SparkSession, sf: str) -> DataFrame:
    every = trees.closure(t.roots(spark).where("root = 'all'"), t.nodes(spark, sf))
    data = t.read(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("blob_id"), F.lit("data").alias("blob_type"))
    tree = t.read(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("blob_id"), F.lit("tree").alias("blob_type"))
    return check.contents(every, data.unionByName(tree).withColumn("to_delete", F.lit(False))).select("kind", "path", "blob_id")


@query("SELECT path, array_to_string(list(blob_id ORDER BY pos) FILTER (WHERE bytes IS NOT NULL), ',') AS content, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS size, count(*) FILTER (WHERE bytes IS NULL) AS missing FROM (SELECT name AS path, unnest(content) AS blob_id, unnest([1, 2]) AS pos FROM nodes WHERE type = 'file') LEFT JOIN (SELECT DISTINCT sha256(o_orderstatus || o_orderpriority) AS blob_id, 68 AS bytes FROM orders WHERE o_orderstatus <> 'P') USING (blob_id) GROUP BY path", t.NODES)
def repair_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    live = t.read(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("blob_id"), F.lit("data").alias("blob_type"), F.lit(False).alias("to_delete"), F.lit(100).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("uncompressed_length"))
    out = check.snapshot_repair(t.nodes(spark, sf).withColumnRenamed("name", "path"), live)
    return out.select("path", F.when(F.size("content") > 0, F.array_join("content", ",")).alias("content"), "size", "missing")


# --- packing ---------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, least(CAST(floor(sqrt(CAST(o_orderkey * 1000003 AS DOUBLE))) AS BIGINT) * 32 + 33554432, 4273995776) AS target, least(CAST(floor(sqrt(CAST(o_orderkey * 1000003 AS DOUBLE))) AS BIGINT) * 32 + 4194304, 4273995776) * 30 <= CAST(floor(o_totalprice) AS BIGINT) * 1000 AS ok FROM orders")
def pack_sizer(spark: SparkSession, sf: str) -> DataFrame:
    total = F.col("o_orderkey") * 1000003
    return t.read(spark, sf, "orders").select("o_orderkey", packing.target_size(total, DATA_SIZING).alias("target"), packing.size_ok(F.floor("o_totalprice").cast("bigint") * 10, total, TREE_SIZING).alias("ok"))


@query("SELECT id, size FROM (SELECT sha256(id) AS id, size FROM files) WHERE CAST(('0x' || substr(id, 7, 2) || substr(id, 5, 2) || substr(id, 3, 2) || substr(id, 1, 2))::UBIGINT % 7 AS INTEGER) = 3", t.FILES)
def read_subset_nm(spark: SparkSession, sf: str) -> DataFrame:
    return packing.subset_nm(t.pack_files(spark, sf).withColumn("id", F.sha2("id", 256)), 10, 7)


_TAKE = """ordered AS (SELECT list({'id': id, 'size': size, 'rest': CAST(20000 AS BIGINT), 'took': CAST([] AS VARCHAR[])} ORDER BY sha256('0:' || id)) AS l FROM files WHERE size < 20000),
  folded AS (SELECT list_reduce(l, lambda a, x: {'id': x.id, 'size': x.size, 'rest': a.rest - CASE WHEN a.rest > x.size THEN x.size ELSE 0 END, 'took': CASE WHEN a.rest > x.size THEN list_append(a.took, x.id) ELSE a.took END},
    {'id': '', 'size': CAST(0 AS BIGINT), 'rest': CAST(20000 AS BIGINT), 'took': CAST([] AS VARCHAR[])}) AS f FROM ordered)"""


@query("SELECT id, size FROM files WHERE id IN (SELECT unnest(f.took) FROM folded)", t.FILES, _TAKE)
def read_subset_size(spark: SparkSession, sf: str) -> DataFrame:
    return packing.subset_size(t.pack_files(spark, sf), limit=20000)


@query(None)
def read_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.blobs(spark, sf).select("pack_id", F.col("offset"), F.least("length", F.lit(25)).alias("length")).distinct()
    return packing.coalesced(wanted, hole=30, most=100)


SQL["read_coalesce"] = f"""WITH RECURSIVE {t.BLOBS}, wanted AS (SELECT DISTINCT pack_id, "offset" AS o, least(length, 25) AS l FROM blobs), ordered AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY o, l) AS n FROM wanted),
  folded AS (SELECT pack_id, n, o AS start, o + l AS stop, 1 AS read_no FROM ordered WHERE n = 1 UNION ALL
    SELECT x.pack_id, x.n, CASE WHEN j THEN f.start ELSE x.o END, x.o + x.l, CASE WHEN j THEN f.read_no ELSE f.read_no + 1 END
    FROM folded f JOIN ordered x ON x.pack_id = f.pack_id AND x.n = f.n + 1, LATERAL (SELECT x.o >= f.stop AND x.o <= f.stop + 30 AND x.o + x.l - f.start <= 100 AS j))
  SELECT pack_id, min(start) AS "offset", max(stop) - min(start) AS length, count(*) AS blobs FROM folded GROUP BY pack_id, read_no"""


@query(None)
def packer_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("writer"), F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").cast("bigint").alias("length"))
    return packing.filled(rows, "writer", ["pos"], 500000, 4).select("writer", "pos", "pack_no")


SQL["packer_fill"] = """WITH RECURSIVE ordered AS (SELECT CAST(o_custkey AS VARCHAR) AS writer, o_orderkey AS pos, CAST(floor(o_totalprice) AS BIGINT) AS length, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  folded AS (SELECT writer, pos, n, 0 AS pack_no, length AS size, 1 AS held FROM ordered WHERE n = 1 UNION ALL
    SELECT o.writer, o.pos, o.n, f.pack_no + c, CASE WHEN c = 1 THEN o.length ELSE f.size + o.length END, CASE WHEN c = 1 THEN 1 ELSE f.held + 1 END
    FROM folded f JOIN ordered o ON o.writer = f.writer AND o.n = f.n + 1, LATERAL (SELECT CASE WHEN f.size >= 500000 OR f.held >= 4 THEN 1 ELSE 0 END AS c))
  SELECT writer, pos, pack_no FROM folded"""


@query("SELECT id, (row_number() OVER (ORDER BY id) - 1) // 50 AS batch FROM files", t.FILES)
def warm_up_batches(spark: SparkSession, sf: str) -> DataFrame:
    return packing.batches(t.pack_files(spark, sf).select("id"), 50)


# --- chunks ----------------------------------------------------------------------------------------------------------------------


@query('SELECT path, pos, "offset", length(chunk) AS length, sha256(chunk) AS blob_id FROM chunks', t.CHUNKS)
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.fixed(t.chunk_source(spark, sf), 256).drop("chunk")


@query("SELECT CAST(count(*) AS BIGINT) AS chunks, count(DISTINCT chunk) AS distinct_chunks, CAST(sum(length(chunk)) AS BIGINT) AS bytes, (SELECT CAST(sum(length(chunk)) AS BIGINT) FROM (SELECT DISTINCT chunk FROM chunks)) AS distinct_bytes FROM chunks", t.CHUNKS)
def chunk_dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.dedup_stats(chunks.fixed(t.chunk_source(spark, sf), 256))


@query("SELECT DISTINCT sha256(chunk) AS blob_id FROM chunks WHERE path IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang <> 'en') AND chunk NOT IN (SELECT chunk FROM chunks WHERE path IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en'))", t.CHUNKS)
def chunk_new_blobs_anti(spark: SparkSession, sf: str) -> DataFrame:
    """English documents are stored; which blobs do the others add?"""
    docs = t.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "lang")
    stored = chunks.fixed(docs.where("lang = 'en'"), 256).select("blob_id", F.lit(False).alias("to_delete"))
    return index.unknown(chunks.fixed(docs.where("lang <> 'en'"), 256), stored).select("blob_id")


_OFFSETS = 'offsets AS (SELECT path, pos, sha256(chunk) AS blob_id, "offset" AS start, length(chunk) AS length FROM chunks)'


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every = chunks.fixed(t.chunk_source(spark, sf), 256)
    files = every.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "blob_id"))), lambda x: x["blob_id"]).alias("content"))
    return files, every.select("blob_id", "length", "chunk").dropDuplicates(["blob_id"])


@query("SELECT path, pos, blob_id, start, length FROM offsets", t.CHUNKS, _OFFSETS)
def restore_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.content_offsets(*_files(spark, sf))


@query("SELECT path, pos, greatest(300 - start, 0) AS skip, least(start + length, 1000) - greatest(300, start) AS take FROM offsets WHERE start < 1000 AND start + length > 300", t.CHUNKS, _OFFSETS)
def read_at_range(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.read_at(chunks.content_offsets(*_files(spark, sf)), 300, 700).select("path", "pos", "skip", "take")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS digest FROM documents WHERE length(text) > 0")
def dump_files(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.dumped(*_files(spark, sf)).select("path", F.sha2("content", 256).alias("digest"))


@query(None)
def chunk_rabin(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.content_defined(t.chunk_source(spark, sf), size=1024, least=512, most=8192)


@query('SELECT pack_id, "offset", length, array_to_string(list(path || \':\' || start ORDER BY path, start), \',\') AS targets FROM (SELECT o_orderkey::VARCHAR AS path, 0 AS start, CAST(o_custkey AS VARCHAR) AS blob_id FROM orders) JOIN (SELECT blob_id, pack_id, "offset", length FROM blobs QUALIFY row_number() OVER (PARTITION BY blob_id ORDER BY pack_id, "offset", length) = 1) USING (blob_id) GROUP BY blob_id, pack_id, "offset", length', t.BLOBS)
def restore_reads(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(0).cast("bigint").alias("start"), F.col("o_custkey").cast("string").alias("blob_id"))
    out = restore.reads(wanted, t.blobs(spark, sf))
    return out.select("pack_id", "offset", "length", F.array_join(F.transform("targets", lambda x: F.concat_ws(":", x["path"], x["start"].cast("string"))), ",").alias("targets"))


# --- trees -----------------------------------------------------------------------------------------------------------------------


@query("SELECT root, path, name, type, size, CAST(depth AS INTEGER) AS depth FROM paths", t.NODES)
def tree_closure(spark: SparkSession, sf: str) -> DataFrame:
    return trees.closure(t.roots(spark), t.nodes(spark, sf)).select("root", "path", "name", "type", "size", "depth")


@query("SELECT root, path, CAST(row_number() OVER (PARTITION BY root ORDER BY string_split(path, '/')) - 1 AS INTEGER) AS pos FROM paths WHERE NOT regexp_matches(path, '^/?(?:.*/)?o[^/]*7$')", t.NODES)
def tree_ls(spark: SparkSession, sf: str) -> DataFrame:
    return trees.listed(trees.closure(t.roots(spark), t.nodes(spark, sf)), ["!o*7"]).select("root", "path", "pos")


@query("SELECT root, path, type FROM paths WHERE regexp_matches(path, '^(?:.*/)?C[^/]*5(?:/.*)?$')", t.NODES)
def tree_find_glob(spark: SparkSession, sf: str) -> DataFrame:
    return trees.matching(trees.closure(t.roots(spark), t.nodes(spark, sf)), F.rlike("path", F.lit(paths.glob_regex("**/C*5")[:-1] + "(?:/.*)?$"))).select("root", "path", "type")


_TARGET = "(SELECT r_name || '/' || min(n_name) AS path FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 0 GROUP BY r_name)"


@query(f"SELECT r.root, p.name, p.subtree FROM roots r LEFT JOIN paths p ON p.root = r.root AND p.path = {_TARGET}", t.NODES)
def tree_find_path(spark: SparkSession, sf: str) -> DataFrame:
    n, r = t.read(spark, sf, "nation"), t.read(spark, sf, "region")
    path = r.where("r_regionkey = 0").join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.concat_ws("/", "r_name", F.min("n_name")).alias("p")).first().p
    return trees.at_path(t.roots(spark), t.nodes(spark, sf), path).select("root", "name", "subtree")


@query("SELECT tree_id, CAST(min(depth) AS INTEGER) AS depth, arg_min(path, depth) AS path FROM (SELECT subtree AS tree_id, depth, path FROM paths WHERE subtree IS NOT NULL UNION ALL SELECT tree_id, 0, '' FROM roots) GROUP BY tree_id", t.NODES)
def tree_unique_visit(spark: SparkSession, sf: str) -> DataFrame:
    return trees.reachable(t.roots(spark), t.nodes(spark, sf))


@query("SELECT DISTINCT unnest(content) AS blob_id, 'data' AS blob_type FROM paths WHERE content IS NOT NULL UNION ALL SELECT DISTINCT tree_id, 'tree' FROM (SELECT tree_id FROM roots UNION SELECT subtree FROM paths WHERE subtree IS NOT NULL)", t.NODES)
def used_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return trees.used_blobs(t.roots(spark), t.nodes(spark, sf))


@query("SELECT root, count(*) FILTER (WHERE type <> 'dir') AS files, count(*) FILTER (WHERE type = 'dir') AS dirs, CAST(coalesce(sum(size) FILTER (WHERE type = 'file'), 0) AS BIGINT) AS size FROM paths GROUP BY root", t.NODES)
def tree_summary(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_summary(trees.closure(t.roots(spark), t.nodes(spark, sf)))


_UP = "ups AS (SELECT path, array_to_string(parts[:i], '/') AS ancestor, len(parts) - i AS distance FROM (SELECT path, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM page_paths))"


@query("SELECT path, ancestor, CAST(distance AS INTEGER) AS distance FROM ups", t.PAGE_PATHS, _UP)
def tree_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return trees.ancestors(t.page_paths(spark, sf))


@query("SELECT event, path, CAST(n AS BIGINT) AS count FROM (SELECT 'Other' AS event, path, 1 AS n FROM page_paths UNION ALL SELECT unnest(['NewTree', 'EndTree']), ancestor, 1 FROM (SELECT DISTINCT ancestor FROM ups WHERE ancestor NOT IN (SELECT path FROM page_paths)))", t.PAGE_PATHS, _UP)
def tree_events(spark: SparkSession, sf: str) -> DataFrame:
    return trees.events(t.page_paths(spark, sf).withColumn("type", F.lit("file"))).groupBy("event", "path").agg(F.count("*").alias("count"))


@query("SELECT path FROM page_paths p WHERE NOT EXISTS (SELECT 1 FROM ups u JOIN page_paths q ON q.path = u.ancestor WHERE u.path = p.path)", t.PAGE_PATHS, _UP)
def path_merge_roots(spark: SparkSession, sf: str) -> DataFrame:
    return trees.roots_of(t.page_paths(spark, sf))


@query("SELECT path FROM page_paths WHERE NOT (regexp_matches(path, '^/?(?:.*/)?[^/]*7$') AND NOT regexp_matches(path, '^/?(?:.*/)?17$')) AND NOT regexp_matches(path, '^/?(?:.*/)?fr/[^/]*$')", t.PAGE_PATHS)
def exclude_globs(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.page_paths(spark, sf)
    return rows.where(~paths.excluded(F.col("path"), ["!*7"]) | F.rlike("path", F.lit(paths.glob_regex("17")))).where(~paths.excluded(F.col("path"), ["!**/fr/*"]))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders as files of several trees, one for each priority; mtime is the date."""
    o = t.read(spark, sf, "orders")
    return o.select(F.concat_ws("/", F.concat(F.lit("c"), F.col("o_custkey") % 50), F.concat(F.lit("f"), F.col("o_orderkey") % 97)).alias("path"), F.when(F.col("o_orderstatus") == "P", "symlink").otherwise("file").alias("type"), F.floor("o_totalprice").cast("bigint").alias("size"), F.col("o_orderdate").alias("mtime"), F.substring("o_orderpriority", 1, 1).cast("int").alias("source"), F.col("o_orderkey").alias("inode"))


_VERSIONS = "versions AS (SELECT 'c' || (o_custkey % 50) || '/f' || (o_orderkey % 97) AS path, CASE WHEN o_orderstatus = 'P' THEN 'symlink' ELSE 'file' END AS type, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS mtime, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS source, o_orderkey AS inode FROM orders)"


@query("SELECT path, max(mtime) AS mtime, arg_max(source, row(mtime, source)) AS source FROM versions GROUP BY path", _VERSIONS)
def tree_merge_latest(spark: SparkSession, sf: str) -> DataFrame:
    return trees.merged(_versions(spark, sf), F.col("mtime")).select("path", "mtime", "source")


_PAIRS = "news AS (SELECT path, any_value(type ORDER BY inode) AS type, any_value(size ORDER BY inode) AS size, min(mtime) AS mtime FROM versions WHERE source <= 3 GROUP BY path), olds AS (SELECT path, source AS parent_pos, any_value(type ORDER BY inode) AS type, any_value(size ORDER BY inode) AS size, min(mtime) AS mtime FROM versions GROUP BY path, source)"
_COMPARED = "compared AS (SELECT n.path, n.type, n.size, count(o.path) AS k, min(o.parent_pos) FILTER (WHERE o.type = n.type AND o.size = n.size AND o.mtime = n.mtime) AS parent_pos FROM news n LEFT JOIN olds o USING (path) GROUP BY ALL), statuses AS (SELECT *, CASE WHEN k = 0 THEN 'new' WHEN parent_pos IS NULL THEN 'changed' ELSE 'unmodified' END AS status FROM compared)"


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    rows = _versions(spark, sf)
    first = lambda c: F.min_by(c, "inode").alias(c)
    new = rows.where("source <= 3").groupBy("path").agg(first("type"), first("size"), F.min("mtime").alias("mtime"))
    old = rows.groupBy("path", F.col("source").alias("parent_pos")).agg(first("type"), first("size"), F.min("mtime").alias("mtime"))
    return trees.compared(new, old)


@query("SELECT path, parent_pos, status FROM statuses", _VERSIONS, _PAIRS, _COMPARED)
def parent_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select("path", "parent_pos", "status")


_SUMMARY = """dirs AS (SELECT 'dir' AS type, CASE WHEN bool_and(status = 'new') THEN 'new' WHEN bool_and(status = 'unmodified') THEN 'unmodified' ELSE 'changed' END AS status, NULL::BIGINT AS size FROM statuses GROUP BY split_part(path, '/', 1)),
  every AS (SELECT type, status, size FROM statuses UNION ALL SELECT * FROM dirs), added AS (SELECT blob_type, coalesce(uncompressed_length, length - 32) AS length, length AS packed FROM blobs WHERE NOT to_delete)"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE (type = 'dir') = {k == 'dirs'} AND status = '{s}') AS {k}_{s}" for k in ("files", "dirs") for s in ("new", "changed", "unmodified"))
_ADDED = ", ".join(f"CAST(sum({c}) FILTER (WHERE blob_type = '{t}') AS BIGINT) AS data_added_{n}{x}" for t, n in (("data", "files"), ("tree", "trees")) for c, x in (("length", ""), ("packed", "_packed")))


@query(
    f"SELECT * FROM (SELECT {_COUNTS}, count(*) FILTER (WHERE type <> 'dir') AS files_processed, count(*) FILTER (WHERE type = 'dir') AS dirs_processed, CAST(sum(size) AS BIGINT) AS bytes_processed FROM every), "
    f"(SELECT count(*) FILTER (WHERE blob_type = 'data') AS data_blobs, count(*) FILTER (WHERE blob_type = 'tree') AS tree_blobs, CAST(sum(length) AS BIGINT) AS data_added, CAST(sum(packed) AS BIGINT) AS data_added_packed, {_ADDED} FROM added)",
    _VERSIONS, _PAIRS, _COMPARED, t.BLOBS, _SUMMARY,
)
def backup_summary(spark: SparkSession, sf: str) -> DataFrame:
    files = _compared(spark, sf).select("path", "type", "status", "size")
    every = files.unionByName(trees.statuses_of_dirs(files), allowMissingColumns=True)
    added = t.blobs(spark, sf).where("NOT to_delete").select("blob_type", index.data_length().alias("length"), F.col("length").alias("packed"))
    return trees.backup_summary(every, added)


_SIDES = "wanted AS (SELECT path, arg_min(type, inode) AS type, arg_min(size, inode) AS size, min(mtime) AS mtime FROM versions WHERE source IN (1, 2) GROUP BY path), there AS (SELECT path, arg_min(type, inode) AS type, arg_min(size, inode) AS size, min(mtime) AS mtime FROM versions WHERE source IN (2, 3) GROUP BY path)"


@query("SELECT coalesce(w.path, t.path) AS path, coalesce(w.type, t.type) AS type, CASE WHEN w.path IS NULL THEN 'additional' WHEN t.path IS NULL THEN 'restore' WHEN w.type <> t.type THEN 'modify' WHEN w.type <> 'file' THEN 'unchanged' WHEN w.size = t.size AND w.mtime = t.mtime THEN 'unchanged' WHEN w.size = t.size THEN 'verify' ELSE 'modify' END AS action FROM wanted w FULL JOIN there t ON w.path = t.path", _VERSIONS, _SIDES)
def restore_plan_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = _versions(spark, sf)
    side = lambda *s: rows.where(F.col("source").isin(*s)).groupBy("path").agg(F.min_by("type", "inode").alias("type"), F.min_by("size", "inode").alias("size"), F.min("mtime").alias("mtime"))
    return restore.planned(side(1, 2), side(2, 3))


@query("SELECT path, CASE WHEN type = 'file' AND links > 1 AND inode <> 0 AND device_id <> 0 AND path <> first THEN first END AS link_to FROM (SELECT *, min(path) FILTER (WHERE type = 'file' AND links > 1 AND inode <> 0 AND device_id <> 0) OVER (PARTITION BY device_id, inode) AS first FROM (SELECT 'c' || o_custkey || '/' || o_orderkey AS path, CASE WHEN o_orderstatus = 'P' THEN 'fifo' ELSE 'file' END AS type, o_orderkey % 3 AS links, o_orderkey % 400 AS inode, o_custkey % 2 AS device_id FROM orders))")
def hardlink_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey")).alias("path"), F.when(F.col("o_orderstatus") == "P", "fifo").otherwise("file").alias("type"), (F.col("o_orderkey") % 3).alias("links"), (F.col("o_orderkey") % 400).alias("inode"), (F.col("o_custkey") % 2).alias("device_id"))
    return restore.without_hardlinks(rows).select("path", "link_to")


def _level(table: str, above: str, level: int, sub: str) -> str:
    return f"""{table} AS (SELECT root, {above} AS path, sha256('[' || string_agg('{{"name":"' || name || '","type":"' || type || '","size":' || coalesce(size, 0) || ',"content":"' || coalesce(array_to_string(content, ','), '') || '","subtree":"' || {sub} || '"}}', ',' ORDER BY name) || ']') AS tree_id
      FROM kept {'' if level == 4 else f"LEFT JOIN l{level + 1} ON l{level + 1}.root = kept.root AND l{level + 1}.path = kept.path"} WHERE depth = {level} GROUP BY kept.root, {above})""".replace("SELECT root", "SELECT kept.root")


_SUB = "CASE WHEN type = 'dir' THEN coalesce(l{0}.tree_id, sha256('[]')) ELSE '' END"
_ABOVE = "regexp_replace(kept.path, '/?[^/]*$', '')"
_REWRITTEN = ["kept AS (SELECT * FROM paths WHERE NOT regexp_matches(path, '^/?(?:.*/)?o[^/]*9$'))", _level("l4", _ABOVE, 4, "''"), *(_level(f"l{d}", _ABOVE, d, _SUB.format(d + 1)) for d in (3, 2, 1))]


@query("SELECT root, path, tree_id FROM l4 UNION ALL SELECT root, path, tree_id FROM l3 UNION ALL SELECT root, path, tree_id FROM l2 UNION ALL SELECT root, path, tree_id FROM l1", t.NODES, *_REWRITTEN)
def tree_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    return trees.rewritten(trees.closure(t.roots(spark), t.nodes(spark, sf)), ["!o*9"]).select("root", "path", "tree_id")


_VFS = "vfs AS (SELECT *, lag(path) OVER o AS was, lag(hostname) OVER o AS was_host, lag(tree) OVER o AS was_tree, lag(name) OVER o AS was_name FROM (SELECT *, strftime(time, '%Y-%m-%d_%H-%M-%S') AS name, hostname || '/' || strftime(time, '%Y-%m-%d_%H-%M-%S') AS path FROM snaps) WINDOW o AS (ORDER BY time, id))"


@query("SELECT path, CASE WHEN coalesce(was_host = hostname AND was_tree = tree, false) THEN 'link' ELSE 'tree' END AS kind, CASE WHEN coalesce(was_host = hostname AND was_tree = tree, false) THEN was_name END AS target FROM vfs WHERE was IS DISTINCT FROM path UNION ALL SELECT hostname || '/latest', 'link', arg_max(name, row(time, id)) FROM vfs GROUP BY hostname", t.SNAPS, _VFS)
def vfs_latest_and_identical(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.snaps(spark, sf).withColumns({"username": F.lit(""), "backup_start": F.col("time"), "backup_end": F.col("time")})
    return vfs.entries(rows, snapshots.path_of("{hostname}/{time}"), "link", True).select("path", "kind", "target")


# --- copy and prune --------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT unnest(content) AS blob_id FROM paths WHERE root = 'all' AND content IS NOT NULL EXCEPT SELECT unnest(content) FROM paths WHERE root = 'first' AND content IS NOT NULL", t.NODES)
def copy_needed_blobs(spark: SparkSession, sf: str) -> DataFrame:
    nodes, roots = t.nodes(spark, sf), t.roots(spark)
    there = trees.used_blobs(roots.where("root = 'first'"), nodes).withColumn("to_delete", F.lit(False))
    return index.unknown(trees.used_blobs(roots.where("root = 'all'"), nodes), there).where("blob_type = 'data'").select("blob_id")


def _used(spark: SparkSession, sf: str) -> DataFrame:
    """Parts below a size are in use."""
    return t.read(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").cast("string").alias("blob_id"))


def _single(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows with one copy of each blob: the blob's id tells the copies apart."""
    rows = t.blobs(spark, sf)
    return rows.withColumn("blob_id", F.concat_ws("-", "blob_id", "index_id", "pack_id", F.col("to_delete").cast("string"), "blob_pos"))


_SINGLE = """single AS (SELECT b.* REPLACE (concat_ws('-', blob_id, index_id, pack_id, CAST(to_delete AS VARCHAR), blob_pos) AS blob_id) FROM blobs b SEMI JOIN firsts USING (index_id, pack_id, to_delete)),
  used AS (SELECT blob_id FROM single WHERE CAST(split_part(blob_id, '-', 1) AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size < 20))"""
_USAGE = """usage AS (SELECT p.*, u.* EXCLUDE (index_id, pack_id, to_delete) FROM firsts p JOIN (SELECT index_id, pack_id, to_delete, count(x.blob_id) AS used_blobs, count(*) - count(x.blob_id) AS unused_blobs,
  CAST(coalesce(sum(length) FILTER (WHERE x.blob_id IS NOT NULL), 0) AS BIGINT) AS used_size, CAST(coalesce(sum(length) FILTER (WHERE x.blob_id IS NULL), 0) AS BIGINT) AS unused_size,
  bool_or(uncompressed_length IS NULL) AS uncompressed FROM single s LEFT JOIN used x ON s.blob_id = x.blob_id GROUP BY ALL) u USING (index_id, pack_id, to_delete)),
  aims AS (SELECT blob_type, CAST(floor(sqrt(CAST(sum(pack_size) AS DOUBLE))) AS BIGINT) + 300 AS aim FROM packs GROUP BY blob_type)"""
_PRUNE_NOW = datetime(2001, 1, 1)
# Written from the rules: sizes are judged against all packs, those marked and those indexed twice included.
_DECIDED = f"""decided AS (SELECT * EXCLUDE (young, old, small, large, aim), CASE WHEN to_delete THEN CASE WHEN used_blobs > 0 THEN 'Recover' WHEN old THEN 'Delete' WHEN pack_time IS NULL THEN 'KeepMarkedAndCorrect' ELSE 'KeepMarked' END
  WHEN used_blobs = 0 AND young THEN 'Keep' WHEN used_blobs = 0 THEN 'MarkDelete' WHEN young THEN 'Keep' WHEN unused_blobs = 0 AND NOT small AND NOT large THEN 'Keep' ELSE 'Repack' END AS todo,
  CASE WHEN NOT to_delete AND used_blobs > 0 AND NOT young THEN CASE WHEN unused_blobs > 0 THEN 'PartlyUsed' WHEN small OR large THEN 'SizeMismatch' END END AS reason,
  concat_ws(',', CASE WHEN (young AND NOT to_delete) OR (to_delete AND used_blobs = 0 AND old) THEN 'TooYoung' END, CASE WHEN to_delete AND used_blobs = 0 AND pack_time IS NULL THEN 'TimeNotSet' END, CASE WHEN large THEN 'TooLarge' END, CASE WHEN small THEN 'TooSmall' END,
    CASE WHEN NOT to_delete AND (used_blobs = 0 OR unused_blobs > 0) THEN 'HasUnusedBlobs' END, CASE WHEN used_blobs > 0 THEN 'HasUsedBlobs' END, CASE WHEN to_delete THEN 'Marked' END) AS status
  FROM (SELECT usage.*, aim, coalesce(pack_time > TIMESTAMP '{_PRUNE_NOW}' - INTERVAL 30 DAY, false) AS young, coalesce(pack_time <= TIMESTAMP '{_PRUNE_NOW}' - INTERVAL 23 HOUR, false) AS old,
    pack_size * 100 < 30 * aim AS small, pack_size * 100 > 110 * aim AS large FROM usage JOIN aims USING (blob_type)))"""
_PLANNED = (t.BLOBS, t.PACKS, t.FIRST, _SINGLE, _USAGE, _DECIDED)


def _prune_options(**k) -> prune.Options:
    from palimpsest.model import PackSizing

    return prune.Options(keep_pack="INTERVAL 30 DAYS", tree_sizing=PackSizing(300, 1, max_percent=110), data_sizing=PackSizing(300, 1, max_percent=110), **k)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """The index, which is made of other tables here, settled, with first: whether the row is of the entry that counts for its pack."""
    return settled(t.blobs(spark, sf).withColumn("first", index.is_first()))


def _usage(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Each copy of a blob is one of its own here, so that ownership is a plain join; prune_ownership has those with copies."""
    rows = rows.where("first").drop("first").withColumn("blob_id", F.concat_ws("-", "blob_id", "index_id", "pack_id", F.col("to_delete").cast("string"), "blob_pos"))
    used = rows.select("blob_id", F.split_part("blob_id", F.lit("-"), F.lit(1)).alias("part")).join(_used(spark, sf).withColumnRenamed("blob_id", "part"), "part", "left_semi")
    return prune.usage(prune.ownership(rows, used))


def _decided(spark: SparkSession, sf: str, plan=None, rows: DataFrame | None = None) -> DataFrame:
    """Decisions, or what plan makes of them and the sizes."""
    rows = _index(spark, sf) if rows is None else rows
    sizes = prune.sizes_of(index.packs(rows))
    found = prune.decided(_usage(spark, sf, rows), F.lit(_PRUNE_NOW).cast("timestamp_ntz"), _prune_options(), sizes)
    return plan(found, sizes) if plan else found


@query("SELECT index_id, pack_id, to_delete, blob_type, used_blobs, unused_blobs, used_size, unused_size FROM usage", *_PLANNED[:5])
def prune_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _usage(spark, sf, _index(spark, sf)).select("index_id", "pack_id", "to_delete", "blob_type", "used_blobs", "unused_blobs", "used_size", "unused_size")


@query("SELECT index_id, pack_id, to_delete, todo, reason, status FROM decided", *_PLANNED)
def prune_decide(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("index_id", "pack_id", "to_delete", "todo", "reason", F.array_join("status", ",").alias("status"))


@query("SELECT blob_type, todo, status, count(*) AS packs, CAST(sum(used_blobs) AS BIGINT) AS used_blobs, CAST(sum(unused_blobs) AS BIGINT) AS unused_blobs, CAST(sum(used_size) AS BIGINT) AS used_size, CAST(sum(unused_size) AS BIGINT) AS unused_size FROM decided GROUP BY ALL", *_PLANNED)
def prune_stats(spark: SparkSession, sf: str) -> DataFrame:
    return prune.stats(_decided(spark, sf)).withColumn("status", F.array_join("status", ","))


_LIMITS = (10, 5)
# The greedy choice as a fold over a list; sizes here are so small that shares are exact as doubles.
_FOLDED = f"""limits AS (SELECT {_LIMITS[0]} * CAST(sum(used_size + unused_size) AS BIGINT) // 100 AS cap, {_LIMITS[1]} * CAST(sum(used_size) AS BIGINT) // (100 - {_LIMITS[1]}) AS rest, CAST(sum(unused_size) - coalesce(sum(unused_size) FILTER (WHERE todo = 'MarkDelete'), 0) AS BIGINT) AS after FROM decided),
  ordered AS (SELECT *, row_number() OVER (ORDER BY blob_type = 'data', unused_size::DOUBLE / (used_size + unused_size) DESC, index_id, pack_id) AS n FROM decided WHERE todo = 'Repack'),
  folded AS (SELECT list_reduce(
      (SELECT list({{'t': blob_type, 'r': reason, 'u': used_size, 'x': unused_size, 'bt': 0::BIGINT, 'bd': 0::BIGINT, 'dt': false, 'dd': false, 'after': 0::BIGINT, 'said': []::VARCHAR[]}} ORDER BY n) FROM ordered),
      lambda a, c: {{'t': c.t, 'r': c.r, 'u': c.u, 'x': c.x,
        'bt': a.bt + CASE WHEN c.t = 'tree' AND NOT (a.bt + a.bd + c.u >= cap) THEN c.u ELSE 0 END,
        'bd': a.bd + CASE WHEN c.t = 'data' AND NOT (a.bt + a.bd + c.u >= cap OR (a.after < rest AND c.r = 'PartlyUsed')) THEN c.u ELSE 0 END,
        'dt': a.dt OR (c.t = 'tree' AND c.r <> 'SizeMismatch' AND NOT (a.bt + a.bd + c.u >= cap)),
        'dd': a.dd OR (c.t = 'data' AND c.r <> 'SizeMismatch' AND NOT (a.bt + a.bd + c.u >= cap OR (a.after < rest AND c.r = 'PartlyUsed'))),
        'after': a.after - CASE WHEN c.r <> 'SizeMismatch' AND NOT (a.bt + a.bd + c.u >= cap OR (a.after < rest AND c.r = 'PartlyUsed' AND c.t = 'data')) THEN c.x ELSE 0 END,
        'said': list_append(a.said, CASE WHEN a.bt + a.bd + c.u >= cap OR (a.after < rest AND c.r = 'PartlyUsed' AND c.t = 'data') THEN 'Keep' WHEN c.r = 'SizeMismatch' THEN 'Resize' ELSE 'Repack' END)}},
      {{'t': '', 'r': '', 'u': 0::BIGINT, 'x': 0::BIGINT, 'bt': 0::BIGINT, 'bd': 0::BIGINT, 'dt': false, 'dd': false, 'after': after, 'said': []::VARCHAR[]}}) AS f FROM limits),
  planned AS (SELECT d.* REPLACE (CASE WHEN o.n IS NULL THEN d.todo WHEN f.said[o.n] <> 'Resize' THEN f.said[o.n]
      WHEN CASE WHEN d.blob_type = 'tree' THEN f.dt OR f.bt > aim ELSE f.dd OR f.bd > aim END THEN 'Repack' ELSE 'Keep' END AS todo)
    FROM decided d JOIN aims USING (blob_type) LEFT JOIN ordered o USING (index_id, pack_id, to_delete) CROSS JOIN folded)"""


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    options = _prune_options(max_repack=prune.Limit(percent=_LIMITS[0]), max_unused=prune.Limit(percent=_LIMITS[1]))
    return _decided(spark, sf, lambda found, sizes: prune.repacked(found, options, sizes))


@query("SELECT index_id, pack_id, to_delete, todo FROM planned", *_PLANNED, _FOLDED)
def prune_decide_repack(spark: SparkSession, sf: str) -> DataFrame:
    return _planned(spark, sf).select("index_id", "pack_id", "to_delete", "todo")


def _gain(unit: str) -> str:
    total = lambda e, todo: f"CAST(coalesce(sum({e}) FILTER (WHERE todo = '{todo}'), 0) AS BIGINT)"
    u, n = f"used_{unit}", f"unused_{unit}"
    return f"CAST(sum({u}) AS BIGINT) AS {u}, CAST(sum({n}) AS BIGINT) AS {n}, {total(n, 'MarkDelete')} AS remove_{unit}, {total(f'{u} + {n}', 'Repack')} AS repack_{unit}, {total(n, 'Repack')} AS repackrm_{unit}, CAST(coalesce(sum({n}) FILTER (WHERE todo NOT IN ('MarkDelete', 'Repack')), 0) AS BIGINT) AS unused_after_{unit}"


@query(f"SELECT blob_type, {_gain('size')}, {_gain('blobs')} FROM planned GROUP BY blob_type", *_PLANNED, _FOLDED)
def prune_gains(spark: SparkSession, sf: str) -> DataFrame:
    return prune.gains(_planned(spark, sf))


@query(
    "SELECT count(*) FILTER (WHERE NOT to_delete AND used_blobs > 0 AND unused_blobs = 0) AS used, count(*) FILTER (WHERE NOT to_delete AND used_blobs > 0 AND unused_blobs > 0) AS partly_used, count(*) FILTER (WHERE NOT to_delete AND used_blobs = 0) AS unused, "
    "count(*) FILTER (WHERE todo = 'Repack') AS repack, count(*) FILTER (WHERE todo = 'Keep') AS keep, count(*) FILTER (WHERE todo = 'Delete') AS marked_remove, count(*) FILTER (WHERE todo = 'Recover') AS marked_recover, count(*) FILTER (WHERE todo LIKE 'KeepMarked%') AS marked_keep, "
    "CAST(coalesce(sum(pack_size) FILTER (WHERE todo = 'Delete'), 0) AS BIGINT) AS marked_remove_size, CAST(coalesce(sum(pack_size) FILTER (WHERE todo = 'Recover'), 0) AS BIGINT) AS marked_recover_size, CAST(coalesce(sum(pack_size) FILTER (WHERE todo LIKE 'KeepMarked%'), 0) AS BIGINT) AS marked_keep_size FROM planned",
    *_PLANNED, _FOLDED,
)
def prune_pack_stats(spark: SparkSession, sf: str) -> DataFrame:
    return prune.pack_stats(_planned(spark, sf))


_REBUILT = """dropped AS (SELECT DISTINCT index_id FROM packs ANTI JOIN firsts USING (index_id, pack_id, to_delete)),
  musts AS (SELECT p.index_id, bool_or(todo NOT IN ('Keep', 'KeepMarked')) OR p.index_id IN (FROM dropped) AS must, sum(blobs) < {least} AS small FROM {of} p GROUP BY p.index_id)"""


@query("SELECT index_id, (must OR small) AND NOT (SELECT NOT bool_or(must) AND count(*) FILTER (WHERE must OR small) = 1 FROM musts) AS rebuild FROM musts", *_PLANNED, _REBUILT.format(least=2500, of="decided"))
def prune_index_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _index(spark, sf)
    dropped = rows.where("NOT first").select(*index.ENTRY).distinct()
    return prune.index_files(_decided(spark, sf, rows=rows), least=2500, dropped=dropped)


@query("SELECT coalesce(d.pack_id, f.id) AS pack_id, CASE WHEN d.pack_id IS NULL THEN 'unindexed' WHEN f.id IS NULL AND d.todo <> 'Delete' THEN 'missing' WHEN f.size <> d.pack_size THEN 'size mismatch' END AS state FROM decided d FULL JOIN files f ON d.pack_id = f.id WHERE d.pack_id IS NULL OR (f.id IS NULL AND d.todo <> 'Delete') OR f.size <> d.pack_size", *_PLANNED, t.FILES)
def prune_existing_packs(spark: SparkSession, sf: str) -> DataFrame:
    return prune.existing(_decided(spark, sf), t.pack_files(spark, sf))


@query(f"SELECT b.index_id, b.pack_id, b.blob_pos, CASE WHEN todo IN ('MarkDelete', 'Repack') THEN true WHEN todo = 'Recover' THEN false ELSE b.to_delete END AS to_delete, CASE WHEN todo IN ('MarkDelete', 'Repack', 'KeepMarkedAndCorrect') THEN TIMESTAMP '{_PRUNE_NOW}' ELSE b.pack_time END AS pack_time FROM blobs b JOIN decided d USING (index_id, pack_id, to_delete) WHERE todo <> 'Delete'", *_PLANNED)
def prune_new_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = _index(spark, sf)
    out = prune.new_index(rows.where("first"), _decided(spark, sf, rows=rows), F.lit(_PRUNE_NOW).cast("timestamp_ntz"))
    return out.select("index_id", "pack_id", "blob_pos", "to_delete", "pack_time")


# Entries are visited one after the other; c: copies left of each used blob, o: the entry that has it, p: its place among that entry's used blobs.
_OWNED = """numbers AS (SELECT CAST(p_partkey AS VARCHAR) AS blob_id, row_number() OVER (ORDER BY p_partkey) AS b FROM part WHERE p_size < 20),
  held AS (SELECT index_id, pack_id, to_delete, blob_pos, b, row_number() OVER (PARTITION BY index_id, pack_id, to_delete ORDER BY blob_pos) AS j, row_number() OVER (PARTITION BY index_id, pack_id, to_delete, b ORDER BY blob_pos) AS r FROM blobs JOIN numbers USING (blob_id)),
  grouped AS (SELECT index_id, pack_id, to_delete, list(b ORDER BY j) AS bs, list(r ORDER BY j) AS rs, row_number() OVER (ORDER BY NOT to_delete, index_id, pack_id) AS n FROM held GROUP BY index_id, pack_id, to_delete),
  copies AS (SELECT list(least(k, 255) ORDER BY b) AS c FROM (SELECT n.b, count(h.b) AS k FROM numbers n LEFT JOIN held h USING (b) GROUP BY n.b)),
  folded AS (SELECT list_reduce((SELECT list({'bs': bs, 'rs': rs, 'n': n, 'at': NULL::BIGINT, 'c': []::BIGINT[], 'o': []::BIGINT[], 'p': []::BIGINT[]} ORDER BY n) FROM grouped),
    lambda a, x: list_transform([{'y': x, 'at': list_min(list_filter(range(1, len(x.bs) + 1), lambda q: a.c[x.bs[q]] > 0 AND a.c[x.bs[q]] = x.rs[q]))}], lambda z: {'bs': x.bs, 'rs': x.rs, 'n': x.n, 'at': z.at,
      'c': list_transform(a.c, lambda v, i: CASE WHEN v = 0 OR NOT list_contains(x.bs, i) THEN v WHEN z.at IS NOT NULL THEN 0 ELSE v - list_max(list_transform(x.bs, lambda w, k: CASE WHEN w = i THEN x.rs[k] ELSE 0 END)) END),
      'o': list_transform(a.o, lambda v, i: CASE WHEN z.at IS NOT NULL AND a.c[i] > 0 AND list_contains(x.bs, i) THEN x.n ELSE v END),
      'p': list_transform(a.p, lambda v, i: CASE WHEN z.at IS NOT NULL AND a.c[i] > 0 AND list_contains(x.bs, i) THEN CASE WHEN x.bs[z.at] = i THEN z.at ELSE list_position(x.bs, i) END ELSE v END)})[1],
    {'bs': []::BIGINT[], 'rs': []::BIGINT[], 'n': 0::BIGINT, 'at': NULL::BIGINT, 'c': c, 'o': list_transform(c, lambda v: 0::BIGINT), 'p': list_transform(c, lambda v: 0::BIGINT)}) AS f FROM copies),
  owned AS (SELECT h.index_id, h.pack_id, h.to_delete, h.blob_pos FROM held h JOIN grouped g USING (index_id, pack_id, to_delete) CROSS JOIN folded WHERE f.o[h.b] = g.n AND f.p[h.b] = h.j)"""


@query("SELECT index_id, pack_id, to_delete, blob_pos, blob_id, o.blob_pos IS NOT NULL AS used FROM blobs b LEFT JOIN owned o USING (index_id, pack_id, to_delete, blob_pos)", t.BLOBS, _OWNED)
def prune_ownership(spark: SparkSession, sf: str) -> DataFrame:
    return prune.ownership(t.blobs(spark, sf).select(*index.ENTRY, "blob_pos", "blob_id"), _used(spark, sf))


@query("SELECT id, id = repeat('0', 64) AS is_null, CAST(('0x' || substr(id, 7, 2) || substr(id, 5, 2) || substr(id, 3, 2) || substr(id, 1, 2))::UBIGINT AS BIGINT) AS as_u32 FROM snaps", t.SNAPS)
def id_functions(spark: SparkSession, sf: str) -> DataFrame:
    return t.snaps(spark, sf).select("id", ids.is_null_id(F.col("id")).alias("is_null"), ids.as_u32(F.col("id")).alias("as_u32"))


@query("SELECT o_orderkey AS inode, o_orderdate AS atime, NULL::TIMESTAMP AS ctime, CASE WHEN o_orderkey % 3 > 1 THEN o_custkey % 7 ELSE 0 END AS device_id FROM orders")
def node_modification(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("inode"), F.col("o_orderdate").alias("mtime"), F.lit(None).cast("timestamp_ntz").alias("atime"), F.col("o_orderdate").alias("ctime"), (F.col("o_custkey") % 7).alias("device_id"), (F.col("o_orderkey") % 3).alias("links"))
    return trees.with_policy(rows, ctime="none").select("inode", "atime", "ctime", "device_id")


@query("SELECT hostname, CAST(epoch_us(max(time)) - epoch_us(min(time)) AS DOUBLE) / 1000000 AS duration FROM snaps GROUP BY hostname", t.SNAPS)
def snapshot_durations(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.snaps(spark, sf).groupBy("hostname").agg(F.min("time").alias("backup_start"), F.max("time").alias("backup_end"))
    return snapshots.durations(rows).select("hostname", "duration")


@query(None)
def index_rollover(spark: SparkSession, sf: str) -> DataFrame:
    rows = index.packs(t.blobs(spark, sf)).where("NOT to_delete").select(F.col("index_id").alias("writer"), "pack_id", "blobs")
    return packing.index_files(rows, "writer", 300).select("writer", "pack_id", "index_no")


SQL["index_rollover"] = f"""WITH RECURSIVE {t.BLOBS}, {t.PACKS}, ordered AS (SELECT index_id AS writer, pack_id, blobs, row_number() OVER (PARTITION BY index_id ORDER BY pack_id) AS n FROM packs WHERE NOT to_delete),
  folded AS (SELECT writer, pack_id, n, 0 AS index_no, blobs AS held FROM ordered WHERE n = 1 UNION ALL
    SELECT o.writer, o.pack_id, o.n, f.index_no + c, CASE WHEN c = 1 THEN o.blobs ELSE f.held + o.blobs END
    FROM folded f JOIN ordered o ON o.writer = f.writer AND o.n = f.n + 1, LATERAL (SELECT CASE WHEN f.held >= 300 THEN 1 ELSE 0 END AS c))
  SELECT writer, pack_id, index_no FROM folded"""
