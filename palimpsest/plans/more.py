"""More queries: stores and sources, state of snapshots, repairs, virtual paths."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import packfile, paths, times
from palimpsest.model import Config
from palimpsest.operators import check, chunks, index, restore, retention, snapshots, trees, vfs
from palimpsest.plans import tables as t
from palimpsest.plans.queries import NOW, now, query
from palimpsest.repository import Repository
from palimpsest.session import shared_dir, ship
from palimpsest.sources import entries, filters, store

# --- files of a store ------------------------------------------------------------------------------------------------------------


def _store(spark: SparkSession, sf: str) -> str:
    """nations as files of a new store: snapshots as JSON, one that can't be read, and packs."""
    root = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    rows = t.read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # a table of 25 rows at every scale
    files = {("snapshot", hashlib.sha256(r.n_name.encode()).hexdigest()): json.dumps({"hostname": r.n_name, "label": str(r.n_regionkey)}).encode() for r in rows}
    files["snapshot", "0" * 64] = b"{not json"
    files["snapshot", "no-id"] = b"{}"
    files |= {("pack", hashlib.sha256(b"p" + r.n_name.encode()).hexdigest()): r.n_name.encode() * 3 for r in rows}
    store.put(spark, root, files)
    store.put(spark, root, {("pack", "f" * 64): b"never"}, dry_run=True)
    return root


_BODY = "'{\"hostname\": \"' || n_name || '\", \"label\": \"' || n_regionkey || '\"}'"


@query(f"SELECT 'snapshot' AS tpe, sha256(n_name) AS id, length({_BODY}) AS size FROM nation UNION ALL SELECT 'snapshot', repeat('0', 64), 9 UNION ALL SELECT 'pack', sha256('p' || n_name), 3 * length(n_name) FROM nation")
def store_listing(spark: SparkSession, sf: str) -> DataFrame:
    root = _store(spark, sf)
    return store.listing(spark, root, "snapshot").unionByName(store.listing(spark, root, "pack"))


@query("SELECT sha256('p' || n_name) AS id, sha256(repeat(n_name, 3)) AS digest, substr(repeat(n_name, 3), 3, 4) AS part FROM nation")
def store_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.files(spark, _store(spark, sf), "pack")
    return rows.select("id", F.sha2("content", 256).alias("digest"), store.read_at(F.col("content"), F.lit(2), F.lit(4)).cast("string").alias("part"))


@query("SELECT sha256(n_name) AS id, n_name AS hostname, CAST(n_regionkey AS VARCHAR) AS label FROM nation")
def store_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A file that can't be read is left out."""
    return store.documents(spark, _store(spark, sf), "snapshot", "id string, hostname string, label string")


@query("SELECT sha256(n_name) AS id, n_name AS hostname FROM nation WHERE n_regionkey = 2")
def store_documents_listed(spark: SparkSession, sf: str) -> DataFrame:
    ids = t.read(spark, sf, "nation").where("n_regionkey = 2").select(F.sha2("n_name", 256).alias("id"))
    return store.documents(spark, _store(spark, sf), "snapshot", "id string, hostname string", ids)


_FIRST = hashlib.sha256(b"NATION_7").hexdigest()


@query(f"SELECT sha256(n_name) AS id, n_name AS hostname FROM nation WHERE sha256(n_name) = '{_FIRST}'")
def store_get(spark: SparkSession, sf: str) -> DataFrame:
    rows = store.documents(spark, _store(spark, sf), "snapshot", "id string, hostname string")
    return store.get(rows, snapshots.find_ids(rows.select("id"), [_FIRST[:10]])[0])


@query("SELECT sha256('p' || n_name) AS id, sha256(repeat(n_name, 3)) AS digest FROM nation WHERE starts_with(sha256('p' || n_name), (SELECT substr(min(sha256('p' || n_name)), 1, 20) FROM nation))")
def store_cat_file(spark: SparkSession, sf: str) -> DataFrame:
    root = _store(spark, sf)
    files = store.listing(spark, root, "pack")
    repo = Repository(spark, t.snaps(spark, sf), t.nodes(spark, sf), t.blobs(spark, sf), files)
    least = files.agg(F.min("id")).first()[0]
    return repo.cat_file(root, "pack", least[:20]).select("id", F.sha2("content", 256).alias("digest"))


@query("SELECT id, hostname FROM snaps WHERE label <> 'view'", t.SNAPS)
def store_save_and_remove(spark: SparkSession, sf: str) -> DataFrame:
    """Saved in folders by prefix, read back, less those removed; a dry run adds nothing."""
    rows, path = t.snaps(spark, sf), f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    store.save(rows.select("id", "hostname"), path, by="id")
    store.save(rows.select(F.lit("x").alias("id"), "hostname"), path, by="id", dry_run=True)
    return store.removed(spark.read.parquet(path), rows.where("label = 'view'").select("id")).select("id", "hostname")


@query("SELECT tpe, blob_type, op, count(*) AS n, CASE WHEN op = 'read_full' THEN 'hot' WHEN op = 'read_partial' THEN CASE WHEN tpe <> 'pack' OR blob_type = 'tree' THEN 'hot' ELSE 'cold' END WHEN tpe = 'config' OR (tpe = 'pack' AND blob_type <> 'tree') THEN 'cold' ELSE 'both' END AS target FROM (SELECT ['pack', 'index', 'config', 'snapshot'][1 + o_orderkey % 4] AS tpe, CASE WHEN o_orderkey % 4 = 0 THEN ['data', 'tree'][1 + o_custkey % 2] END AS blob_type, ['read_full', 'read_partial', 'write'][1 + o_orderkey % 3] AS op FROM orders) GROUP BY ALL")
def store_routed(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    asked = t.read(spark, sf, "orders").select(pick("o_orderkey", "pack", "index", "config", "snapshot").alias("tpe"), F.when(F.col("o_orderkey") % 4 == 0, pick("o_custkey", "data", "tree")).alias("blob_type"), pick("o_orderkey", "read_full", "read_partial", "write").alias("op"))
    return store.routed(asked).groupBy("tpe", "blob_type", "op", "target").agg(F.count("*").alias("n"))


_URLS = {"/srv/x": "/srv/x", "local:/srv/x": "file:///srv/x", "s3:bucket/x": "s3a://bucket/x", "hdfs://name/x": "hdfs://name/x", "gs:b/x": "gs://b/x", "rest:http://h/": None, "rclone:r:x": None}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {repr(p) if p else 'NULL'})" for u, p in _URLS.items()) + ") t(url, path)")
def store_locations(spark: SparkSession, sf: str) -> DataFrame:
    def found(url: str) -> str | None:
        try:
            return store.root_of(url)
        except ValueError:
            return None

    return spark.createDataFrame([(u, found(u)) for u in _URLS], "url string, path string")


@query("SELECT region || '/' || n_name AS path, length(n_name) AS size FROM (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS region FROM nation) WHERE region <> '3' AND length(n_name) <= 9")
def source_walked(spark: SparkSession, sf: str) -> DataFrame:
    """nations as files in a folder for each region, one of which is marked."""
    root = f"{shared_dir(spark).rstrip('/')}/walk-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    for r in [*t.read(spark, sf, "nation").select("n_name", "n_regionkey").collect(), None]:
        where = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.n_regionkey}/{r.n_name}" if r else f"{root}/3/NOBACKUP")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray((r.n_name if r else "").encode()))
        out.close()
    rows = store.walked(spark, root, marker="NOBACKUP", max_size=9)
    return rows.select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("path"), "size")


@query("SELECT 'stdin' AS path, 'file' AS type, CAST(5 AS BIGINT) AS size, sha256('hello') AS digest")
def source_stdin(spark: SparkSession, sf: str) -> DataFrame:
    return store.single(spark, b"hello").select("path", "type", "size", F.sha2("content", 256).alias("digest"))


class _Numbers(entries.Entries):
    """A source of files named by numbers, in as many parts as folders."""

    def parts(self) -> list[str]:
        return ["a", "b", "c"]

    def entries(self, part: str):
        yield from ((f"{part}/{i}", "file", len(str(i)), datetime(2020, 1, 1), str(i).encode()) for i in range(100))


@query("SELECT f || '/' || i AS path, length(CAST(i AS VARCHAR)) AS size, sha256(CAST(i AS VARCHAR)) AS digest FROM (SELECT unnest(['a', 'b', 'c']) AS f), range(100) r(i)")
def source_plugged_in(spark: SparkSession, sf: str) -> DataFrame:
    return entries.read(spark, _Numbers(), "query_numbers").select("path", "size", F.sha2("content", 256).alias("digest"))


_TREE = """tree AS (SELECT 'r' || (o_custkey % 5) || '/d' || (o_orderkey % 7) || '/f' || o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS device_id, o_orderpriority = '1-URGENT' AS tagged FROM orders)"""


@query(
    "SELECT path FROM tree WHERE NOT (starts_with(path, 'r1/') AND NOT regexp_matches(path, '^r1/d3/f[^/]*15$') AND (regexp_matches(path, '/f[^/]*5$') OR starts_with(path, 'r1/d2/'))) AND NOT (starts_with(path, 'r2/d4/') AND regexp_matches(path, '/f[^/]*1$')) AND NOT starts_with(path, 'r3/d5/') AND size <= 250000 AND device_id = 1 AND NOT tagged "
    "UNION ALL SELECT * FROM (VALUES ('r1/.git/HEAD'), ('r1/.gitignore'), ('r1/d3/.gitignore'), ('r2/.gitignore'), ('r2/d4/.own'))", _TREE,
)
def source_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Ignore files in and out of repositories, a marked folder, attributes, one device, a largest size."""
    o = t.read(spark, sf, "orders")
    rows = o.select(F.concat_ws("/", F.concat(F.lit("r"), F.col("o_custkey") % 5), F.concat(F.lit("d"), F.col("o_orderkey") % 7), F.concat(F.lit("f"), F.col("o_orderkey"))).alias("path"), F.lit("file").alias("type"), F.floor("o_totalprice").cast("bigint").alias("size"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).cast("bigint").alias("device_id"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("user.skip"))).alias("xattrs"), F.lit(None).cast("string").alias("content"))
    own = [("r1/.git/HEAD", ""), ("r1/.gitignore", "f*5\n/d2/\n# none\n"), ("r1/d3/.gitignore", "!f*15\n"), ("r2/.gitignore", "*\n"), ("r2/d4/.own", "f*1\n"), ("r3/d5/CACHE", "")]
    rows = rows.unionByName(spark.createDataFrame([(p, "file", 1, 1, None, c) for p, c in own], "path string, type string, size long, device_id long, xattrs array<string>, content string"))
    out = filters.filtered(rows, git_ignore=True, custom_ignorefiles=[".own"], exclude_if_present=["CACHE"], exclude_if_xattr=["user.skip"], one_file_system=True, exclude_larger_than=250000)
    return out.select("path")


# --- snapshots -------------------------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN label = 'view' THEN 'first' ELSE id END AS original FROM snaps", t.SNAPS)
def snapshot_saved(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.saved(t.snaps(spark, sf).withColumn("original", F.when(F.col("label") == "view", "first"))).select("id", "original")


@query("SELECT id, prefix FROM (SELECT substr(sha256(CAST(k AS VARCHAR)), 1, 12) AS prefix FROM (VALUES (1), (7), (30)) v(k)) JOIN snaps ON starts_with(id, prefix)", t.SNAPS)
def snapshot_find_ids(spark: SparkSession, sf: str) -> DataFrame:
    asked = [hashlib.sha256(str(k).encode()).hexdigest()[:12] for k in (1, 7, 30)]
    return spark.createDataFrame([*zip(snapshots.find_ids(t.snaps(spark, sf), asked), asked, strict=True)], "id string, prefix string")


@query("SELECT label, count(DISTINCT hostname) AS hosts, CAST(sum(n) AS BIGINT) AS snapshots FROM (SELECT hostname, label, count(*) AS n FROM snaps GROUP BY ALL) GROUP BY label", t.SNAPS)
def snapshot_regroup(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by host and label, flat, and grouped anew by label."""
    flat = snapshots.members(t.snaps(spark, sf), snapshots.criterion("host,label")).withColumnRenamed("group", "was")
    again = snapshots.members(flat, snapshots.criterion("label"))
    return again.groupBy(F.col("group.label").alias("label")).agg(F.countDistinct("was.hostname").alias("hosts"), F.count("*").alias("snapshots"))


@query(f"SELECT id, coalesce(delete_kind = 'Never' OR (delete_kind = 'After' AND delete_after >= TIMESTAMP '{NOW}'), false) AS keep, CASE WHEN coalesce(delete_kind = 'Never' OR (delete_kind = 'After' AND delete_after >= TIMESTAMP '{NOW}'), false) THEN 'snapshot' ELSE 'if argument' END AS reason FROM snaps WHERE label = 'click'", t.SNAPS)
def forget_listed(spark: SparkSession, sf: str) -> DataFrame:
    """A list of snapshots to forget."""
    return retention.forced(t.snaps(spark, sf).where("label = 'click'"), now()).select("id", "keep", F.element_at("reasons", 1).alias("reason"))


@query("SELECT id FROM snaps QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY time DESC, id) > 4", t.SNAPS)
def forget_ids(spark: SparkSession, sf: str) -> DataFrame:
    """What is to be forgotten, as ids."""
    rows = t.snaps(spark, sf).drop("delete_kind", "delete_after")
    return retention.forgotten(retention.retained(rows, retention.Keep(counts={"last": 4}), by=["hostname"]))


_POLICIES = {"none at all": ({}, False), "daily": ({"counts": {"daily": 1}}, True), "unknown": ({"counts": {"nightly": 1}}, False), "none": ({"none": True}, True), "tags": ({"tags": [["a"]]}, True), "unchanged": ({"delete_unchanged": True}, True)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {v[1]})" for n, v in _POLICIES.items()) + ") t(policy, valid)")
def forget_valid(spark: SparkSession, sf: str) -> DataFrame:
    def valid(options: dict) -> bool:
        try:
            retention.Keep(**options).check()
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(n, valid(o)) for n, (o, _) in _POLICIES.items()], "policy string, valid boolean")


@query("SELECT id, array_to_string(list_sort(list_distinct(list_append(tags, 'rewrite'))), ',') AS tags, 'new' AS label, id AS original FROM snaps", t.SNAPS)
def snapshot_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    repo = Repository(spark, t.snaps(spark, sf), t.nodes(spark, sf), t.blobs(spark, sf), t.pack_files(spark, sf))
    return repo.rewrite_snapshots(label="new").select("id", F.array_join(snapshots.canonical(F.col("tags")), ",").alias("tags"), "label", "original")


@query("SELECT id, id AS original, NULL::VARCHAR AS new_id, 0 AS parents FROM snaps WHERE label = 'click'", t.SNAPS)
def copy_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots as another store takes them."""
    rows = t.snaps(spark, sf).where("label = 'click'").withColumn("parents", F.array("id"))
    return snapshots.copied(rows).select(F.col("original").alias("id"), "original", F.col("id").alias("new_id"), F.size("parents").alias("parents"))


@query("SELECT id FROM snaps WHERE hash_of % 3 = 0", t.SNAPS.replace("SELECT sha256", "SELECT length(event_type) + user_id AS hash_of, sha256"))
def snapshot_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate in Python, over Arrow batches."""
    import pandas as pd

    def wanted(label: pd.Series, host: pd.Series) -> pd.Series:
        return (label.str.len() + host.astype(int)) % 3 == 0

    wanted.__annotations__ = {"label": pd.Series, "host": pd.Series, "return": pd.Series}
    return snapshots.matching(t.snaps(spark, sf), F.pandas_udf(wanted, "boolean")("label", "hostname")).select("id")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 0 THEN date_trunc('day', moment) WHEN 3 THEN date_trunc('minute', moment) ELSE moment END AS moment FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey) AS moment FROM orders)")
def times_lenient(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)"))
    kinds = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm"]
    text = F.lit("none of these")
    for i, k in enumerate(kinds):
        text = F.when(F.col("o_orderkey") % 5 == i, F.date_format(at, k)).otherwise(text)
    return t.read(spark, sf, "orders").select("o_orderkey", times.lenient(text).cast("timestamp_ntz").alias("moment"))


# What names of parts mean on 2024-03-10, a Sunday in week 10, at 17 hours.
_NAMED = {("hourly", "day"): (17, 24), ("daily", "week"): (69 % 7, 7), ("daily", "month"): (69 % 31, 31), ("daily", "year"): (69, 366), ("weekly", "year"): (9, 52), ("monthly", "year"): (2, 12), ("3", "7"): (3, 7), ("weekly", "month"): (9 % 4, 4)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{m}', {a}, {b})" for (n, m), (a, b) in _NAMED.items()) + ") t(n, m, part, parts)")
def subset_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, m, *times.named_subset(datetime(2024, 3, 10, 17), n, m)) for n, m in _NAMED], "n string, m string, part int, parts int")


@query("SELECT doc_id, replace(replace(replace(name, '\\', '\\\\'), chr(10), '\\n'), '\"', '\\\"') AS stored, sha256(name) AS back FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 60) AS name FROM documents) WHERE NOT regexp_matches(name, '[\\x00-\\x09\\x0B-\\x1F]')")
def path_escapes(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of documents as file names: stored form, and the bytes it gives back. Names with other control characters aren't compared."""
    rows = t.read(spark, sf, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("name")).where(~F.rlike("name", F.lit("[\\x00-\\x09\\x0B-\\x1F]")))
    rows = rows.withColumn("stored", paths.escaped(F.col("name").cast("binary")))
    return rows.select("doc_id", "stored", F.sha2(paths.unescaped(F.col("stored")), 256).alias("back"))


_CHANGES = {"size": ({"chunk_size": 1 << 21}, True), "odd size": ({"chunk_size": 1000}, False), "order": ({"chunk_min_size": 1 << 24}, False), "version": ({"version": 1}, False), "level": ({"compression": 23}, False), "levels": ({"compression": -7}, True), "fixed": ({"chunker": "fixed", "chunk_size": 1000}, True)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {v[1]})" for n, v in _CHANGES.items()) + ", ('append-only', false)) t(change, allowed)")
def config_changes(spark: SparkSession, sf: str) -> DataFrame:
    def allowed(options: dict) -> bool:
        try:
            Config().apply(**options)
        except ValueError:
            return False
        return True

    rows = t.snaps(spark, sf)
    try:
        snapshots.without(rows, rows.select("id"), Config().apply(append_only=True))
        guarded = True
    except PermissionError:
        guarded = False
    return spark.createDataFrame([*((n, allowed(o)) for n, (o, _) in _CHANGES.items()), ("append-only", guarded)], "change string, allowed boolean")


# --- trees, parents, restore -----------------------------------------------------------------------------------------------------

_REUSE = """olds AS (SELECT o_orderkey AS k, sha256(o_orderstatus || o_orderpriority) AS b FROM orders WHERE o_orderkey % 5 <> 0), live AS (SELECT DISTINCT sha256(o_orderstatus || o_orderpriority) AS b FROM orders WHERE o_orderstatus <> 'F')"""


@query("SELECT 'o' || o_orderkey AS path, CASE WHEN k IS NULL OR b NOT IN (FROM live) THEN 'new' WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE 'unmodified' END AS status FROM orders LEFT JOIN olds ON k = o_orderkey WHERE o_orderkey % 4 <> 0 OR k IS NULL OR b IN (FROM live)", _REUSE)
def parent_content_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """A file counts as unmodified only if all its content is still known. Changed files without known content aren't compared."""
    o = t.read(spark, sf, "orders")
    blob = F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256)
    size = F.floor("o_totalprice").cast("bigint")
    base = [F.concat(F.lit("o"), F.col("o_orderkey")).alias("path"), F.lit("file").alias("type"), F.col("o_orderdate").alias("mtime")]
    new = o.select(*base, size.alias("size"))
    old = o.where("o_orderkey % 5 <> 0").select(*base, (size + (F.col("o_orderkey") % 4 == 0).cast("int")).alias("size"), F.lit(0).alias("parent_pos"), F.array(blob).alias("content"))
    live = o.where("o_orderstatus <> 'F'").select(blob.alias("blob_id")).distinct()
    gone = o.where("o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("path"), blob.alias("blob_id")).join(live, "blob_id", "left_anti").select("path")
    return trees.compared(new, old, contents=live).select("path", "status").join(gone, "path", "left_anti")


@query("SELECT 'o' || o_orderkey AS path, CASE WHEN bool_and(coalesce(o_custkey % 3 <> 0, false)) THEN 'verified' ELSE 'modify' END AS action FROM (SELECT o_orderkey, o_custkey, unnest([0, 1]) AS pos FROM orders) GROUP BY o_orderkey")
def restore_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one size whose blobs are compared in place: in every third the second blob is another."""
    o = t.read(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("path"), "o_custkey")
    wanted = o.select("path", "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("blob_id", F.concat_ws("-", "path", "pos"))
    found = wanted.withColumn("blob_id", F.when((F.col("pos") == 1) & (F.col("o_custkey") % 3 == 0), "other").otherwise(F.col("blob_id")))
    return restore.verified(wanted.select("path", "pos", "blob_id"), found.select("path", "pos", "blob_id"))


@query("SELECT type, action, count(*) AS count FROM (SELECT path, 'file' AS type, CASE WHEN s % 3 = 0 THEN 'restore' WHEN s % 3 = 1 THEN 'verify' ELSE 'unchanged' END AS action FROM (SELECT 'f' || o_orderkey AS path, o_orderkey AS s FROM orders)) GROUP BY ALL")
def restore_statistics(spark: SparkSession, sf: str) -> DataFrame:
    o = t.read(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("path"), F.lit("file").alias("type"), F.lit(5).cast("bigint").alias("size"), F.col("o_orderdate").alias("mtime"), (F.col("o_orderkey") % 3).alias("k"))
    there = o.where("k <> 0").withColumn("mtime", F.when(F.col("k") == 1, F.lit(None)).otherwise(F.col("mtime")))
    return restore.statistics(restore.planned(o, there))


@query("SELECT CAST(dense_rank() OVER (ORDER BY path) - 1 AS BIGINT) AS path_no, CAST(dense_rank() OVER (ORDER BY type, size NULLS FIRST) - 1 AS BIGINT) AS node_no, root, path FROM paths WHERE type = 'file'", t.NODES)
def tree_found_encoded(spark: SparkSession, sf: str) -> DataFrame:
    found = trees.matching(trees.closure(t.roots(spark), t.nodes(spark, sf)), F.col("type") == "file")
    return trees.encoded(found, ["type", "size"]).select("path_no", "node_no", "root", "path")


_EVENTS = """dirs AS (SELECT DISTINCT array_to_string(string_split(path, '/')[:i], '/') AS path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM page_paths)),
  marks AS (SELECT string_split(path, '/') AS spot, 'Other' AS event, path FROM page_paths UNION ALL SELECT string_split(path, '/'), 'NewTree', path FROM dirs WHERE path NOT IN (FROM page_paths) UNION ALL SELECT list_append(string_split(path, '/'), chr(1114111)), 'EndTree', path FROM dirs WHERE path NOT IN (FROM page_paths))"""


@query("SELECT row_number() OVER (ORDER BY spot) - 1 AS pos, event, path FROM marks", t.PAGE_PATHS, _EVENTS)
def tree_events_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return trees.events(t.page_paths(spark, sf).withColumn("type", F.lit("file"))).select("pos", "event", "path")


@query("SELECT p.path, CASE WHEN s.id IS NOT NULL THEN 'tree' WHEN h.hostname IS NOT NULL OR p.path = '' THEN 'dir' END AS kind, s.tree, CASE WHEN s.id IS NOT NULL THEN rest END AS rest FROM (SELECT DISTINCT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS at, array_to_string(string_split(path, '/')[3:], '/') AS rest FROM (SELECT hostname || '/' || id || '/x/' || label AS path FROM snaps UNION ALL SELECT hostname || '/' || id FROM snaps UNION ALL SELECT hostname FROM snaps UNION ALL SELECT hostname || '/none/x' FROM snaps UNION ALL SELECT '')) p LEFT JOIN snaps s ON s.hostname || '/' || s.id = p.at LEFT JOIN (SELECT DISTINCT hostname FROM snaps) h ON h.hostname = p.path", t.SNAPS)
def vfs_resolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.snaps(spark, sf)
    every = vfs.entries(rows, F.concat_ws("/", "hostname", "id"))
    host, i = F.col("hostname"), F.col("id")
    asked = rows.select(F.explode(F.array(F.concat_ws("/", host, i, F.lit("x"), "label"), F.concat_ws("/", host, i), host, F.concat_ws("/", host, F.lit("none/x")), F.lit(""))).alias("path"))
    return vfs.resolved(every, asked).select("path", "kind", "tree", "rest")


@query("SELECT id AS name, 'dir' AS type FROM snaps WHERE hostname = '1' UNION ALL SELECT 'latest', 'symlink'", t.SNAPS)
def vfs_listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.snaps(spark, sf)
    return vfs.dir_entries(vfs.entries(rows, F.concat_ws("/", "hostname", "id"), "link"), t.nodes(spark, sf), "/1")


_REGION = "(SELECT 'R' || min(r_regionkey) FROM region)"


@query(f"SELECT name, type FROM nodes WHERE tree_id = {_REGION}", t.NODES)
def vfs_stored_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder within a snapshot's tree."""
    one = spark.createDataFrame([("s", datetime(2020, 1, 1), "root")], "id string, time timestamp_ntz, tree string")
    first = t.read(spark, sf, "region").agg(F.min_by("r_name", "r_regionkey")).first()[0]
    return vfs.dir_entries(vfs.entries(one, F.col("id")), t.nodes(spark, sf), f"s/{first}")


# --- findings and repairs --------------------------------------------------------------------------------------------------------


@query("SELECT level, kind, count(*) AS count FROM (SELECT 'warning' AS level, 'PackNotReferenced' AS kind FROM files WHERE id NOT IN (SELECT pack_id FROM firsts) UNION ALL SELECT 'error', CASE WHEN f.id IS NULL THEN 'NoPack' ELSE 'PackSizeMismatchIndex' END FROM firsts p LEFT JOIN files f ON p.pack_id = f.id WHERE f.id IS NULL OR f.size <> p.pack_size) GROUP BY ALL", t.BLOBS, t.PACKS, t.FIRST, t.FILES)
def check_summary(spark: SparkSession, sf: str) -> DataFrame:
    return check.summary(check.listing(index.packs(t.blobs(spark, sf)), t.pack_files(spark, sf)))


@query("SELECT NOT EXISTS (SELECT 1 FROM firsts p LEFT JOIN files f ON p.pack_id = f.id WHERE f.id IS NULL OR f.size <> p.pack_size) AS is_ok", t.BLOBS, t.PACKS, t.FIRST, t.FILES)
def check_is_ok(spark: SparkSession, sf: str) -> DataFrame:
    return check.is_ok(check.listing(index.packs(t.blobs(spark, sf)), t.pack_files(spark, sf)))


@query("SELECT sha256(CAST(doc_id AS VARCHAR)) AS pack_id, sha256(coalesce(text, '')) AS expected, sha256(coalesce(text, '') || '!') AS actual FROM documents WHERE doc_id % 3 = 0")
def check_cache(spark: SparkSession, sf: str) -> DataFrame:
    d = t.read(spark, sf, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("id"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    cache = d.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return check.cached(cache, d).select("pack_id", "expected", "actual")


@query("SELECT 'N' || n_nationkey AS tree_id, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 AND r_regionkey <> 4 UNION ALL SELECT 'R4', r_name FROM region WHERE r_regionkey = 4")
def check_unread_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Trees of every other nation, and of the last region, can't be read."""
    nodes = t.nodes(spark, sf).where("NOT (tree_id LIKE 'N%' AND CAST(substring(tree_id, 2) AS INT) % 2 = 0) AND tree_id <> 'R4'")
    known = t.nodes(spark, sf).select(F.col("tree_id").alias("blob_id")).unionByName(t.nodes(spark, sf).where("subtree LIKE 'C%'").select(F.col("subtree").alias("blob_id")))
    live = known.where("NOT (blob_id LIKE 'N%' AND CAST(substring(blob_id, 2) AS INT) % 2 = 0) AND blob_id <> 'R4'").distinct().withColumns({"blob_type": F.lit("tree"), "to_delete": F.lit(False)})
    return check.unread_trees(t.roots(spark).where("root = 'all'"), nodes, live).select(F.col("blob_id").alias("tree_id"), "path")


def _packs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """documents as packs of one blob each (id, content, doc_id), and the index of them.

    Some are damaged, by doc_id modulo 8: 1 a wrong length of the header, 2 a byte of the blob changed, 3 the index has another id, 4 a byte too many, 5 the name isn't
    the hash, 6 the header has another id."""
    ship(spark)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                blob, k = f"{doc}:{text or ''}".encode(), doc % 8
                own = hashlib.sha256(blob).hexdigest()
                pack = packfile.built([("data", blob)])
                if k == 1:
                    pack = pack[:-4] + struct.pack("<I", 70)
                elif k == 2:
                    pack = pack[:16] + b"~" + pack[17:]
                elif k == 4:
                    pack += b"!"
                elif k == 6:
                    pack = pack[: -4 - 16 - 32] + bytes(32) + pack[-4 - 16 :]
                name = hashlib.sha256(b"name" + pack if k == 5 else pack).hexdigest()
                out.append((name, pack, doc, "0" * 63 + "1" if k == 3 else own, len(blob) + 32))
            yield pd.DataFrame(out, columns=["id", "content", "doc_id", "blob_id", "length"])

    rows = t.read(spark, sf, "documents").select("doc_id", "text").mapInPandas(run, "id string, content binary, doc_id long, blob_id string, length long")
    none = F.lit(None)
    listed = rows.select(
        F.lit("i").alias("index_id"), F.col("id").alias("pack_id"), F.lit(False).alias("to_delete"), none.cast("timestamp_ntz").alias("pack_time"), F.lit(0).alias("blob_pos"), "blob_id", F.lit("data").alias("blob_type"),
        F.lit(0).cast("bigint").alias("offset"), "length", none.cast("bigint").alias("uncompressed_length"),
    )
    return rows, listed


_KINDS = "CASE doc_id % 8 WHEN 1 THEN 'PackHeaderLengthMismatch' WHEN 2 THEN 'PackBlobHashMismatch' WHEN 3 THEN 'PackHeaderMismatchIndex' WHEN 4 THEN 'PackSizeMismatch' WHEN 5 THEN 'PackHashMismatch' WHEN 6 THEN 'PackHeaderMismatchIndex' END"


@query(f"SELECT doc_id, {_KINDS} AS kind, CASE WHEN doc_id % 8 = 2 THEN sha256(doc_id || ':' || coalesce(text, '')) END AS blob_id FROM documents WHERE doc_id % 8 NOT IN (0, 7)")
def check_pack_bytes(spark: SparkSession, sf: str) -> DataFrame:
    files, listed = _packs(spark, sf)
    return check.verified_packs(files, listed).join(files.select(F.col("id").alias("pack_id"), "doc_id"), "pack_id").select("doc_id", "kind", "blob_id")


@query("SELECT doc_id, CASE WHEN doc_id % 8 IN (4, 7) THEN 'rebuilt' ELSE 'i' END AS index_id, CASE WHEN doc_id % 8 = 3 THEN repeat('0', 63) || '1' ELSE sha256(doc_id || ':' || coalesce(text, '')) END AS blob_id, strlen(doc_id || ':' || coalesce(text, '')) + 32 AS length FROM documents WHERE doc_id % 8 NOT IN (4, 0)")
def repair_index_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The index after a repair. Packs of another size than listed are read again, which fails for those with a byte too many; so are those not in the index (7); others have no file (0)."""
    files, listed = _packs(spark, sf)
    known = listed.join(files.where("doc_id % 8 = 7").select(F.col("id").alias("pack_id")), "pack_id", "left_anti")
    there = files.where("doc_id % 8 <> 0")
    out = check.index_rebuilt(known, there.select("id", F.length("content").cast("long").alias("size")), lambda ids: there.join(ids, "id", "left_semi"))
    return out.join(files.select(F.col("id").alias("pack_id"), "doc_id"), "pack_id").select("doc_id", "index_id", "blob_id", "length")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 7 = 0")
def repository_cat_blob(spark: SparkSession, sf: str) -> DataFrame:
    """Contents by id, of many blobs at once as of one."""
    d = t.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("chunk"))
    blobs = d.withColumn("blob_id", F.sha2("chunk", 256))
    wanted = blobs.where("doc_id % 7 = 0").select("doc_id", F.array("blob_id").alias("content"), F.col("doc_id").cast("string").alias("path"))
    return chunks.dumped(wanted, blobs.select("blob_id", "chunk")).select(F.col("path").cast("bigint").alias("doc_id"), F.sha2("content", 256).alias("digest"))


@query("SELECT id, original FROM (SELECT id, id AS original FROM snaps WHERE label = 'click')", t.SNAPS)
def repository_snapshots_and_trees(spark: SparkSession, sf: str) -> DataFrame:
    """All snapshots point at trees of their own here; those of one label have a file that is left out."""
    rows = t.snaps(spark, sf).select("id", "time", "hostname", "label", "tags", "paths", F.concat(F.lit("t"), "label").alias("tree"), "delete_kind", "delete_after")
    labels = rows.select("label").distinct()
    name = F.when(F.col("label") == "click", F.lit("x.tmp")).otherwise(F.lit("x"))
    nodes = labels.select(F.concat(F.lit("t"), "label").alias("tree_id"), F.lit(0).alias("pos"), name.alias("name"), F.lit("file").alias("type"), F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("string").alias("subtree"), F.array(F.lit("b")).alias("content"))
    repo = Repository(spark, rows, nodes, t.blobs(spark, sf), t.pack_files(spark, sf))
    return repo.rewrite_snapshots_and_trees(["!*.tmp"])[0].select("id", "original")
