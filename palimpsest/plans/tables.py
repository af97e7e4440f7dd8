"""The store's tables made from the driver's, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(c: str):
    return F.col(c).cast("string")


def snaps(spark: SparkSession, sf: str) -> DataFrame:
    """events as snapshots."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    kind = F.when(F.col("event_id") % 11 == 0, "Never").when(F.col("event_id") % 7 == 0, "After").otherwise("NotSet")
    return read(spark, sf, "events").select(
        F.sha2(text("event_id"), 256).alias("id"), F.col("ts").alias("time"), text("user_id").alias("hostname"), F.col("event_type").alias("label"),
        F.array(F.col("event_type"), F.when(F.col("value") < 10, "small").otherwise("large")).alias("tags"), F.array(F.concat(F.lit("/home/"), text("user_id"))).alias("paths"),
        F.sha2(F.floor("value").cast("bigint").cast("string"), 256).alias("tree"), kind.alias("delete_kind"), F.when(kind == "After", day).alias("delete_after"),
    )


SNAPS = """snaps AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS id, ts AS time, CAST(user_id AS VARCHAR) AS hostname, event_type AS label,
  [event_type, CASE WHEN value < 10 THEN 'small' ELSE 'large' END] AS tags, ['/home/' || user_id] AS paths, sha256(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS tree,
  CASE WHEN event_id % 11 = 0 THEN 'Never' WHEN event_id % 7 = 0 THEN 'After' ELSE 'NotSet' END AS delete_kind,
  CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN date_trunc('day', ts) END AS delete_after FROM events)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """orders as snapshots over years, many with equal times."""
    return read(spark, sf, "orders").select(F.sha2(text("o_orderkey"), 256).alias("id"), F.col("o_orderdate").alias("time"), text("o_custkey").alias("hostname"), F.col("o_orderpriority").alias("label"), F.array("o_orderstatus").alias("tags"))


HISTORY = "history AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS id, o_orderdate AS time, CAST(o_custkey AS VARCHAR) AS hostname, o_orderpriority AS label, [o_orderstatus] AS tags FROM orders)"


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as an index of blobs in packs."""
    entry = ("index_id", "pack_id", "to_delete")
    rows = read(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 20).cast("string").alias("index_id"), text("l_orderkey").alias("pack_id"), (F.col("l_returnflag") == "R").alias("to_delete"), "l_linenumber", "l_extendedprice", "l_tax", "l_shipdate",
        text("l_partkey").alias("blob_id"), F.when(F.col("l_linestatus") == "O", "tree").otherwise("data").alias("blob_type"), ((F.col("l_linenumber") - 1) * 25).cast("bigint").alias("offset"),
        F.col("l_quantity").cast("bigint").alias("length"), F.when(F.col("l_discount") > 0.05, (F.col("l_quantity") * 3).cast("bigint")).alias("uncompressed_length"),
    )
    rows = rows.repartition("pack_id")  # all entries of a pack together, so that windows over entries and over packs share one shuffle and one sort
    w = Window.partitionBy("pack_id", "to_delete", "index_id")
    place = F.row_number().over(w.orderBy("l_linenumber", "blob_id", "length", "l_extendedprice")) - 1
    time = F.when(F.max("l_tax").over(w) >= 0.02, F.min("l_shipdate").over(w))
    return rows.select(*entry, time.alias("pack_time"), place.alias("blob_pos"), "blob_id", "blob_type", "offset", "length", "uncompressed_length")


BLOBS = """blobs AS (SELECT index_id, pack_id, to_delete, CASE WHEN max(l_tax) OVER e >= 0.02 THEN min(l_shipdate) OVER e END AS pack_time,
  CAST(row_number() OVER (e ORDER BY l_linenumber, blob_id, length, l_extendedprice) - 1 AS INTEGER) AS blob_pos, blob_id, blob_type, "offset", length, uncompressed_length FROM (
    SELECT CAST(l_orderkey % 20 AS VARCHAR) AS index_id, CAST(l_orderkey AS VARCHAR) AS pack_id, l_returnflag = 'R' AS to_delete, l_linenumber, l_extendedprice, l_tax, l_shipdate,
      CAST(l_partkey AS VARCHAR) AS blob_id, CASE WHEN l_linestatus = 'O' THEN 'tree' ELSE 'data' END AS blob_type, CAST((l_linenumber - 1) * 25 AS BIGINT) AS "offset",
      CAST(l_quantity AS BIGINT) AS length, CASE WHEN l_discount > 0.05 THEN CAST(l_quantity * 3 AS BIGINT) END AS uncompressed_length FROM lineitem)
  WINDOW e AS (PARTITION BY index_id, pack_id, to_delete))"""
PACKS = """packs AS (SELECT index_id, pack_id, to_delete, arg_min(blob_type, blob_pos) AS blob_type, count(*) AS blobs,
  CAST(36 + sum(length + CASE WHEN uncompressed_length IS NULL THEN 37 ELSE 41 END) AS BIGINT) AS pack_size, min(pack_time) AS pack_time FROM blobs GROUP BY ALL)"""
FIRST = "firsts AS (SELECT * FROM packs QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY to_delete, index_id) = 1)"


def pack_files(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(text("o_orderkey").alias("id"), (F.floor("o_totalprice").cast("bigint") % 300).alias("size"))


#: floor and not a cast, which rounds here and cuts there.
FILES = "files AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(floor(o_totalprice) AS BIGINT) % 300 AS size FROM orders)"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """regions, nations, customers and orders as directories and files."""
    r, n, c, o = (read(spark, sf, t) for t in ("region", "nation", "customer", "orders"))
    none, zero = F.lit(None).cast("array<string>"), F.lit(None).cast("bigint")
    row = lambda tree, name, sub: [tree.alias("tree_id"), name.alias("name"), F.lit("dir").alias("type"), zero.alias("size"), sub.alias("subtree"), none.alias("content")]
    at = lambda k, col: F.concat(F.lit(k), F.col(col).cast("string"))
    files = o.select(at("C", "o_custkey").alias("tree_id"), at("o", "o_orderkey").alias("name"), F.lit("file").alias("type"), F.floor("o_totalprice").cast("bigint").alias("size"), F.lit(None).cast("string").alias("subtree"), F.array(F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256), F.sha2(text("o_orderdate"), 256)).alias("content"))
    return r.select(*row(F.lit("root"), F.col("r_name"), at("R", "r_regionkey"))).unionByName(n.select(*row(at("R", "n_regionkey"), F.col("n_name"), at("N", "n_nationkey")))).unionByName(c.select(*row(at("N", "c_nationkey"), F.col("c_name"), at("C", "c_custkey")))).unionByName(files)


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("all", "root"), ("first", "R0")], "root string, tree_id string")


NODES = """nodes AS (SELECT 'root' AS tree_id, r_name AS name, 'dir' AS type, NULL::BIGINT AS size, 'R' || r_regionkey AS subtree, NULL::VARCHAR[] AS content FROM region
  UNION ALL SELECT 'R' || n_regionkey, n_name, 'dir', NULL, 'N' || n_nationkey, NULL FROM nation UNION ALL SELECT 'N' || c_nationkey, c_name, 'dir', NULL, 'C' || c_custkey, NULL FROM customer
  UNION ALL SELECT 'C' || o_custkey, 'o' || o_orderkey, 'file', CAST(floor(o_totalprice) AS BIGINT), NULL, [sha256(o_orderstatus || o_orderpriority), sha256(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'))] FROM orders),
  roots AS (SELECT * FROM (VALUES ('all', 'root'), ('first', 'R0')) t(root, tree_id)),
  paths AS (SELECT r.root, n.*, n.name AS path, 1 AS depth FROM roots r JOIN nodes n USING (tree_id) UNION ALL
    SELECT p.root, n.*, p.path || '/' || n.name, p.depth + 1 FROM paths p JOIN nodes n ON n.tree_id = p.subtree)"""


def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/+$", "")
    return read(spark, sf, "pages").select(path.alias("path")).where("path <> ''").distinct()


PAGE_PATHS = "page_paths AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') <> '')"


def chunk_source(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(text("doc_id").alias("path"), F.col("text").alias("content"))


CHUNKS = """chunks AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i AS INTEGER) AS pos, i * 256 AS "offset", substr(text, CAST(i * 256 + 1 AS BIGINT), 256) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 255) // 256)) AS i FROM documents WHERE length(text) > 0))"""
