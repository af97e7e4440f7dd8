"""Queries over the driver's tables, one for each operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, host_quality, jaccard, mixing, repeats, sharding, token_files, topk, toxicity, url_lists
from palimpsest.llm.common import scratch_path, table

#: Id that ends each document in the token files.
END_ID = 2

#: The pages carry no fetch time: page n counts as fetched n * 37 hours, modulo two years, after this instant.
FETCHED_FROM, FETCH_STEP_H, FETCH_SPAN_H = "2023-06-01", 37, 17520


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch_path(spark, "ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, END_ID)
    return token_files.read_checksums(spark, out)


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.sampled(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_block_anchor_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"timestamp_ntz '{FETCHED_FROM}' + make_dt_interval(0, cast(pmod(page_id * {FETCH_STEP_H}, {FETCH_SPAN_H}) AS int), 0, 0)").alias("fetched"))
    entries = spark.sql(f"SELECT key, CAST(at AS timestamp_ntz) AS at, action FROM VALUES {', '.join(map(str, url_lists.ENTRIES))} AS t(key, at, action)")
    return url_lists.as_listed(pages, entries)


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op9_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.host_rules(table(spark, sf_dir, "documents"))


_WORD = r"[^\x20\x09-\x0D]+"

OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM totals
), leveled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, row_number() OVER o AS k,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_weight,
    CAST(2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filled
  FROM weighted WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), levels AS (
  SELECT *, (1.5::DOUBLE * all_size - filled) / left_weight AS level FROM leveled
), opened AS (
  SELECT min(k) AS k, min_by(level, k) AS level FROM levels WHERE 2 * source_size >= level * weight
), aims AS (
  SELECT l.source, l.source_size, CASE WHEN o.k IS NULL OR l.k < o.k THEN CAST(2 * l.source_size AS DOUBLE) ELSE least(CAST(2 * l.source_size AS DOUBLE), o.level * l.weight) END AS target
  FROM levels l CROSS JOIN opened o
), ranked AS (
  SELECT s.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS each_,
    CAST(('0x' || substr(md5('1:' || coalesce(s.source, chr(0))), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY s.source ORDER BY CASE WHEN size > 0 THEN floor(4 * log2(size)) ELSE -1 END, coalesce(doc_id, 0) % 64, size, doc_id) AS r
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), copied AS (
  SELECT *, CAST(floor(r * each_ + u) - floor((r - 1) * each_ + u) AS BIGINT) AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""

OP7_SQL = f"""
WITH entries(key, listed, action) AS (VALUES {", ".join(f"('{k}', TIMESTAMP '{t}', '{a}')" for k, t, a in url_lists.ENTRIES)}),
held AS (SELECT key, action, listed AS since, lead(listed) OVER (PARTITION BY key ORDER BY listed) AS until FROM entries),
captures AS (
  SELECT page_id, url, TIMESTAMP '{FETCHED_FROM}' + to_hours(CAST((page_id * {FETCH_STEP_H}) % {FETCH_SPAN_H} AS INTEGER)) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
    lower(regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]+)', 1)) AS section
  FROM pages
), hits AS (
  SELECT c.page_id, c.url, c.fetched, c.host, h.key, h.since, h.action,
    row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(split_part(h.key, '/', 1)) DESC, h.key DESC) AS n
  FROM captures c LEFT JOIN held h ON h.action <> 'lift' AND h.since <= c.fetched AND (h.until IS NULL OR c.fetched < h.until)
    AND (c.host = split_part(h.key, '/', 1) OR ends_with(c.host, '.' || split_part(h.key, '/', 1)))
    AND (NOT contains(h.key, '/') OR split_part(h.key, '/', 2) = c.section)
)
SELECT page_id, url, fetched, host, key AS list_key, since, coalesce(action = 'block', false) AS blocked FROM hits WHERE n = 1
"""

OP10_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), base AS (
  SELECT r, doc_id, source, words, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM docs
), spots AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM base WHERE len(words) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM spots) WHERE n > 1
), covered AS (
  SELECT r, CAST(sum(least(8, coalesce(next - i, 8))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r
), measured AS (
  SELECT b.doc_id, b.source, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*) AS host_docs, count(*) FILTER (WHERE base_failed OR 10 * n_symbols > word_chars OR 16 * n_dup_lines > n_words) AS host_failed FROM failed GROUP BY source
), moments AS (
  SELECT avg(host_failed / host_docs) AS m, var_pop(host_failed / host_docs) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(10000.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS w FROM moments
), judged AS (
  SELECT source, host_docs, host_failed, (m * w + host_failed) / (w + host_docs) <= 0.5 AS host_ok FROM hosts CROSS JOIN prior
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, host_docs, host_failed
FROM failed f JOIN judged j ON f.source IS NOT DISTINCT FROM j.source
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP3_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reached AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.doc_id
), components AS (
  SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN components c USING (doc_id)
"""

OP5_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT k, min(doc_id) AS first FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (k) WHERE first < doc_id
), each_word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM words w LEFT JOIN kept k USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE bits AS (
  SELECT b, b AS c, 0 AS n FROM (SELECT unnest(range(0, 256)) AS b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE n = 8
), rows_ AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, bytes + 1 AS size, CAST(xor(4294967295, list_reduce(list_transform(range(0, bytes), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]), 4294967295)) AS BIGINT) AS text_crc32 FROM rows_, crc
), jumps AS (
  SELECT doc_id AS k, CAST(CASE WHEN coalesce(doc_id, 0) < 0 THEN 18446744073709551616::UHUGEINT - CAST(-doc_id AS UHUGEINT) ELSE CAST(coalesce(doc_id, 0) AS UHUGEINT) END AS UHUGEINT) AS state, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL SELECT k, (state * 2862933555777941757 + 1) % 18446744073709551616, j,
    CAST(floor(least((2147483648.0::DOUBLE / CAST(((state * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1 AS DOUBLE)) * (j + 1), 4e9)) AS BIGINT)
  FROM jumps WHERE j < 17
), shards AS (
  SELECT k, max(j) FILTER (WHERE j < 16) AS shard, max(j) FILTER (WHERE j < 17) AS grown FROM jumps GROUP BY k
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY ((doc_id % 1024) * 31 + text_crc32) % 1024, doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM summed s JOIN shards x ON x.k IS NOT DISTINCT FROM s.doc_id
"""

QUERIES = {
    "op1_repair_token_files": op1_repair_token_files,
    "op2_subword_toxicity": op2_subword_toxicity,
    "op3_partenum_jaccard": op3_partenum_jaccard,
    "op4_mix_sources": op4_mix_sources,
    "op5_block_anchor_repeats": op5_block_anchor_repeats,
    "op6_segment_tree_bpe": op6_segment_tree_bpe,
    "op7_temporal_url_lists": op7_temporal_url_lists,
    "op8_jump_shards": op8_jump_shards,
    "op9_block_pruned_top_k": op9_block_pruned_top_k,
    "op10_host_rules": op10_host_rules,
}
SQL = {"op3_partenum_jaccard": OP3_SQL, "op5_block_anchor_repeats": OP5_SQL, "op8_jump_shards": OP8_SQL, "op4_mix_sources": OP4_SQL, "op7_temporal_url_lists": OP7_SQL, "op9_block_pruned_top_k": OP9_SQL, "op10_host_rules": OP10_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
