"""Quality rules judged by host: failures are summed by domain, rates shrunk with a beta prior fitted to all
domains, and the verdict on a domain joined back to its documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SEPARATORS, WORD, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Of a document's word hashes: how many words lie in windows that occur twice or more, the first included.

    Windows are held as 64-bit hashes. Most documents repeat none, which a hash set shows; only for the others are
    windows sorted with their places, and the covered words counted from the gaps between marked places.
    """
    n = F.size(hashes)
    return (
        F.when(n < window, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window))))
    )


def _covered(spots: Column, window: int) -> Column:
    """Words covered by windows that start at these sorted places."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(spots) - 1), lambda j: F.least(F.lit(window), F.get(spots, j) - F.get(spots, j - 1)).cast("long"))
    sums = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(spots) == 0, F.lit(0)).when(F.size(spots) == 1, F.lit(window)).otherwise(sums + window).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host (source), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row.

    A null or empty text has no words and fails. Texts are read whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        "host",
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("lines"),
    )
    rows = rows.select("*", F.size("hashes").cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("hashes")).alias("windows")).drop("lines", "hashes")
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("sorted")

    def marked(x: Column, k: Column) -> Column:
        same = lambda y: F.coalesce(y["h"] == x["h"], F.lit(False))
        return same(F.get(s, k - 1)) | same(F.get(s, k + 1))

    rows = rows.withColumn("spots", F.sort_array(F.transform(F.filter("sorted", marked), lambda x: x["i"])))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("spots").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("spots"), WINDOW)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def judge_hosts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, host_docs, host_failed, host_ok for each host, null being one.

    A document counts as a failure of its host if it failed a base rule, if symbols are over a tenth of its word
    characters, or if repeated lines number over a sixteenth of its words. The prior beta(a, b) has the mean and
    the variance of the hosts' rates (method of moments); a host is rejected if (a + failures) / (a + b + documents)
    exceeds max_rate. Few documents thus weigh little against what is usual among hosts.
    """
    bad = F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars")) | (2 * WINDOW * F.col("n_dup_lines") > F.col("n_words"))
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if(bad).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    # Weight of the prior in documents: from 1 (rates differ as much as they can) to 10,000 (all alike).
    weight = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(F.lit(10000.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(10000.0))
    prior = prior.select("m", weight.alias("w"))
    shrunk = (F.col("m") * F.col("w") + F.col("host_failed")) / (F.col("w") + F.col("host_docs"))
    # One row, so this is no cross join in the sense of growing with the data.
    return hosts.join(F.broadcast(prior)).select("host", "host_docs", "host_failed", (shrunk <= max_rate).alias("host_ok"))


def host_rules(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """What measure() finds for each row of docs (doc_id, text, source), with host_docs, host_failed and kept.

    kept: the row passed the base rules and its host is not rejected. Repeated rows each get a row; no rows: no
    rows; other columns are not read. Host counts are summed before the shuffle, and the join back is on a table
    of hosts, whose large side Spark may split, so a host that holds a third of all rows is no burden to one task.
    """
    measured = written(measure(docs), "quality")
    hosts = judge_hosts(measured, max_rate).withColumnRenamed("host", "of")
    out = measured.join(hosts, F.col("host").eqNullSafe(F.col("of")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host_docs", "host_failed")
