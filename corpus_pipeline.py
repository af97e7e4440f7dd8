"""The corpus pipeline: five stages over documents, each one of the operators of palimpsest.llm.

toxicity -> near duplicates -> repeated passages -> mixture of sources -> byte-level BPE. Each stage but the last returns the columns
of documents, of what it keeps; the last one a row for each document of the mixture, with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import bpe, jaccard, mixing, repeats, toxicity
from palimpsest.llm.common import count_words, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the corpus's labels, calls toxic go."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, with all its rows if it has several; rows without an id stay."""
    gone = jaccard.near_groups(docs).where("component_id < doc_id").select(F.col("doc_id").alias("of"), "text_hash").distinct()
    same = (F.col("doc_id") == F.col("of")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a text that loses none stays as it is."""
    found = repeats.without_repeats(docs.select("doc_id", F.col("text"), F.col("text").alias("was"), "lang", "source", "n_chars"), carry=("was", "lang", "source", "n_chars"))
    whole = F.col("n_removed") == 0
    return found.select("doc_id", F.when(whole, F.col("was")).otherwise(F.col("kept")).alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it. Rows with one id, source and size, whose copies can't be told apart, get theirs in the order of a hash."""
    key = ["doc_id", "source", "size"]
    nth = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(by))
    taken = mixing.sampled(docs).select(*key, "copies").withColumn("nth", nth(F.desc("copies"))).where("copies > 0")
    taken = taken.select(*(F.col(c).alias(f"_{c}") for c in [*key, "nth"]), "copies")
    rows = docs.withColumn("size", count_words(F.col("text"))).withColumn("nth", nth(F.xxhash64("text")))
    same = F.lit(True)
    for c in [*key, "nth"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes, a row for each copy in the mixture."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixture", mix),
    ("bpe", tokenize),
]

#: The classifier, the tokenizer and exact repeats of passages over whole texts are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
