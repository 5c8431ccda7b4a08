"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Toxic documents go; of each group of near-duplicates (five-word shingles, similarity of
0.8 or more) one document stays; passages that repeat are taken out; sources are mixed to
their target weights, a document coming out as often as the mix takes it; and what is
left is packed into length buckets and token-budget batches. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from tracelore.llm.textkit import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, trained on those with ``labels``, does not reject."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the least doc_id."""
    return ngram_join.one_per_group(docs, words=5, num=80, den=100)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of over 50 words, or of 400 bytes, that stand anywhere else as well."""
    return suffix_dedup.remove_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.take(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot, padding) of every row."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("suffix_dedup", drop_repeats), ("mixing", mix_sources), ("packing", pack_batches)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``; each result is stored in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
#: No SQL says what the models and the suffix arrays do; the stages are tested against brute force.
ORACLE_SQL = None
