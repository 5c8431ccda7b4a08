"""The queries of this subpackage, whole tables and production parameters, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelore.llm import hmm_lm, line_rules, mixing, ngram_join, packing, quality_crf, suffix_dedup, token_counts, toxicity, vector_graph
from tracelore.llm.textkit import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rule_report(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.lm_report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"), words=suffix_dedup.WORDS)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_packing, op3_toxicity, op4_ngram_jaccard_join, op5_quality_rules, op6_mixing, op7_lm_scoring, op8_suffix_dedup, op9_embedding_near_dedup, op10_token_counts)}
ORACLE_SQL = {"op5_quality_rules": line_rules.RULES_SQL, "op6_mixing": mixing.MIX_SQL}
