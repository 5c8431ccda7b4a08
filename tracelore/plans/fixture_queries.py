"""Queries over inputs whose results are known: what the functions of texts make of them, beside the values themselves as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.functions import answers as A
from tracelore.functions.segmenting import sentences
from tracelore.operators import confidence as C
from tracelore.operators import parsing as P
from tracelore.plans import expected as X
from tracelore.plans.registry import query


def _sql(rows: list[tuple], names: str, kinds: str) -> str:
    """The rows as SQL, each column cast to its type."""

    def said(v) -> str:
        # line feeds and backslashes stand for themselves in these strings
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    columns = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names.split(), kinds.split(), strict=True))
    return f"SELECT {columns} FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({', '.join(names.split())})"


def _rows(spark: SparkSession, rows: list[tuple], names: str = "text") -> DataFrame:
    n = len(names.split())
    return spark.createDataFrame([tuple(r[:n]) for r in rows], ", ".join(f"{x} string" for x in names.split()))


_CASES = {"sentence_classes_seven": X.SEVEN, "sentence_classes_six": X.SIX}


def _classes(name: str) -> list[tuple]:
    return [(s, b) for b, ss in _CASES[name].items() for s in ss]


@query(_sql(_classes("sentence_classes_seven"), "text behavior", "VARCHAR VARCHAR"))
def sentence_classes_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _classes("sentence_classes_seven")).select("text", P.classify(F.col("text"), "seven").getField("behavior").alias("behavior"))


@query(_sql(_classes("sentence_classes_six"), "text behavior", "VARCHAR VARCHAR"))
def sentence_classes_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _classes("sentence_classes_six")).select("text", P.classify(F.col("text"), "six").getField("behavior").alias("behavior"))


_WITHIN = [(t, True) for t, _, _ in X.SEGMENTS]


@query(_sql(_WITHIN, "text within", "VARCHAR BOOLEAN"))
def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text has as many sentences as it may have."""
    rows = spark.createDataFrame(X.SEGMENTS, "text string, low int, high int")
    return rows.select("text", F.size(sentences()(F.col("text"))).between(F.col("low"), F.col("high")).alias("within"))


def _each(spark: SparkSession, cases: list[tuple], value: Column, name: str) -> DataFrame:
    return _rows(spark, cases).select("text", value.alias(name))


@query(_sql(X.BOXED, "text boxed", "VARCHAR VARCHAR"))
def boxed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.BOXED, A.each(A.boxed)(F.col("text")), "boxed")


@query(_sql(X.NORMALIZED, "text normalized", "VARCHAR VARCHAR"))
def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.NORMALIZED, A.each(A.normalized)(F.col("text")), "normalized")


@query(_sql(X.NUMERIC, "text number", "VARCHAR DOUBLE"))
def numeric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.NUMERIC, A.each(A.numeric, "double")(F.col("text")), "number")


@query(_sql(X.EQUIVALENT, "a b same", "VARCHAR VARCHAR BOOLEAN"))
def equivalent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, X.EQUIVALENT, "a b").select("a", "b", A.each(A.equivalent, "boolean")(F.col("a"), F.col("b")).alias("same"))


@query(_sql(X.STATED, "text answer", "VARCHAR VARCHAR"))
def stated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.STATED, A.each(A.stated_answer)(F.col("text")), "answer")


@query(_sql(X.MARKED, "text answer", "VARCHAR VARCHAR"))
def marked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.MARKED, A.native_after_marks(F.col("text")), "answer")


@query(_sql(X.CHOSEN, "text letter", "VARCHAR VARCHAR"))
def chosen_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.CHOSEN, A.native_choice(F.col("text")), "letter")


@query(_sql(X.SCORED, "answer truth kind extraction is_correct", "VARCHAR VARCHAR VARCHAR VARCHAR BOOLEAN"))
def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, X.SCORED, "answer truth kind extraction")
    return rows.select("*", A.score_answer(*(F.col(c) for c in rows.columns)).getField("is_correct").alias("is_correct"))


@query(_sql(X.CONFIDENCES, "text confidence", "VARCHAR DOUBLE"))
def stated_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.CONFIDENCES, C.stated_confidence(F.col("text")), "confidence")


@query(_sql(X.JUDGED, "text probability", "VARCHAR DOUBLE"))
def judged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.JUDGED, C.judge_probability(F.col("text")), "probability")


@query(_sql(X.BYTES, "text plain", "VARCHAR VARCHAR"))
def byte_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, X.BYTES, A.byte_text(F.col("text")), "plain")
