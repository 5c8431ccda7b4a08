"""Queries that train; results depend on iterative fits, so there is no SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.operators import evaluation as E
from tracelore.operators import lexical as L
from tracelore.operators import modelling as M
from tracelore.operators import shapelets as S
from tracelore.plans.evaluation_queries import rounded
from tracelore.plans.fixtures import sequences
from tracelore.plans.registry import query, table
from tracelore.plans.storage import stored

COLUMNS = ["n_chars", "n_tokens", "question_mark_rate", "negation_density", "repetition_rate_4gram", "toxic"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with surface features and canonical folds."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "item_id")
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("y"), "toxic")
    rows = d.select("item_id", F.col("lang").alias("grp"), "n_chars").join(y, "item_id").join(L.cue_densities(d), "item_id")
    return stored(E.stratified_folds(rows, ["grp", "y"], "item_id"), "labelled")


@query()
def stacked_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.out_of_fold(labelled(spark, sf_dir), COLUMNS, "lr")


@query()
def stacked_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fold_metrics(M.out_of_fold(labelled(spark, sf_dir), COLUMNS, "rf")))


@query()
def calibrated_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nested_isotonic(labelled(spark, sf_dir), COLUMNS)


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ablation(labelled(spark, sf_dir), {"all": COLUMNS, "length": COLUMNS[:2], "no_repetition": [c for c in COLUMNS if not c.startswith("rep")]}))


@query()
def transfer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language that the table holds against every other one."""
    rows = labelled(spark, sf_dir)
    return rounded(M.transfer(rows, COLUMNS, sorted(r["grp"] for r in rows.select("grp").distinct().collect())))


@query()
def tfidf_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("grp"), "text")
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("y"))
    folds = E.stratified_folds(d.select("item_id", "grp").join(y, "item_id"), ["grp", "y"], "item_id")
    return M.tfidf_out_of_fold(stored(folds.join(d.select("item_id", "text"), "item_id"), "labelled-texts"), stored)


@query()
def shapelet_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions from distances to the 40 best of all shapelets, chosen on the training folds alone."""
    s = stored(E.stratified_folds(sequences(spark, sf_dir), ["y"], "item_id"), "sequences")
    parts = []
    for k in range(5):
        train = s.where(F.col("fold") != k)
        best = S.ranked(S.information_gain(S.distance_counts(train, S.candidates(train))))
        names = [(r["k"], r["gram"]) for r in best.orderBy("rank").collect()]
        pool = spark.createDataFrame(names, "k int, gram string")
        wide = S.distances(s, pool).groupBy("item_id").pivot("gram", [g for _, g in names]).agg(F.first("dist"))
        rows = stored(s.select("item_id", "grp", "y", "fold").join(wide, "item_id"), "shapelet-distances")
        cols = [g for _, g in names]
        parts.append(M.probabilities(M.fitted(rows.where(F.col("fold") != k), cols), rows.where(F.col("fold") == k), cols, ["item_id", "grp", "y", "fold"]))
    return reduce(DataFrame.unionByName, parts)


@query()
def question_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out chances of a long answer, told from the question's words alone: hashed, as no encoder is installed."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.col("text").alias("problem"))
    answered = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("item_id"), (F.char_length("text") > 200).cast("int").alias("y"))
    rows = asked.join(answered, "item_id").withColumn("grp", F.lit("all"))
    rows = stored(E.stratified_folds(M.question_vectors(rows, "problem"), ["y"], "item_id"), "questions")
    return M.out_of_fold(rows, M.QUESTION_COLUMNS)


@query()
def column_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, importance, rank) of a forest on all labelled rows."""
    found = M.importance(M.fitted(labelled(spark, sf_dir), COLUMNS, "rf"), COLUMNS)
    return rounded(spark.createDataFrame([(c, v, k + 1) for k, (c, v) in enumerate(found)], "column string, importance double, rank long"))


@query()
def searched_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials of a seeded random search, best first."""
    found = M.search(labelled(spark, sf_dir), COLUMNS, trials=4)
    return rounded(spark.createDataFrame([(k + 1, t["kind"], t.get("scaler"), t.get("c"), t.get("trees"), t["value"]) for k, t in enumerate(found)], "rank long, kind string, scaler string, c double, trees long, value double"))


@query()
def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of the baselines that need no language model: length, lexical cues, hedges, and all surface features."""
    rows = labelled(spark, sf_dir)
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "item_id")
    rows = stored(rows.join(L.hedge_verify(d).select("item_id", "hedge_count", "verify_count", "hvr", "zero_hedge"), "item_id"), "labelled-cues")
    cues = ["wait_density", "maybe_density", "verify_density", "actually_density", "negation_density", "question_mark_rate", "repetition_rate_4gram"]
    return rounded(M.ablation(rows, {"all": COLUMNS, "length": ["n_tokens", "n_chars"], "lexical": cues, "hedges": ["hedge_count", "verify_count", "hvr", "zero_hedge"]}))
