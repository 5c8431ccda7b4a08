"""Stacked classifiers with pyspark.ml: folds, out-of-fold predictions, ablation, transfer, calibration, search, text baselines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Imputer, NGram, Normalizer, RegexTokenizer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelore.operators import evaluation as E


def balanced(rows: DataFrame, label: str = "y") -> DataFrame:
    """``rows`` with weight: each class weighs the same in all."""
    n = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("_n"))
    # one row per class
    return rows.join(F.broadcast(n.crossJoin(total)), label).withColumn("weight", F.col("_n") / (2 * F.col("_c"))).drop("_c", "_n")


def classifier(kind: str, *, c: float = 1.0, total_weight: float = 1.0, trees: int = 100, layers: list[int] | None = None, seed: int = 42) -> Estimator:
    """lr (ridge with inverse strength c), rf, gbt or mlp."""
    if kind == "lr":
        return LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (c * total_weight), standardization=False, maxIter=200)
    if kind == "rf":
        return RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, minInstancesPerNode=5, seed=seed)
    if kind == "gbt":
        return GBTClassifier(labelCol="y", weightCol="weight", maxIter=trees, seed=seed)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(labelCol="y", layers=layers, seed=seed)
    raise ValueError(f"unknown classifier: {kind}")


def prepared(columns: list[str], scaler: str | None = "standard") -> list:
    """Stages that fill missing values with the training median, assemble and scale."""
    filled = [f"_f_{c}" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw" if scaler else "features")]
    if scaler == "standard":
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    elif scaler == "robust":
        stages.append(RobustScaler(inputCol="raw", outputCol="features", withCentering=True))
    return stages


def fitted(train: DataFrame, columns: list[str], kind: str = "lr", scaler: str | None = "standard", **options) -> Transformer:
    """A pipeline fitted on the rows; columns without any value count as 0."""
    empty = train.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    train = balanced(train.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if not empty[c] else F.col(c).cast("double") for c in columns}))
    if kind == "lr":
        options.setdefault("total_weight", float(train.agg(F.sum("weight")).first()[0] or 1.0))
    if kind == "mlp":
        options.setdefault("layers", [len(columns), 32, 2])
    return Pipeline(stages=[*prepared(columns, scaler), classifier(kind, **options)]).fit(train)


def probabilities(model: Transformer, rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and p, the chance of label 1."""
    rows = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("p"))


def out_of_fold(rows: DataFrame, columns: list[str], kind: str = "lr", folds: int = 5, keep: tuple[str, ...] = ("item_id", "grp", "y", "fold"), **options) -> DataFrame:
    """Every row's probability from a model that did not see its fold; ``rows`` have fold."""
    parts = [probabilities(fitted(rows.where(F.col("fold") != k), columns, kind, **options), rows.where(F.col("fold") == k), columns, list(keep)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """AUROC, average precision, accuracy, F1 and calibration error of each fold."""
    auc = E.auroc_ci(predictions, ["fold"]).select("fold", "auroc")
    return auc.join(E.threshold_metrics(predictions, ["fold"]), "fold").join(E.calibration_error(predictions, ["fold"]), "fold")


def nested_isotonic(rows: DataFrame, columns: list[str], kind: str = "lr", folds: int = 5, inner: int = 3) -> DataFrame:
    """Out-of-fold probabilities, calibrated by an isotonic fit on predictions within the training folds."""
    parts = []
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        inside = E.stratified_folds(train.drop("fold"), ["grp", "y"], "item_id", inner, seed=k)
        held = out_of_fold(inside, columns, kind, inner)
        iso = IsotonicRegression(featuresCol="p", labelCol="y").fit(held.withColumn("y", F.col("y").cast("double")))
        p = probabilities(fitted(train, columns, kind), test, columns, ["item_id", "grp", "y", "fold"])
        parts.append(iso.transform(p).select("item_id", "grp", "y", "fold", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("p")))
    return reduce(DataFrame.unionByName, parts)


def importance(model: Transformer, columns: list[str]) -> list[tuple[str, float]]:
    """Columns by absolute coefficient or impurity decrease, largest first."""
    last = model.stages[-1]
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    return sorted(zip(columns, (abs(float(v)) for v in values), strict=True), key=lambda x: (-x[1], x[0]))


def ablation(rows: DataFrame, subsets: dict[str, list[str]], kind: str = "lr") -> DataFrame:
    """AUROC with each subset of columns, and its difference from that of the first one."""
    scored = [out_of_fold(rows, columns, kind).withColumn("subset", F.lit(name)) for name, columns in subsets.items()]
    auc = E.auroc_ci(reduce(DataFrame.unionByName, scored), ["subset"]).select("subset", "auroc", "ci_low", "ci_high")
    first = auc.where(F.col("subset") == next(iter(subsets))).select(F.col("auroc").alias("_full"))
    return auc.crossJoin(F.broadcast(first)).withColumn("delta", F.col("auroc") - F.col("_full")).drop("_full")


def transfer(rows: DataFrame, columns: list[str], groups: list[str], kind: str = "lr") -> DataFrame:
    """AUROC on each group of a model trained on each other group."""
    parts = []
    for source in groups:
        model = fitted(rows.where(F.col("grp") == source), columns, kind)
        parts.append(probabilities(model, rows.where(F.col("grp").isin([g for g in groups if g != source])), columns, ["grp", "y"]).withColumn("source", F.lit(source)))
    return E.auroc_ci(reduce(DataFrame.unionByName, parts), ["source", "grp"]).select("source", F.col("grp").alias("target"), "auroc", "ci_low", "ci_high", "n_pos", "n_neg")


#: Columns of ``question_vectors``.
QUESTION_COLUMNS = [f"q_{k}" for k in range(64)]


def question_vectors(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with QUESTION_COLUMNS: the text's lower-cased words hashed to counts, of unit length; zeros for texts without words."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(len(QUESTION_COLUMNS))))
    counts = rows.withColumn("_slots", slots).withColumns({c: F.size(F.filter("_slots", lambda s, k=k: s == k)).cast("double") for k, c in enumerate(QUESTION_COLUMNS)})
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in QUESTION_COLUMNS), F.lit(0.0)))
    return counts.withColumn("_norm", F.greatest(norm, F.lit(1e-12))).withColumns({c: F.col(c) / F.col("_norm") for c in QUESTION_COLUMNS}).drop("_slots", "_norm")


def search(rows: DataFrame, columns: list[str], trials: int = 8, seed: int = 42) -> list[dict]:
    """Random search over model, strength, scaler and size; the objective is the row-weighted mean of the groups' AUROC. Best first."""
    import random

    rng, out = random.Random(seed), []
    for _ in range(trials):
        kind = rng.choice(["lr", "rf", "gbt"])
        options: dict = {"scaler": rng.choice(["standard", "robust", None])}
        options |= {"c": 10 ** rng.uniform(-2, 2)} if kind == "lr" else {"trees": rng.choice([10, 20, 40])}
        auc = E.auroc_ci(out_of_fold(rows, columns, kind, **options), ["grp"], min_per_class=2)
        n = F.col("n_pos") + F.col("n_neg")
        value = auc.where("auroc IS NOT NULL").agg((F.sum(F.col("auroc") * n) / F.sum(n)).alias("v")).first()["v"]
        out.append({"kind": kind, **options, "value": value})
    return sorted(out, key=lambda t: -(t["value"] or 0))


def tfidf(train: DataFrame, text: str = "text", vocabulary: int = 20_000, min_df: int = 2, c: float = 1.0) -> Transformer:
    """Words and pairs of words, weighted by 1 + ln(count) and smoothed idf, unit length, into a balanced ridge.

    Both kinds of terms share the vocabulary, the most frequent first.
    """
    rows = balanced(terms(train, text))
    counts = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary, minDF=min_df).fit(rows)
    damped = rows_with_damped(counts.transform(rows))
    idf = IDF(inputCol="damped", outputCol="weighted").fit(damped)
    unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
    total = float(rows.agg(F.sum("weight")).first()[0] or 1.0)
    model = classifier("lr", c=c, total_weight=total).fit(unit.transform(idf.transform(damped)))
    return _Text(lambda d: model.transform(unit.transform(idf.transform(rows_with_damped(counts.transform(terms(d, text)))))))


def fold_vocabularies(rows: DataFrame, folds: int, size: int) -> list[list[str]]:
    """Of each fold, the most frequent terms of the rows outside it that stand in two of these at least; ties by term. ``rows`` have item_id, fold and terms.

    All folds are counted in one pass; a term is in two rows where its least and greatest item_id differ.
    """
    inside = lambda k, x: F.when(F.col("fold") == k, x)
    counts = rows.select("fold", "item_id", F.explode("terms").alias("term")).groupBy("term").agg(
        *[f for k in range(folds) for f in (F.count(inside(k, F.lit(1))).alias(f"n{k}"), F.min(inside(k, F.col("item_id"))).alias(f"lo{k}"), F.max(inside(k, F.col("item_id"))).alias(f"hi{k}"))]
    )
    others = [[j for j in range(folds) if j != k] for k in range(folds)]
    ends = [(reduce(F.least, [F.col(f"lo{j}") for j in js]), reduce(F.greatest, [F.col(f"hi{j}") for j in js])) for js in others]
    places = [F.struct((-sum((F.col(f"n{j}") for j in js), F.lit(0))).alias("n"), "term") for js in others]
    # per fold a top-k that is taken per task first
    tops = counts.select("term", F.explode(F.array(*[F.when(lo != hi, F.struct(F.lit(k).alias("k"), p.alias("p"))) for k, ((lo, hi), p) in enumerate(zip(ends, places, strict=True))])).alias("t")).where("t IS NOT NULL")
    ranked = tops.select("t.k", "t.p").withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("p"))).where(F.col("rank") <= size)
    found: list[list[str]] = [[] for _ in range(folds)]
    for r in ranked.select("k", "rank", "p.term").orderBy("k", "rank").collect():
        found[r["k"]].append(r["term"])
    return found


def tfidf_out_of_fold(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame], text: str = "text", folds: int = 5, vocabulary: int = 20_000, c: float = 1.0) -> DataFrame:
    """(item_id, grp, y, p): every row's chance from a ``tfidf`` that did not see its fold; ``rows`` have fold, ``keep`` stores rows under a name.

    Texts are read twice: for the folds' vocabularies, and for damped counts over their union. In a fold's model terms outside its own
    vocabulary weigh nothing, which is the model that ``tfidf`` fits on the fold's own vocabulary.
    """
    counter = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary, minDF=2)
    worded = terms(rows, text).select("item_id", "grp", "y", "fold", "terms")
    own = fold_vocabularies(worded, folds, counter.getVocabSize())
    union = sorted(set().union(*own))
    counts = CountVectorizerModel.from_vocabulary(union or [""], inputCol="terms", outputCol="tf")
    vectors = keep(rows_with_damped(counts.transform(worded).drop("terms")).drop("tf"), "tfidf-counts")
    parts = []
    for k in range(folds):
        train, words = balanced(vectors.where(F.col("fold") != k)), set(own[k])
        idf = IDF(inputCol="damped", outputCol="weighted").fit(train)
        scale = ElementwiseProduct(inputCol="damped", outputCol="weighted", scalingVec=Vectors.dense([v if t in words else 0.0 for t, v in zip(union or [""], idf.idf.toArray(), strict=True)]))
        unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
        total = float(train.agg(F.sum("weight")).first()[0] or 1.0)
        model = classifier("lr", c=c, total_weight=total).fit(unit.transform(scale.transform(train)))
        parts.append(probabilities(model, unit.transform(scale.transform(vectors.where(F.col("fold") == k))), [], ["item_id", "grp", "y"]))
    return reduce(DataFrame.unionByName, parts)


class _Text:
    """A fitted text model; ``transform`` as any."""

    def __init__(self, run: Callable[[DataFrame], DataFrame]) -> None:
        self.transform = run


def terms(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with terms: lower-case words of two letters or more, accents dropped, and pairs of them."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\p{M}", "")
    out = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\w\w+", gaps=False).transform(rows.withColumn("_t", F.translate(plain, "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")))
    out = NGram(n=2, inputCol="_w", outputCol="_p").transform(out)
    return out.withColumn("terms", F.concat("_w", "_p")).drop("_t", "_w", "_p")


def rows_with_damped(rows: DataFrame) -> DataFrame:
    """tf with counts turned to 1 + ln(count), on the few entries of each sparse vector: no expression reaches into one."""
    damp = F.udf(lambda v: Vectors.sparse(v.size, v.indices, 1 + np.log(v.values)), VectorUDT())
    return rows.withColumn("damped", damp("tf"))
