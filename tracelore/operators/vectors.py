"""Features of sequences of step embeddings; vectors are array<double> of unit length.

Pairs of steps are joined within a trace only, on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Behaviors that revise an earlier step.
REVISIONS = ("B", "R", "X")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to the even one, at least 1."""
    return F.greatest(F.rint(x).cast("long"), F.lit(1).cast("long"))


def similarities(steps: DataFrame) -> DataFrame:
    """(item_id, i, j, n, sim) for all j < i of a trace."""
    sized = steps.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    a, b = sized.select("item_id", "n", F.col("step").alias("i"), F.col("v").alias("vi"), F.col("behavior")), steps.select("item_id", F.col("step").alias("j"), F.col("v").alias("vj"))
    return a.join(b, "item_id").where("j < i").select("item_id", "i", "j", "n", "behavior", dot(F.col("vi"), F.col("vj")).alias("sim"))


def recurrence(steps: DataFrame, threshold: float = 0.70, min_gap: int = 2, tail: float = 0.20) -> DataFrame:
    """Per trace: recurrence rate, longest cycle, progress repetition, recycling at the end, idle revisions; 0 where undefined."""
    s = similarities(steps)
    far, hit = (F.col("i") - F.col("j")) >= min_gap, F.col("sim") >= threshold
    n_tail = half_even(F.col("n") * tail)
    in_tail = (F.col("i") >= F.col("n") - n_tail) & (F.col("j") < F.col("n") - n_tail) & (F.col("n") >= 4)
    revised = (F.col("i") - F.col("j") == 1) & F.col("behavior").isin(*REVISIONS)
    zero = F.lit(0.0)
    best = s.groupBy("item_id", "i").agg(F.max("sim").alias("best")).groupBy("item_id").agg(F.avg("best").alias("progress_repetition"))
    out = s.groupBy("item_id").agg(
        F.coalesce(F.avg(F.when(far, hit.cast("double"))), zero).alias("recurrence_rate"), F.coalesce(F.max(F.when(far & hit, (F.col("i") - F.col("j")) / F.col("n"))), zero).alias("max_cycle_span"),
        F.coalesce(F.avg(F.when(in_tail, F.col("sim"))), zero).alias("termination_recycle"), F.coalesce(F.avg(F.when(revised, F.col("sim"))), zero).alias("revision_ineffectiveness"),
    )
    return steps.select("item_id").distinct().join(out.join(best, "item_id"), "item_id", "left").na.fill(0.0)


def cycles(steps: DataFrame, threshold: float = 0.85, min_gap: int = 3, corrections: tuple[str, ...] = ("V", "B", "R")) -> DataFrame:
    """Per trace: steps that a step at least ``min_gap`` later resembles, with a correction strictly between."""
    w = Window.partitionBy("item_id").orderBy("step")
    s = steps.withColumn("c", F.sum(F.col("behavior").isin(*corrections).cast("long")).over(w))
    a, b = s.select("item_id", F.col("step").alias("i"), F.col("v").alias("vi"), F.col("c").alias("ci")), s.select("item_id", F.col("step").alias("j"), F.col("v").alias("vj"), (F.col("c") - F.col("behavior").isin(*corrections).cast("long")).alias("cj"))
    hit = a.join(b, "item_id").where((F.col("j") >= F.col("i") + min_gap) & (F.col("cj") > F.col("ci")) & (dot(F.col("vi"), F.col("vj")) >= threshold))
    found = hit.groupBy("item_id").agg(F.countDistinct("i").alias("cycle_count"))
    return steps.select("item_id").distinct().join(found, "item_id", "left").select("item_id", F.coalesce("cycle_count", F.lit(0)).cast("long").alias("cycle_count"))


def _mean_vector(condition: Column, name: str) -> Column:
    return F.avg(F.when(condition, F.col("x"))).alias(name)


def alignment(steps: DataFrame, problems: DataFrame) -> DataFrame:
    """Per trace: likeness of the problem vector to the conclusion and to any step, and the drift from head to tail; (item_id, p) gives problems."""
    sized = steps.withColumn("n", F.count("*").over(Window.partitionBy("item_id"))).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("step")) - 1)
    share = half_even(F.col("n") * 0.2)
    long_ = sized.select("item_id", "n", "r", share.alias("k"), F.posexplode("v").alias("d", "x"))
    dims = long_.groupBy("item_id", "n", "d").agg(_mean_vector(F.col("r") >= F.col("n") - 3, "end"), _mean_vector(F.col("r") < F.col("k"), "head"), _mean_vector(F.col("r") >= F.col("n") - F.col("k"), "tail"))
    vec = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("d", c))), lambda x: x.getField(c)).alias(c)
    means = dims.groupBy("item_id", "n").agg(vec("end"), vec("head"), vec("tail"))
    top = steps.join(problems, "item_id").groupBy("item_id").agg(F.max(dot(F.col("v"), F.col("p")) / (F.sqrt(dot(F.col("p"), F.col("p"))) + 1e-9)).alias("top"))
    out = means.join(problems, "item_id").join(top, "item_id")
    return out.select(
        "item_id", F.greatest(F.lit(0.0), cosine(F.col("p"), F.col("end"))).alias("problem_conclusion_sim"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("top"))).alias("problem_trace_max_sim"),
        F.when(F.col("n") >= 5, cosine(F.col("p"), F.col("head")) - cosine(F.col("p"), F.col("tail"))).otherwise(0.0).alias("problem_drift"),
    )


def answer_cosines(steps: DataFrame, answers: DataFrame) -> DataFrame:
    """Per trace: how the steps' cosine to the answer vector (item_id, p) runs."""
    unit = F.sqrt(dot(F.col("p"), F.col("p")))
    s = steps.join(answers, "item_id").withColumn("cos", dot(F.col("v"), F.col("p")) / F.when(unit == 0, 1.0).otherwise(unit))
    w = Window.partitionBy("item_id")
    s = s.withColumn("n", F.count("*").over(w)).withColumn("r", (F.row_number().over(w.orderBy("step")) - 1).cast("double"))
    best = F.min_by("r", F.struct(-F.col("cos"), F.col("r")))
    out = s.groupBy("item_id").agg(
        F.max("cos").alias("max_cos"), best.alias("argmax"), F.max_by("cos", "r").alias("final_cos"), F.min_by("cos", "r").alias("first_cos"), F.coalesce(F.regr_slope("cos", "r"), F.lit(0.0)).alias("slope"),
        F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("sd"), F.avg(F.when((F.col("r") >= F.col("n") - 5) | (F.col("n") < 5), F.col("cos"))).alias("last5_mean"), F.count("*").alias("n_steps"),
    )
    return out.select("item_id", "max_cos", (F.col("argmax") / F.greatest(F.col("n_steps") - 1, F.lit(1))).alias("peak_pos"), "final_cos", "first_cos", "slope", "mean", "sd", (F.col("final_cos") - F.col("first_cos")).alias("drift"), "last5_mean", (F.col("argmax") < 0.3 * F.col("n_steps")).cast("int").alias("early_peak"), "n_steps")


def nearest_layers(layers: DataFrame, fractions: list[float]) -> DataFrame:
    """(item_id, fraction, layer): of the layers at hand the one nearest to each depth, the lower one of two."""
    top = layers.groupBy("item_id").agg(F.max("layer").alias("deepest"))
    want = layers.join(top, "item_id").withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    return want.groupBy("item_id", "fraction").agg(F.min_by("layer", F.struct(F.abs(F.col("layer") - F.col("fraction") * F.col("deepest")), F.col("layer"))).alias("layer"))
