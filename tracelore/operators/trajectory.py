"""Features of token trajectories (item_id, t, logprob, entropy); t runs from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelore.operators.vectors import half_even


def summary(tokens: DataFrame, low: float = -5.0, tail: float = 0.20) -> DataFrame:
    """Ten statistics of each trajectory."""
    w = Window.partitionBy("item_id")
    s = tokens.withColumn("n", F.count("*").over(w)).withColumn("mean_e", F.avg("entropy").over(w))
    s = s.withColumn("dev", F.col("entropy") - F.col("mean_e")).withColumn("next", F.lead("dev").over(w.orderBy("t")))
    out = s.groupBy("item_id").agg(
        F.avg("logprob").alias("mean_logprob"), F.stddev_pop("logprob").alias("std_logprob"), F.min("logprob").alias("min_logprob"), F.avg((F.col("logprob") < low).cast("double")).alias("low_logprob_frac"),
        F.avg("entropy").alias("mean_entropy"), F.stddev_pop("entropy").alias("std_entropy"), F.max("entropy").alias("max_entropy"), (F.min_by("t", F.struct(-F.col("entropy"), F.col("t"))) / F.greatest(F.count("*") - 1, F.lit(1))).alias("max_entropy_pos"),
        F.avg(F.when(F.col("t") >= F.col("n") - half_even(F.col("n") * tail), F.col("entropy"))).alias("entropy_in_conclusion"),
        F.coalesce(F.sum(F.col("dev") * F.col("next")) / (F.sum(F.col("dev") * F.col("dev")) + 1e-9), F.lit(0.0)).alias("entropy_autocorr_lag1"),
    )
    return out


def quartiles(tokens: DataFrame) -> DataFrame:
    """Mean surprise and entropy of each quarter; the last takes the remainder, the others are null under four tokens."""
    q = F.floor(F.col("n") / 4)
    s = tokens.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    s = s.withColumn("part", F.when(q == 0, 3).otherwise(F.least(F.floor(F.col("t") / F.greatest(q, F.lit(1))), F.lit(3))).cast("int"))
    nll = -F.col("logprob")
    return s.groupBy("item_id").agg(*[F.avg(F.when(F.col("part") == k, x)).alias(f"{name}_q{k + 1}") for name, x in (("nll", nll), ("entropy", F.col("entropy"))) for k in range(4)])


def spans(tokens: DataFrame, marks: DataFrame) -> DataFrame:
    """Mean and highest surprise over token ranges (item_id, name, lo, hi), the end not included."""
    nll = -F.col("logprob")
    return tokens.join(marks, "item_id").where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi"))).groupBy("item_id", "name").agg(F.avg(nll).alias("mean_nll"), F.max(nll).alias("max_nll"))


def _rolling(rows: DataFrame, means: dict[str, tuple[str, int]]) -> DataFrame:
    """``rows`` with means, by name (value, number of last steps) of each, that are equal for the same values in any order.

    They come from differences of a trace's running sums in decimals; where a value fits none, from doubles.
    """
    w = Window.partitionBy("item_id").orderBy("t")
    run, zero = w.rowsBetween(Window.unboundedPreceding, 0), F.lit(0).cast("decimal(38,24)")
    first, then, out = {}, {}, {}
    for name, (value, size) in means.items():
        exact = F.col(value).try_cast("decimal(38,24)")
        first |= {f"_{name}_sum": F.try_sum(F.coalesce(exact, zero)).over(run), f"_{name}_fit": F.count(exact).over(run), f"_{name}_all": F.count(value).over(run), f"_{name}_avg": F.avg(value).over(w.rowsBetween(1 - size, 0))}
        then |= {c: F.try_subtract(F.col(c), F.coalesce(F.lag(c, size).over(w), F.lit(0))) for c in (f"_{name}_sum", f"_{name}_fit", f"_{name}_all")}
        total, fit, n, avg = (F.col(f"_{name}_{c}") for c in ("sum", "fit", "all", "avg"))
        out[name] = F.when(fit == n, F.coalesce(total.cast("double") / F.nullif(n, F.lit(0)), avg)).otherwise(avg)
    return rows.withColumns(first).withColumns(then).withColumns(out).drop(*first)


def bursts(tokens: DataFrame, window: int = 50, smooth: int = 20, spike: float = 8.0) -> DataFrame:
    """Worst stretch of surprise and its place, spikes and their share in the last fifth, and the largest fall of smoothed entropy.

    Of stretches with equal means the first counts, whatever the order of the values in them.
    """
    w = Window.partitionBy("item_id").orderBy("t")
    n = F.count("*").over(Window.partitionBy("item_id"))
    s = tokens.withColumns({"n": n, "nll": -F.col("logprob")})
    s = _rolling(s, {"roll": ("nll", window), "soft": ("entropy", smooth)})
    s = s.withColumns({c: F.when((F.col("t") >= k - 1) & (F.col("n") >= k), F.col(c)) for c, k in (("roll", window), ("soft", smooth))})
    s = s.withColumn("fall", F.max("soft").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("soft"))
    hot = F.col("nll") > spike
    out = s.groupBy("item_id").agg(
        F.max("n").alias("n"), F.max("roll").alias("roll"), F.min_by("t", F.when(F.col("roll").isNotNull(), F.struct(-F.col("roll"), F.col("t")))).alias("roll_at"), F.avg("nll").alias("mean"),
        F.count_if(hot).alias("n_spikes"), F.count_if(hot & (F.col("t") >= F.floor(F.col("n") * 0.8))).alias("late"), F.max("fall").alias("entropy_collapse"), F.min_by("t", F.when(F.col("soft").isNotNull(), F.struct(-F.col("soft"), F.col("t")))).alias("soft_at"),
    )
    long_ = F.col("n") >= window
    return out.select(
        "item_id", F.when(long_, F.col("roll")).otherwise(F.col("mean")).alias("max_window_nll"), F.when(long_, (F.col("roll_at") - (window - 1)) / F.greatest(F.col("n") - window, F.lit(1))).otherwise(0.0).alias("max_window_pos"),
        "n_spikes", F.when(F.col("n_spikes") > 0, F.col("late") / F.col("n_spikes")).otherwise(0.0).alias("spike_tail_frac"), "entropy_collapse", ((F.col("soft_at") - (smooth - 1)) / F.greatest(F.col("n") - smooth, F.lit(1))).alias("entropy_peak_pos"),
    )
