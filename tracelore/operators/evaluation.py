"""Evaluation of probabilistic predictions: rank statistics, calibration, rejection, conformal sets.

Input is a table with slice columns, a label y (0/1) and a probability p. Ranks over a
slice never stand in one window: items fall into BANDS bands of the probability, bands
are counted, and a window covers one band only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the 0.975 quantile of the standard normal distribution.
Z_975 = 1.959963984540054
#: Bands that the probabilities of a slice are dealt over.
BANDS = 4096
#: Inner and outer edges of the ten calibration bins, as doubles nearest to multiples of 0.1 by equal steps.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def band(score: Column) -> Column:
    """The band of a score, rising with it; scores outside [0, 1] share the outer bands."""
    return F.least(F.greatest(F.floor(score * BANDS), F.lit(-1)), F.lit(BANDS + 1))


def running(rows: DataFrame, keys: list[str], score: str, values: list[str], *, ties: str | None = None) -> DataFrame:
    """``rows`` plus before_<value>: the sum of each value over rows of the slice with a lower score (or, by ``ties``, an equal score and a lower tie)."""
    rows = rows.withColumn("_band", band(F.col(score)))
    totals = rows.groupBy(*keys, "_band").agg(*[F.sum(v).alias(v) for v in values])
    over = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    # at most BANDS + 2 rows per slice
    start = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_band").alias("_b"), *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"_s_{v}") for v in values])
    on = F.col("_band") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    order = [score] if ties is None else [score, ties]
    inside = Window.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(start, on).withColumns({f"before_{v}": F.col(f"_s_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return out.drop("_band", "_b", *[f"_k{i}" for i in range(len(keys))], *[f"_s_{v}" for v in values])


def score_table(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """One row per slice and distinct score: pos, neg at it and below it, and the slice's m positives and n negatives."""
    at = rows.groupBy(*keys, F.col(p).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))
    totals = at.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).agg(F.sum("pos").alias("m"), F.sum("neg").alias("n"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    return running(at, keys, "s", ["pos", "neg"]).join(totals, on).drop(*[f"_t{i}" for i in range(len(keys))])


def components(table: DataFrame) -> DataFrame:
    """A score table with v_pos and v_neg, the structural components of a positive and a negative at the score."""
    above = F.col("m") - F.col("before_pos") - F.col("pos")
    return table.withColumns({"v_pos": F.try_divide(F.col("before_neg") + F.col("neg") * 0.5, F.col("n")), "v_neg": F.try_divide(above + F.col("pos") * 0.5, F.col("m"))})


def _variance(v: str, w: str) -> Column:
    n, mean = F.sum(w), F.try_divide(F.sum(F.col(v) * F.col(w)), F.sum(w))
    return F.when(n >= 2, F.greatest((F.sum(F.col(v) * F.col(v) * F.col(w)) - n * mean * mean) / (n - 1), F.lit(0.0))).otherwise(0.0)


def auroc_ci(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y", min_per_class: int = 1) -> DataFrame:
    """AUROC of every slice with its DeLong variance and a logit interval, plain where the logit has none; null with too few of a class."""
    c = components(score_table(rows, keys, p, y))
    out = c.groupBy(*keys).agg(F.max("m").alias("n_pos"), F.max("n").alias("n_neg"), F.try_divide(F.sum(F.col("v_pos") * F.col("pos")), F.max("m")).alias("auroc"), (F.try_divide(_variance("v_pos", "pos"), F.max("m")) + F.try_divide(_variance("v_neg", "neg"), F.max("n"))).alias("var_auroc"))
    enough = (F.col("n_pos") >= min_per_class) & (F.col("n_neg") >= min_per_class)
    out = out.withColumns({x: F.when(enough, F.col(x)) for x in ("auroc", "var_auroc")})
    se, auc = F.sqrt("var_auroc"), F.col("auroc")
    plain = (F.col("var_auroc") <= 0) | (auc <= 0) | (auc >= 1)
    eta, width = F.log(F.try_divide(auc, 1 - auc)), F.try_divide(Z_975 * se, auc * (1 - auc))
    low = F.when(plain, F.greatest(F.lit(0.0), auc - Z_975 * se)).otherwise(1 / (1 + F.exp(-(eta - width))))
    high = F.when(plain, F.least(F.lit(1.0), auc + Z_975 * se)).otherwise(1 / (1 + F.exp(-(eta + width))))
    return out.withColumns({"ci_low": F.when(enough, low), "ci_high": F.when(enough, high)})


def normal_sf2(z: Column) -> Column:
    """Two-sided tail of the standard normal beyond |z|, by a rational form with an error under 1.2e-7 of the value."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = k + t * poly
    return t * F.exp(-x * x + poly)


def paired_delong(rows: DataFrame, keys: list[str], a: str = "p_a", b: str = "p_b", y: str = "y") -> DataFrame:
    """Difference of two models' AUROC on the same items, its variance, z, two-sided p and interval."""
    on = lambda s: [*keys, s]
    ca, cb = (components(score_table(rows, keys, c, y)).select(*keys, F.col("s").alias(c), F.col("v_pos").alias(f"pos_{c}"), F.col("v_neg").alias(f"neg_{c}")) for c in (a, b))
    items = rows.select(*keys, y, a, b).join(ca, on(a)).join(cb, on(b))
    pos, neg = F.col(y) == 1, F.col(y) == 0
    va, vb = F.when(pos, F.col(f"pos_{a}")).otherwise(F.col(f"neg_{a}")), F.when(pos, F.col(f"pos_{b}")).otherwise(F.col(f"neg_{b}"))
    items = items.withColumns({"va": va, "vb": vb, "d": va - vb})
    out = items.groupBy(*keys).agg(
        F.avg(F.when(pos, F.col("va"))).alias("auroc_a"), F.avg(F.when(pos, F.col("vb"))).alias("auroc_b"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"),
        (F.try_divide(F.coalesce(F.var_samp(F.when(pos, F.col("d"))), F.lit(0.0)), F.count_if(pos)) + F.try_divide(F.coalesce(F.var_samp(F.when(neg, F.col("d"))), F.lit(0.0)), F.count_if(neg))).alias("var_diff"),
    )
    out = out.withColumn("diff", F.col("auroc_a") - F.col("auroc_b"))
    se = F.sqrt("var_diff")
    out = out.withColumn("z", F.when(F.col("var_diff") > 0, F.col("diff") / se).when(F.col("diff") == 0, 0.0).otherwise(F.signum("diff") * float("inf")))
    unknown = F.col("var_diff").isNull() | F.col("diff").isNull()
    out = out.withColumn("z", F.when(~unknown, F.col("z")))
    return out.withColumns({"p_two_sided": F.when(unknown, F.lit(None)).when(F.col("var_diff") > 0, normal_sf2(F.col("z"))).when(F.col("diff") == 0, 1.0).otherwise(0.0), "ci_low": F.col("diff") - Z_975 * se, "ci_high": F.col("diff") + Z_975 * se})


def calibration_error(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Expected calibration error over ten bins [edge, next edge); a probability of 1 is in no bin but counts in the whole."""
    bin_ = F.lit(None).cast("int")
    for k in range(len(EDGES) - 1):
        bin_ = F.when((F.col(p) >= EDGES[k]) & (F.col(p) < EDGES[k + 1]), k).otherwise(bin_)
    per = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(p).alias("conf"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return per.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def threshold_metrics(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Accuracy and F1 at 0.5, base rate, and average precision over distinct thresholds."""
    hit, pos = F.col(p) >= 0.5, F.col(y) == 1
    tp, fp, fn = F.count_if(hit & pos), F.count_if(hit & ~pos), F.count_if(~hit & pos)
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((hit == pos).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), F.avg(F.col(y).cast("double")).alias("base_rate"))
    t = score_table(rows, keys, p, y)
    got, seen = F.col("m") - F.col("before_pos"), F.col("m") + F.col("n") - F.col("before_pos") - F.col("before_neg")
    ap = t.groupBy(*keys).agg(F.coalesce(F.sum(F.try_divide(F.col("pos"), F.col("m")) * got / seen), F.lit(0.0)).alias("auprc"))
    return plain.join(ap, keys)


def by_confidence(rows: DataFrame, keys: list[str], score: Column, y: str, tie: str) -> DataFrame:
    """(keys, k, n, wrong, cum_wrong): items from the highest score on, equal ones by ``tie``, with errors among the first k."""
    items = rows.select(*keys, (1 - score).alias("_d"), F.col(tie).alias("_t"), (1 - F.col(y)).cast("long").alias("wrong"), F.lit(1).cast("long").alias("one"))
    n = items.groupBy(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"), F.sum("wrong").alias("all_wrong"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_n{i}"))
    out = running(items, keys, "_d", ["one", "wrong"], ties="_t").join(n, on)
    return out.select(*keys, (F.col("before_one") + 1).alias("k"), "n", "wrong", (F.col("before_wrong") + F.col("wrong")).alias("cum_wrong"), "all_wrong")


def rejection_ratio(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y", tie: str = "item_id") -> DataFrame:
    """Areas under risk-coverage curves of the model, of chance and of the oracle, and the rejection ratio."""
    c = by_confidence(rows, keys, F.col(p), y, tie)
    risk, oracle = F.col("cum_wrong") / F.col("k"), F.greatest(F.lit(0), F.col("k") - (F.col("n") - F.col("all_wrong"))) / F.col("k")
    c = c.withColumns({"risk": risk, "oracle": oracle, "edge": (F.col("k") == 1) | (F.col("k") == F.col("n"))})
    # the trapezoid of equal steps 1/n from the first item to the last
    area = lambda x: F.when(F.max("n") > 1, (F.sum(x) - F.sum(F.when(F.col("edge"), F.col(x))) / 2) / F.max("n")).otherwise(0.0)
    out = c.groupBy(*keys).agg(F.max("n").alias("n"), area("risk").alias("aurc_method"), area("oracle").alias("aurc_oracle"), (F.max("all_wrong") / F.max("n") * (F.max("n") - 1) / F.max("n")).alias("aurc_random"))
    room = F.col("aurc_random") - F.col("aurc_oracle")
    return out.withColumn("prr", F.when(room > 1e-12, (F.col("aurc_random") - F.col("aurc_method")) / room).otherwise(0.0))


def selective_curve(rows: DataFrame, keys: list[str], p: str = "p", y: str = "y", tie: str = "item_id", points: int = 100) -> DataFrame:
    """Share of label 1 among the top ``coverage`` by probability, at equally spaced coverages from 0.05 to 1."""
    c = by_confidence(rows, keys, F.col(p), y, tie)
    grid = c.select(*keys, "n").distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("coverage", 0.05 + F.col("point") * (0.95 / (points - 1)))
    grid = grid.withColumn("k", F.greatest(F.floor(F.col("coverage") * F.col("n")), F.lit(1)).cast("long"))
    return grid.join(c.select(*keys, "k", "cum_wrong"), [*keys, "k"]).select(*keys, "point", "coverage", "k", (1 - F.col("cum_wrong") / F.col("k")).alias("accuracy"))


def selective_accuracy(rows: DataFrame, keys: list[str], coverages: list[float], p: str = "p", y: str = "y", tie: str = "item_id") -> DataFrame:
    """Accuracy at 0.5 of the ``coverage`` share of items that are furthest from 0.5."""
    right = rows.withColumn("_right", ((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("int"))
    conf = F.when(F.col(p) >= 0.5, F.col(p)).otherwise(1 - F.col(p))
    c = by_confidence(right, keys, conf, "_right", tie)
    grid = c.select(*keys, "n").distinct().withColumn("coverage", F.explode(F.array(*map(F.lit, coverages))))
    grid = grid.withColumn("k", F.greatest(F.ceil(F.col("coverage") * F.col("n")), F.lit(1)).cast("long"))
    return grid.join(c.select(*keys, "k", "cum_wrong"), [*keys, "k"]).select(*keys, "coverage", "k", (1 - F.col("cum_wrong") / F.col("k")).alias("accuracy"))


def conformal_threshold(calibration: DataFrame, keys: list[str], alpha: float, p: str = "p", y: str = "y") -> DataFrame:
    """(keys, n_cal, threshold): the inflated quantile of 1 - p(label), linearly between order statistics."""
    s = calibration.select(*keys, F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p)).alias("s"), F.lit(1).cast("long").alias("one"))
    n = s.groupBy(*keys).agg(F.count("*").alias("n_cal"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n_cal") + 1) * (1 - alpha)) / F.col("n_cal"))
    n = n.withColumn("at", (F.col("n_cal") - 1) * level)
    at = running(s.groupBy(*keys, "s").agg(F.sum("one").alias("one")), keys, "s", ["one"]).join(n, keys)
    # ranks of a distinct score: before_one .. before_one + one - 1
    holds = lambda r: (F.col("before_one") <= r) & (r < F.col("before_one") + F.col("one"))
    out = at.groupBy(*keys).agg(F.max("n_cal").alias("n_cal"), F.max("at").alias("at"), F.max(F.when(holds(F.floor("at")), F.col("s"))).alias("lo"), F.max(F.when(holds(F.ceil("at")), F.col("s"))).alias("hi"))
    return out.select(*keys, "n_cal", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("threshold"))


def conformal(calibration: DataFrame, test: DataFrame, keys: list[str], alpha: float, p: str = "p", y: str = "y") -> DataFrame:
    """Coverage, mean set size and shares of singletons and empty sets of the test rows of each slice."""
    return _covered(test.join(conformal_threshold(calibration, keys, alpha, p, y), keys), keys, alpha, p, y)


def _covered(t: DataFrame, keys: list[str], alpha: float, p: str, y: str) -> DataFrame:
    """``conformal`` of test rows that have threshold and n_cal."""
    t = t.withColumns({"in1": (1 - F.col(p)) <= F.col("threshold"), "in0": F.col(p) <= F.col("threshold")})
    size = F.col("in0").cast("int") + F.col("in1").cast("int")
    covered = F.when(F.col(y) == 1, F.col("in1")).otherwise(F.col("in0"))
    one = size == 1
    return t.groupBy(*keys).agg(
        F.lit(alpha).alias("alpha"), F.max("threshold").alias("threshold"), F.max("n_cal").alias("n_cal"), F.count("*").alias("n_test"), F.avg(covered.cast("double")).alias("coverage"), F.avg(size.cast("double")).alias("avg_set_size"),
        F.avg(one.cast("double")).alias("singleton_fraction"), F.avg((size == 0).cast("double")).alias("empty_fraction"), F.avg(F.when(one, (F.col("in1") == (F.col(y) == 1)).cast("double"))).alias("singleton_accuracy"),
    )


def leave_one_out(rows: DataFrame, group: str, alpha: float, p: str = "p", y: str = "y", least: int = 30) -> DataFrame:
    """Conformal sets of every group of at least ``least`` rows, calibrated on all the others.

    A group's threshold is an order statistic of all scores without its own: bands of the
    scores are counted once for all and once per group, and the difference tells the bands
    that hold it. Only the scores of those bands are looked at again; no row is copied.
    """
    named = F.col(group).alias("target")
    at = rows.select(named, F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p)).alias("s")).groupBy("target", "s").agg(F.count("*").alias("c")).withColumn("band", band(F.col("s")))
    own = at.groupBy("target", "band").agg(F.sum("c").alias("own"))
    sizes = own.groupBy("target").agg(F.sum("own").alias("n"))
    total = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    n = F.col("n_cal")
    goal = sizes.where(F.col("n") >= least).select("target", (F.lit(total) - F.col("n")).alias("n_cal")).where(n > 0)
    goal = goal.withColumn("at", (n - 1) * F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n))
    # BANDS + 2 rows per group
    grid = goal.select("target", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(BANDS + 1).cast("long"))).alias("band"))
    grid = grid.join(own.groupBy("band").agg(F.sum("own").alias("all")), "band").join(own, ["target", "band"], "left").withColumn("c", F.col("all") - F.coalesce("own", F.lit(0)))
    earlier = lambda *by: Window.partitionBy("target", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("before", F.coalesce(F.sum("c").over(earlier("band")), F.lit(0))).join(goal, "target")
    grid = grid.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))).select("target", "n_cal", "at", "rank", "band", "before")
    # two rows per group at most
    near = at.groupBy("band", "s").agg(F.sum("c").alias("all")).join(F.broadcast(grid), "band").join(at.select("target", "s", F.col("c").alias("own")), ["target", "s"], "left").withColumn("c", F.col("all") - F.coalesce("own", F.lit(0)))
    near = near.withColumn("upto", F.col("before") + F.coalesce(F.sum("c").over(earlier("rank", "s")), F.lit(0))).where((F.col("upto") <= F.col("rank")) & (F.col("rank") < F.col("upto") + F.col("c")))
    ends = near.groupBy("target").agg(F.max("n_cal").alias("n_cal"), F.max("at").alias("at"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    threshold = ends.select("target", "n_cal", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("threshold"))
    return _covered(rows.select(named, p, y).join(F.broadcast(threshold), "target"), ["target"], alpha, p, y)


def stratified_folds(rows: DataFrame, strata: list[str], key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with fold: within each stratum, items in order of a hash are dealt round robin."""
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")))
    rows = rows.withColumn("_pre", F.substring("_h", 1, 3)).withColumn("one", F.lit(1).cast("long"))
    counts = rows.groupBy(*strata, "_pre").agg(F.sum("one").alias("c"))
    before = counts.select(*strata, "_pre", F.coalesce(F.sum("c").over(Window.partitionBy(*strata).orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_pre").orderBy("_h", key)) - 1
    return rows.join(before, [*strata, "_pre"]).withColumn("fold", ((F.col("_before") + inside) % folds).cast("int")).drop("_h", "_pre", "_before", "one")


def fold_summary(metrics: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return metrics.groupBy(*keys).agg(*[a for m in names for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def with_slices(rows: DataFrame, **slices: Column) -> DataFrame:
    """Each row once for the slice "overall" and once for every given kind of slice: rank statistics need whole slices."""
    parts = [F.struct(F.lit("overall").alias("slice_kind"), F.lit("all").alias("slice_value"))] + [F.struct(F.lit(k).alias("slice_kind"), v.cast("string").alias("slice_value")) for k, v in slices.items()]
    return rows.withColumn("_s", F.explode(F.array(*parts))).select("*", "_s.slice_kind", "_s.slice_value").drop("_s")
