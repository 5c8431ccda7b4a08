"""Joins, reshaping and summaries of feature families, predictions and metric tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Families of columns by their prefixes, and the subsets that studies compare.
FAMILIES = {"hand": "hand_", "ngram": "ng", "timing": "t_", "graph": "g_", "topology": ("h0_", "h1_"), "oof": "oof_"}
SUBSETS = {"all": tuple(FAMILIES), "oof": ("oof",), "structure": ("ngram", "timing", "graph", "topology"), "no_oof": ("hand", "ngram", "timing", "graph", "topology"), "hand": ("hand",)}


def join_families(anchor: DataFrame, families: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """The anchor with the columns of every family; columns that the left side has already are dropped from the right."""
    return reduce(lambda a, b: a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), keys, how), families, anchor)


def label_disagreements(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: items in both, and those whose labels differ."""
    other = b.select(*keys, F.col(label).alias("_other"))
    return a.select(*keys, label).join(other, keys).agg(F.count("*").alias("n_shared"), F.count_if(~F.col(label).eqNullSafe(F.col("_other"))).alias("n_disagree"))


def checked_join(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Inner join that fails where the two sides' labels differ."""
    other = b.withColumnRenamed(label, "_other")
    same = F.when(F.col(label).eqNullSafe(F.col("_other")), F.col(label)).otherwise(F.raise_error(F.lit("labels disagree on a shared key")).cast("int"))
    return a.join(other, keys).withColumn(label, same).drop("_other")


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_present) of every given column."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(c).alias("n_present")) for c in columns])).alias("x")).select("x.*")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in a stated order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def fold_agreement(canonical: DataFrame, other: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """Share of shared items that two fold assignments agree on."""
    b = other.select(*keys, F.col(fold).alias("_f"))
    return canonical.select(*keys, fold).join(b, keys).agg(F.count("*").alias("n_shared"), F.avg((F.col(fold) == F.col("_f")).cast("double")).alias("agreement"))


def pivot_matrix(rows: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Wide form with a known list of columns, so that nothing is scanned to find them."""
    return rows.groupBy(row).pivot(column, names).agg(F.first(value))


def matrix_delta(a: DataFrame, b: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Per row: mean, median, range and deviations of b - a off the diagonal; cells of one side only count for nothing."""
    other = b.select(row, column, F.col(value).alias("_b"))
    d = a.select(row, column, F.col(value).alias("_a")).join(other, [row, column], "outer").where(F.col(row) != F.col(column)).withColumn("d", F.col("_b") - F.col("_a"))
    return d.groupBy(row).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.percentile("d", 0.5).alias("median"), F.min("d").alias("low"), F.max("d").alias("high"), F.stddev_pop("d").alias("sd_pop"), F.stddev_samp("d").alias("sd_samp"))


def top_k(rows: DataFrame, keys: list[str], by: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long")).where(F.col("rank") <= k)


def best_of(rows: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """The name with the highest score of each key; of equal ones the first by name."""
    return rows.groupBy(*keys).agg(F.min_by(name, F.struct(-F.col(score), F.col(name))).alias("best"), F.max(score).alias("best_score"))


def outcome_counts(tests: DataFrame, keys: list[str], diff: str, p: str, level: float = 0.05) -> DataFrame:
    """Wins, significant wins and losses per key."""
    win, loss, sure = F.col(diff) > 0, F.col(diff) < 0, F.col(p) < level
    return tests.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(win).alias("wins"), F.count_if(win & sure).alias("sig_wins"), F.count_if(loss).alias("losses"), F.count_if(loss & sure).alias("sig_losses"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean by weight over rows that have a value."""
    some = F.col(value).isNotNull()
    return rows.groupBy(*keys).agg((F.sum(F.when(some, F.col(value) * F.col(weight))) / F.sum(F.when(some, F.col(weight)))).alias("weighted_mean"))


def split_group(group: Column) -> tuple[Column, Column]:
    """(data set, model) of a group name: the model is what follows the last underscore."""
    return F.regexp_extract(group, r"^(.*)_[^_]*$", 1), F.regexp_extract(group, r"([^_]*)$", 1)


def strip_suffixes(name: Column, suffixes: list[str]) -> Column:
    """The name of a file without folder, ending and the first known suffix that it has."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(stem, "(?:" + "|".join(suffixes) + ")$", "")


#: Bands that a range of values is cut into, and rows whose distinct values may reach the driver.
BANDS, FEW = 4096, 100_000


def quantiles(rows: DataFrame, value: str, fractions: list[float]) -> list[float]:
    """Exact quantiles, linear between order statistics; nulls are left out, NaN for no rows.

    Ranges of values are cut into bands and counted, and those that hold a wanted rank cut
    again, until few rows are left in them; no task holds the distinct values of the table.
    """
    some = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    whole = some.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole["n"]:
        return [float("nan")] * len(fractions)
    at = [(whole["n"] - 1) * f for f in fractions]
    ranks = {int(k) for x in at for k in (math.floor(x), math.ceil(x))}
    found: dict[int, float] = {}
    # (lowest value, highest, rows before, rows)
    spans = [(whole["lo"], whole["hi"], 0, whole["n"])]
    while spans:
        if sum(s[3] for s in spans) <= FEW:
            inside = reduce(lambda a, b: a | b, [F.col("v").between(lo, hi) for lo, hi, _, _ in spans])
            counts = sorted((r["v"], r["n"]) for r in some.where(inside).groupBy("v").agg(F.count("*").alias("n")).collect())
            for lo, hi, before, _ in spans:
                for v, n in counts:
                    if lo <= v <= hi:
                        found |= {k: v for k in ranks if before <= k < before + n}
                        before += n
            break
        band = reduce(lambda rest, s: F.when(F.col("v").between(s[1][0], s[1][1]), s[0] * BANDS + F.least(F.floor((F.col("v") - s[1][0]) / (s[1][1] - s[1][0]) * BANDS), F.lit(BANDS - 1))).otherwise(rest), enumerate(spans), F.lit(None))
        cut = some.groupBy(band.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("b IS NOT NULL").collect()
        inner = []
        for k, (_, _, before, _) in enumerate(spans):
            for r in sorted((r for r in cut if r["b"] // BANDS == k), key=lambda r: r["b"]):
                here = {x for x in ranks if before <= x < before + r["n"]}
                if here and r["lo"] == r["hi"]:
                    found |= dict.fromkeys(here, r["lo"])
                elif here:
                    inner.append((r["lo"], r["hi"], before, r["n"]))
                before += r["n"]
        spans = inner
    ends = [(found[math.floor(x)], found[math.ceil(x)], x - math.floor(x)) for x in at]
    return [lo if part == 0 else (1 - part) * lo + part * hi for lo, hi, part in ends]


def quantile_edges(rows: DataFrame, value: str, bins: int) -> list[float]:
    """Exact quantiles, linear between values; bins + 1 numbers."""
    return quantiles(rows, value, [k / bins for k in range(bins + 1)])


def quantile_bins(rows: DataFrame, value: str, bins: int, *, closed: str = "right") -> DataFrame:
    """``rows`` with bin: (low, high] with the lowest value in the first, or by inner edges [low, high)."""
    edges = quantile_edges(rows, value, bins)
    v = F.col(value)
    if closed == "right":
        n = sum(((v > x).cast("int") for x in edges[1:-1]), F.lit(0))
    else:
        n = sum(((v >= x).cast("int") for x in edges[1:-1]), F.lit(0))
    return rows.withColumn("bin", F.when(v.isNotNull(), n))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """At most ``per_stratum`` rows of each stratum, in order of a hash of key and seed."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))).where(F.col("_n") <= per_stratum).drop("_n")


def confusion(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """(true, predicted, n); rows without either label are left out."""
    return rows.where(F.col(true).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion table; 0 where undefined."""
    t = matrix.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"))
    out = t.join(p, "label", "outer").na.fill(0, ["support", "tp", "named"])
    precision, recall = F.coalesce(F.try_divide("tp", "named"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    out = out.withColumns({"precision": precision, "recall": recall})
    return out.select("label", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "support")


def kappa(matrix: DataFrame) -> DataFrame:
    """One row: n, accuracy, chance agreement and Cohen's kappa."""
    n = F.sum("n")
    whole = matrix.agg(n.alias("n"), F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    a, b = matrix.groupBy(F.col("true").alias("c")).agg(n.alias("a")), matrix.groupBy(F.col("predicted").alias("c")).agg(n.alias("b"))
    chance = a.join(b, "c").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    out = whole.crossJoin(F.broadcast(chance)).select("n", (F.col("hit") / F.col("n")).alias("accuracy"), (F.col("ab") / (F.col("n") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("accuracy") - F.col("expected")) / (1 - F.col("expected"))).otherwise(0.0))


def one_hot(rows: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    return rows.withColumns({f"{prefix}{v}": (F.col(column) == v).cast("int") for v in sorted(values)})


def stars(p: Column) -> Column:
    """Marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def verdict(low: Column, high: Column, bound: float = 0.65) -> Column:
    """Whether an interval clears, misses or straddles a bound."""
    return F.when(low >= bound, "supported").when(high < bound, "rejected").otherwise("undecided")


def provenance(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: size, distinct keys, base rate, and a digest of the rows that does not depend on their order."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys, label]])
    part = lambda k: F.bit_xor(F.conv(F.substring(F.sha2(text, 256), k, 15), 16, 10).cast("long"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct(*keys).alias("n_keys"), F.avg(F.col(label).cast("double")).alias("base_rate"), F.lower(F.hex(part(1))).alias("digest"))


def subset_columns(columns: list[str], subset: str) -> list[str]:
    """Columns of a named subset of families, by prefix."""
    return [c for c in columns if any(c.startswith(FAMILIES[f]) for f in SUBSETS[subset])]


def melted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value): one row per row and feature."""
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keys, "x.feature", "x.value")


def scaled_features(rows: DataFrame, keys: list[str], columns: list[str], inverted: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, value): every feature brought to [0, 1], inverted ones turned round, constants at 0."""
    long_ = melted(rows, keys, columns)
    ends = long_.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = long_.join(F.broadcast(ends), "feature")
    unit = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return out.select(*keys, "feature", F.when(F.col("feature").isin(*inverted), 1 - unit).otherwise(unit).alias("value"))
