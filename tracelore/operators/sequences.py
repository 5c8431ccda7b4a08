"""Features of behavior sequences: counts, runs, transitions, n-grams and timing.

Input is an episode table (item_id, position, behavior, token_count, ...) or one string
per trace. Windows partition by trace; arrays stay inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The behavior alphabet, and motifs whose late occurrences weigh more.
BEHAVIORS = ("F", "V", "B", "R", "S", "H", "C")
POSITION_MOTIFS = ("BV", "VB", "BF", "VF", "FC", "HB", "RF", "BVF", "VBV", "FVF", "BVB", "HHH")
HISTOGRAM_BINS = 20


def proportions(episodes: DataFrame) -> DataFrame:
    """Per trace: episodes, tokens, share and count of each behavior, verify-to-forward ratio, positions."""
    n = F.count("*")
    is_ = lambda b: F.col("behavior") == b
    base = episodes.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    rel = F.col("position") / F.greatest(F.col("n") - 1, F.lit(1))
    return base.groupBy("item_id").agg(
        n.alias("n_episodes"), F.sum("token_count").alias("n_tokens"), *[(F.count_if(is_(b)) / n).alias(f"prop_{b}") for b in BEHAVIORS], *[F.count_if(is_(b)).alias(f"count_{b}") for b in BEHAVIORS],
        (F.count_if(is_("V")) / F.greatest(F.count_if(is_("F")), F.lit(1))).alias("vf_ratio"), F.coalesce(F.avg(F.when(is_("B"), rel)), F.lit(0.0)).alias("mean_pos_B"), F.coalesce(F.min(F.when(is_("C"), rel)), F.lit(1.0)).alias("first_conclude_pos"),
    )


def clustering(episodes: DataFrame, behavior: str = "V") -> DataFrame:
    """Per trace: population deviation over mean of the gaps between a behavior's episodes; 0 with fewer than two."""
    at = episodes.where(F.col("behavior") == behavior).withColumn("gap", F.col("position") - F.lag("position").over(Window.partitionBy("item_id").orderBy("position")))
    some = at.groupBy("item_id").agg((F.stddev_pop("gap") / F.avg("gap")).alias("clustering"))
    return episodes.select("item_id").distinct().join(some, "item_id", "left").select("item_id", F.coalesce("clustering", F.lit(0.0)).alias("clustering"))


def longest_run(episodes: DataFrame, behavior: str = "F") -> DataFrame:
    """Per trace: most consecutive episodes of a behavior, by gaps and islands."""
    island = F.col("position") - F.row_number().over(Window.partitionBy("item_id").orderBy("position"))
    runs = episodes.where(F.col("behavior") == behavior).withColumn("island", island).groupBy("item_id", "island").agg(F.count("*").alias("n"))
    best = runs.groupBy("item_id").agg(F.max("n").alias("longest_run"))
    return episodes.select("item_id").distinct().join(best, "item_id", "left").select("item_id", F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"))


def transition_entropy(episodes: DataFrame) -> DataFrame:
    """Per trace, in bits: entropy of the next behavior, (a) rows weighted, (b) rows alike, (c) of pairs jointly."""
    pairs = episodes.withColumn("to", F.lead("behavior").over(Window.partitionBy("item_id").orderBy("position"))).where("to IS NOT NULL").groupBy("item_id", F.col("behavior").alias("from"), "to").agg(F.count("*").alias("n"))
    row = Window.partitionBy("item_id", "from")
    p = F.col("n") / F.sum("n").over(row)
    rows = pairs.withColumn("h", -p * F.log2(p)).groupBy("item_id", "from").agg(F.sum("h").alias("h"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    total = F.sum("n")
    some = rows.groupBy("item_id").agg((F.sum(F.col("h") * F.col("n")) / total).alias("h_weighted"), F.avg("h").alias("h_mean"), (F.log2(total) - F.sum("nlogn") / total).alias("h_joint"))
    zero = F.lit(0.0)
    return episodes.select("item_id").distinct().join(some, "item_id", "left").select("item_id", *[F.coalesce(c, zero).alias(c) for c in ("h_weighted", "h_mean", "h_joint")])


def distribution(episodes: DataFrame) -> DataFrame:
    """Corpus distribution of behaviors, per group and in all (grp null)."""
    counts = episodes.rollup("behavior", "grp").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    share = Window.partitionBy("grp", F.col("g"))
    return counts.where(F.col("g").isin(0, 1)).withColumn("share", F.col("n") / F.sum("n").over(share)).select("behavior", "grp", "n", "share")


def filtered(seq: Column) -> Column:
    """The sequence without characters outside the alphabet."""
    return F.regexp_replace(seq, f"[^{''.join(BEHAVIORS)}]", "")


def ngrams(seq: Column, n: int) -> Column:
    """All contiguous n-grams, in order; none for shorter sequences."""
    return F.when(F.char_length(seq) >= n, F.transform(F.sequence(F.lit(1), F.char_length(seq) - (n - 1)), lambda i: F.substring(seq, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gram_features(sequences: DataFrame, vocabulary: list[str], prefix: str) -> DataFrame:
    """Count and rate columns of every gram of a fixed vocabulary (grams of one length)."""
    n = len(vocabulary[0])
    out = sequences.withColumn("_g", ngrams(F.col("seq"), n))
    size = F.greatest(F.char_length("seq") - (n - 1), F.lit(1))
    count = lambda g: F.size(F.filter("_g", lambda x: x == g))
    return out.select("item_id", *[c for g in vocabulary for c in (count(g).cast("double").alias(f"{prefix}_{g}_count"), (count(g) / size).alias(f"{prefix}_{g}_rate"))])


def motif_flags(sequences: DataFrame, vocabulary: list[str]) -> DataFrame:
    """1 where a trace holds the gram."""
    return sequences.select("item_id", *[F.contains("seq", F.lit(g)).cast("double").alias(f"rare_{g}") for g in vocabulary])


def motif_positions(sequences: DataFrame, motifs: tuple[str, ...] = POSITION_MOTIFS) -> DataFrame:
    """Sum of (place / length) over all, also overlapping, occurrences of each motif."""
    length = F.greatest(F.char_length("seq"), F.lit(1))

    def weight(m: str) -> Column:
        at = F.sequence(F.lit(1), F.char_length("seq") - (len(m) - 1))
        total = F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.when(F.substring(F.col("seq"), i, F.lit(len(m))) == m, i / length).otherwise(0.0))
        return F.when(F.char_length("seq") >= len(m), total).otherwise(0.0)

    return sequences.select("item_id", *[weight(m).alias(f"pos_{m}") for m in motifs])


def vocabulary(sequences: DataFrame, n: int = 3, top: int = 50, rare: int = 20, rare_share: float = 0.05) -> DataFrame:
    """(gram, freq, docs, kind, rank): the most frequent grams, and the rarest among those of few traces; ties by gram."""
    total = sequences.agg(F.count("*").alias("n_traces"))
    grams = sequences.select("item_id", F.explode(ngrams(F.col("seq"), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"), F.countDistinct("item_id").alias("docs"))
    # at most |alphabet| ** n grams stand in one window
    many = grams.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "gram"))).where(F.col("rank") <= top).withColumn("kind", F.lit("top"))
    few = grams.crossJoin(F.broadcast(total)).where(F.col("docs") < F.col("n_traces") * rare_share).drop("n_traces").withColumn("rank", F.row_number().over(Window.orderBy("freq", "gram"))).where(F.col("rank") <= rare).withColumn("kind", F.lit("rare"))
    return many.unionByName(few).select("gram", "freq", "docs", "kind", F.col("rank").cast("long").alias("rank"))


def burstiness(mean: Column, sd: Column, n: Column) -> Column:
    """(sd - mean) / (sd + mean); -1 with fewer than two intervals."""
    return F.when(F.coalesce(n, F.lit(0)) < 2, -1.0).when(sd + mean <= 1e-12, 0.0).otherwise((sd - mean) / (sd + mean))


def behavior_timing(episodes: DataFrame) -> DataFrame:
    """Per trace and behavior of the alphabet: count, first and last place, mean and deviation of gaps, burstiness; -1 where unknown."""
    sizes = episodes.groupBy("item_id").agg(F.count("*").alias("len"))
    grid = sizes.withColumn("behavior", F.explode(F.array(*map(F.lit, BEHAVIORS))))
    gaps = episodes.withColumn("gap", F.col("position") - F.lag("position").over(Window.partitionBy("item_id", "behavior").orderBy("position")))
    some = gaps.groupBy("item_id", "behavior").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.count("gap").alias("n_gaps"))
    place = lambda c: F.when(F.col("n").isNull(), -1.0).when(F.col("len") > 1, F.col(c) / (F.col("len") - 1)).otherwise(0.0)
    return grid.join(some, ["item_id", "behavior"], "left").select(
        "item_id", "behavior", F.coalesce("n", F.lit(0)).cast("long").alias("n"), place("first").alias("first_pos"), place("last").alias("last_pos"),
        F.coalesce("mean", F.lit(-1.0)).alias("iei_mean"), F.when(F.col("n_gaps") > 0, F.col("sd")).otherwise(-1.0).alias("iei_sd"), burstiness(F.col("mean"), F.col("sd"), F.col("n_gaps")).alias("burstiness"),
    )


def wide_timing(long: DataFrame) -> DataFrame:
    """One row per trace from ``behavior_timing``, columns by behavior."""
    stats = ("n", "first_pos", "last_pos", "iei_mean", "iei_sd", "burstiness")
    wide = long.groupBy("item_id").pivot("behavior", list(BEHAVIORS)).agg(*[F.first(s).alias(s) for s in stats])
    return wide.select("item_id", *[F.col(f"{b}_{s}").alias(f"t_{s}_{b}") for b in BEHAVIORS for s in stats])


def global_timing(episodes: DataFrame) -> DataFrame:
    """Per trace: mean and deviation of the token gaps, entropy of their 20-bin histogram, rate of behavior changes."""
    w = Window.partitionBy("item_id").orderBy("position")
    rows = episodes.withColumns({"next": F.lead("position").over(w), "changed": (F.col("behavior") != F.lag("behavior").over(w)).cast("long"), "len": F.count("*").over(Window.partitionBy("item_id"))})
    gap = F.when(F.col("next").isNotNull(), F.col("token_count").cast("double"))
    rows = rows.withColumn("gap", gap)
    all_ = Window.partitionBy("item_id")
    rows = rows.withColumns({"low": F.min("gap").over(all_), "high": F.max("gap").over(all_)})
    last = HISTOGRAM_BINS - 1
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.lit(last), F.floor((F.col("gap") - F.col("low")) / ((F.col("high") - F.col("low")) / HISTOGRAM_BINS)).cast("int"))).otherwise(0)
    stats = rows.groupBy("item_id").agg(F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.sum("changed").alias("changes"), F.max("len").alias("len"), F.sum("gap").alias("total"))
    bins = rows.where("gap IS NOT NULL").groupBy("item_id", bin_.alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("item_id"))
    entropy = bins.withColumn("h", -p * F.log(p)).groupBy("item_id").agg((F.sum("h") / F.log(F.lit(float(HISTOGRAM_BINS)))).alias("entropy"))
    zero = F.lit(0.0)
    return stats.join(entropy, "item_id", "left").select(
        "item_id", F.coalesce("mean", zero).alias("iei_mean"), F.coalesce("sd", zero).alias("iei_sd"), F.when(F.col("total") > 0, F.coalesce("entropy", zero)).otherwise(0.0).alias("iei_entropy"),
        F.when(F.col("len") > 1, F.col("changes") / (F.col("len") - 1)).otherwise(0.0).alias("transition_rate"),
    )
