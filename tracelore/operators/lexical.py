"""Surface statistics of texts: cue densities, repetition, keyword coverage, hedges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cue words and patterns, matched without regard to case.
WAIT_WORDS = ("wait", "hmm", "hmmm", "hmmmm", "uh", "um", "well")
MAYBE = r"\b(maybe|perhaps|possibly|might|could be|probably)\b"
VERIFY = r"\b(verify|verified|verif(?:ying|ication)|check(?:ed|ing)?|let me (?:verify|check|confirm|re-?check)|double.?check(?:ed|ing)?|confirm(?:ed|ing)?)\b"
ACTUALLY = r"\b(actually|but actually|wait actually|in fact|on second thought)\b"
NEGATION = r"\b(?:no|not|wrong|incorrect|error|mistake|can't|cannot|don't|doesn't|isn't|won't|wouldn't|shouldn't)\b"
HEDGES = r"\bmaybe\b|\bperhaps\b|\bpossibly\b|\bi\s+think\b|\bi\s+guess\b|\bi\s+believe\b|\bnot\s+sure\b|\bmight(?:\s+be)?\b|\bcould\s+be\b|\bsomewhat\b|\bprobably\b|\bpresumably\b|\bseems?\s+(?:like|to|that)\b|\bappears?\s+(?:to|that)\b"
#: Function words that keyword coverage ignores.
STOP_WORDS = (
    "a an and are as at be but by do does for from had has have he her his i if in into is it its me my no not of on or our out she so than that the their "
    "them then there these they this those to was we were what when where which while who why will with would you your can could should just some any all "
    "over such one two three new like more most also may might must shall"
).split()


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def four_gram_repetition(words: Column) -> Column:
    """Share of 4-grams that repeat an earlier one; 0 under four words."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 4), lambda i: F.concat_ws(" ", F.slice(words, i + 1, 4)))
    return F.when(F.size(words) >= 4, 1 - F.size(F.array_distinct(grams)) / (F.size(words) - 3)).otherwise(0.0)


def cue_densities(texts: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """Seven densities per word of each text; zeros for null, empty and blank texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = texts.select(key, t.alias("t"), tokens(t).alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    count = lambda pattern: F.regexp_count("t", F.lit("(?i)" + pattern)) / n
    wait = F.size(F.filter("w", lambda x: F.btrim(x, F.lit(".,!?;:'\"")).isin(*WAIT_WORDS)))
    return rows.select(
        key, (wait / n).alias("wait_density"), count(MAYBE).alias("maybe_density"), count(VERIFY).alias("verify_density"), count(ACTUALLY).alias("actually_density"), count(NEGATION).alias("negation_density"),
        ((F.char_length("t") - F.char_length(F.translate("t", "?", ""))) / n).alias("question_mark_rate"), four_gram_repetition(F.col("w")).alias("repetition_rate_4gram"), F.size("w").cast("long").alias("n_tokens"),
    )


def cue_counts(texts: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """The undivided form: share of wait words, and counts of question marks and negations."""
    d = cue_densities(texts, text, key)
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    return d.select(key, F.col("wait_density").alias("wait_ratio"), F.round(F.col("question_mark_rate") * n).alias("question_mark_count"), F.round(F.col("negation_density") * n).alias("negation_count"), "repetition_rate_4gram")


def keywords(text: Column) -> Column:
    """Distinct words of four letters or more that start with a letter, without function words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9]{3,}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def keyword_coverage(pairs: DataFrame, problem: str, trace: str) -> Column:
    """Share of the problem's keywords that the trace has; 0 without keywords."""
    p, t = keywords(F.col(problem)), keywords(F.col(trace))
    return F.when(F.size(p) > 0, F.size(F.array_intersect(p, t)) / F.size(p)).otherwise(0.0)


def hedge_verify(texts: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """Hedges, verifications, their ratio, whether there is no hedge, and the ratio as a confidence."""
    t = F.coalesce(F.col(text), F.lit(""))
    h, v = F.regexp_count(t, F.lit("(?i)" + HEDGES)), F.regexp_count(t, F.lit("(?i)" + VERIFY))
    rows = texts.select(key, h.cast("long").alias("hedge_count"), v.cast("long").alias("verify_count"))
    ratio = F.col("hedge_count") / (F.col("verify_count") + 1.0)
    return rows.withColumn("hvr", ratio).withColumns({"zero_hedge": (F.col("hedge_count") == 0).cast("int"), "confidence": 1 / (1 + F.col("hvr"))})


def zero_hedge_rule(rows: DataFrame, y: str) -> DataFrame:
    """Coverage, precision and lift of accepting texts without a hedge."""
    none = F.col("zero_hedge") == 1
    out = rows.agg(F.count("*").alias("n"), F.count_if(none).alias("n_accept"), F.avg(F.when(none, F.col(y).cast("double"))).alias("precision"), F.avg(F.col(y).cast("double")).alias("base_accuracy"))
    return out.select("n_accept", (F.col("n_accept") / F.col("n")).alias("coverage"), "precision", "base_accuracy", (F.col("precision") - F.col("base_accuracy")).alias("lift"))


def content_words(text: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b\w{3,}\b"), F.lit(0))), F.array(*map(F.lit, stop)))


#: Function words of the cycle counts; the second list is the longer one.
CYCLE_STOP_21 = "the and for that this with are was has have not from but can will get let now its our also".split()
CYCLE_STOP_31 = [*CYCLE_STOP_21, *"into than then them they their there which when what".split()]


def lexical_cycles(episodes: DataFrame, corrections: tuple[str, ...], stop: list[str], min_gap: int = 3, overlap: float = 0.30) -> DataFrame:
    """Per trace: episodes whose words a later one shares, with a correction strictly between; (item_id, position, behavior, text)."""
    from pyspark.sql import Window

    w = Window.partitionBy("item_id").orderBy("position")
    fix = F.col("behavior").isin(*corrections).cast("long")
    s = episodes.select("item_id", "position", content_words(F.col("text"), stop).alias("w"), (F.sum(fix).over(w)).alias("c"), fix.alias("own"))
    s = s.where(F.size("w") > 0)
    a, b = s.select("item_id", F.col("position").alias("i"), F.col("w").alias("wi"), F.col("c").alias("ci")), s.select("item_id", F.col("position").alias("j"), F.col("w").alias("wj"), (F.col("c") - F.col("own")).alias("cj"))
    near = F.size(F.array_intersect("wi", "wj")) / F.size(F.array_union("wi", "wj")) >= overlap
    hit = a.join(b, "item_id").where((F.col("j") >= F.col("i") + min_gap) & (F.col("cj") > F.col("ci")) & near)
    found = hit.groupBy("item_id").agg(F.countDistinct("i").alias("cycle_count"))
    return episodes.select("item_id").distinct().join(found, "item_id", "left").select("item_id", F.coalesce("cycle_count", F.lit(0)).cast("long").alias("cycle_count"))
