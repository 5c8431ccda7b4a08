"""Confidence scores without training: length, perplexity, stated confidence, agreement of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelore.operators.relational import quantiles

#: How a number is stated as a confidence, of one or of ten, and how a judge states a label and a probability.
STATED, CONFIDENT, OF_TEN = r"confidence\s*(?:level\s*)?(?:is\s*)?[:=]?\s*(\d+(?:\.\d+)?)\s*[%/]?", r"i(?:'m|\s+am)\s+(\d+(?:\.\d+)?)\s*%?\s*confident", r"(\d+(?:\.\d+)?)\s*(?:/|out\s+of)\s*10"
JUDGMENT, PROBABILITY = r"(?i)judgment\s*[:=]\s*(CORRECT|INCORRECT|UNCERTAIN)", r"(?i)probability\s*[:=]\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
#: Phrases of low, high and middling confidence, in the order they are tried.
LOW = ("not confident", "not sure", "not certain", "uncertain", "unsure", "doubtful", "unlikely", "don't know", "i'm not")
HIGH = ("very confident", "highly confident", "completely certain", "absolutely certain", "definitely correct", "absolutely sure", "completely sure")
MEDIUM = ("fairly confident", "reasonably confident", "probably", "likely correct")


def length_confidence(n_tokens: Column) -> Column:
    """Falls with length around 2000 tokens; 0.5 where nothing is known."""
    return F.when(F.coalesce(n_tokens, F.lit(0)) <= 0, 0.5).otherwise(1 / (1 + F.exp(0.001 * (n_tokens - 2000.0))))


def quantile_length_confidence(rows: DataFrame, n_tokens: str) -> DataFrame:
    """The older form: 1 - length over the 99th percentile, not below 0."""
    top = quantiles(rows, n_tokens, [0.99])[0]
    return rows.withColumn("confidence", 1 - F.least(F.col(n_tokens) / F.lit(max(top, 1.0)), F.lit(1.0)))


def perplexity(mean_nll: Column) -> Column:
    """exp of the mean surprise, its exponent at most 50."""
    return F.exp(F.least(mean_nll, F.lit(50.0)))


def perplexity_confidence(ppl: Column) -> Column:
    return F.when(ppl.isNull(), 0.5).otherwise(1 / (1 + F.exp(0.2 * (ppl - 10.0))))


def stated_confidence(text: Column) -> Column:
    """What a text says of its own confidence: a number, or a phrase; 0.5 if nothing."""
    t = F.lower(F.coalesce(text, F.lit("")))
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("double")
    unit = lambda x: F.least(F.greatest(F.when(x > 1, x / 100.0).otherwise(x), F.lit(0.0)), F.lit(1.0))
    said = number(STATED)
    am = number(CONFIDENT)
    of_ten = number(OF_TEN)
    has = lambda phrases: t.rlike("|".join(phrases))
    return F.when(said.isNotNull(), unit(said)).when(am.isNotNull(), unit(am)).when(of_ten.isNotNull(), F.least(of_ten / 10.0, F.lit(1.0))).when(has(LOW), 0.3).when(has(HIGH), 0.9).when(has(MEDIUM), 0.6).otherwise(0.5)


def record_confidence(answer: Column, trace: Column) -> Column:
    """That of the answer, or where it says nothing that of the last 500 characters of the trace."""
    first = stated_confidence(answer)
    return F.when(first != 0.5, first).otherwise(stated_confidence(F.right(F.coalesce(trace, F.lit("")), F.lit(500))))


def agreement(samples: DataFrame) -> DataFrame:
    """Per item: share of the commonest answer (lower case, trimmed), and 1 - entropy of exact answers over its most; (item_id, answer)."""
    some = samples.where("answer IS NOT NULL")
    loose = some.groupBy("item_id", F.lower(F.trim("answer")).alias("a")).agg(F.count("*").alias("n")).groupBy("item_id").agg((F.max("n") / F.sum("n")).alias("self_consistency"))
    exact = some.groupBy("item_id", F.trim("answer").alias("a")).agg(F.count("*").alias("n")).groupBy("item_id").agg(F.sum("n").alias("n"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    exact = exact.select("item_id", F.when(F.col("n") <= 1, 0.5).otherwise(1 - F.col("h") / F.log2("n")).alias("semantic_confidence"))
    out = samples.select("item_id").distinct().join(loose, "item_id", "left").join(exact, "item_id", "left")
    return out.select("item_id", F.coalesce("self_consistency", F.lit(0.5)).alias("self_consistency"), F.coalesce("semantic_confidence", F.lit(0.5)).alias("semantic_confidence"))


def all_scores(records: DataFrame, samples: DataFrame | None = None, structural: DataFrame | None = None) -> DataFrame:
    """(item_id, trace_length, verbalized_confidence, perplexity, self_consistency, semantic_entropy, structural): every score of each record.

    Records have item_id, trace_token_count, answer_text, reasoning_trace and mean_log_prob;
    ``samples`` (item_id, answer) and ``structural`` (item_id, p) give the other three, which
    are null without them or for items that they lack.
    """
    out = records.select("item_id", length_confidence(F.col("trace_token_count")).alias("trace_length"), record_confidence(F.col("answer_text"), F.col("reasoning_trace")).alias("verbalized_confidence"), perplexity_confidence(perplexity(-F.col("mean_log_prob"))).alias("perplexity"))
    none = F.lit(None).cast("double")
    if samples is None:
        out = out.withColumns({"self_consistency": none, "semantic_entropy": none})
    else:
        out = out.join(agreement(samples).withColumnRenamed("semantic_confidence", "semantic_entropy"), "item_id", "left")
    if structural is None:
        return out.withColumn("structural", none)
    return out.join(structural.select("item_id", F.col("p").alias("structural")), "item_id", "left")


def judge_label(reply: Column) -> Column:
    """The label a judge's reply states, upper case; null without one."""
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(reply, F.lit("")), JUDGMENT, 1)), F.lit(""))


def judge_probability(reply: Column) -> Column:
    """The probability in [0, 1] that a judge's reply states, or that of its label; null without either."""
    p = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), PROBABILITY, 1), F.lit("")).cast("double")
    label = judge_label(reply)
    return F.when(p.between(0, 1), p).when(label == "CORRECT", 0.9).when(label == "INCORRECT", 0.1).when(label == "UNCERTAIN", 0.5)


def middle_cut(text: Column, most: int, mark: str = "\n\n[... middle truncated ...]\n\n") -> Column:
    """Head and tail of a long text around a mark, for which forty characters are set aside."""
    head = most // 2
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(most - head - 40)))).otherwise(text)
