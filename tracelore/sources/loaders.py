"""Question sets as items of one form: competition problems, word problems, and questions with choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is asked for after the choices of a question.
ONE_OF_FOUR = "Please reason step by step and provide your final answer as a single letter (A, B, C, or D)."
ONE_LETTER = "Please reason step by step and provide your final answer as a single letter."


def lettered(choices: Column) -> Column:
    """Choices on lines of their own, each after its letter in brackets."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("("), F.char(F.lit(65) + i), F.lit(") "), c)), "\n")


def _items(rows: DataFrame, name: str, prefix: str, kind: str, extraction: str | None, order: str, problem: str, truth: Column, prompt: Column, metadata: Column) -> DataFrame:
    # a question set has thousands of rows at most, so that they may be numbered in one window
    place = F.lpad((F.row_number().over(Window.orderBy(order)) - 1).cast("string"), 4, "0")
    return rows.select(
        F.concat(F.lit(f"{prefix}_"), place).alias("item_id"), F.lit(name).alias("dataset"), F.col(problem).alias("problem"), truth.alias("ground_truth"), F.lit(kind).alias("answer_type"),
        F.lit(extraction).cast("string").alias("answer_extraction"), prompt.alias("prompt"), metadata.alias("metadata"),
    )


def competition(rows: DataFrame, order: str) -> DataFrame:
    """(problem, answer, level, subject): the answer is compared as mathematics."""
    about = F.create_map(F.lit("level"), F.coalesce(F.col("level").cast("string"), F.lit("unknown")), F.lit("subject"), F.coalesce("subject", F.lit("unknown")))
    return _items(rows, "math500", "math500", "exact_match_math", None, order, "problem", F.col("answer"), F.col("problem"), about)


def word_problems(rows: DataFrame, order: str) -> DataFrame:
    """(question, answer): the answer's number stands after a mark."""
    return _items(rows, "gsm8k", "gsm8k", "exact_match_numeric", "gsm8k", order, "question", F.col("answer"), F.col("question"), F.create_map().cast("map<string,string>"))


def shuffled_choices(rows: DataFrame, order: str, seed: int = 42) -> DataFrame:
    """(question, correct, wrong array<string>, subdomain): blank choices go, the others stand in the order of a hash of seed, question and choice."""
    some = F.filter(F.concat(F.array("correct"), "wrong"), lambda c: F.trim(c) != "")
    keyed = F.transform(some, lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "question", c).cast("binary")).alias("h"), c.alias("c")))
    rows = rows.withColumn("_choices", F.transform(F.array_sort(keyed), lambda x: x.getField("c")))
    place = F.array_position("_choices", F.col("correct")).cast("int")
    truth = F.when(place > 0, F.char(F.lit(64) + place)).otherwise("A")
    prompt = F.concat("question", F.lit("\n\nChoices:\n"), lettered(F.col("_choices")), F.lit(f"\n\n{ONE_OF_FOUR}"))
    about = F.create_map(F.lit("subdomain"), F.coalesce("subdomain", F.lit("unknown")), F.lit("correct_answer_text"), F.col("correct"))
    return _items(rows, "gpqa_diamond", "gpqa", "multiple_choice", None, order, "question", truth, prompt, about)


def choice_questions(rows: DataFrame, order: str) -> DataFrame:
    """(question, choices array<string>, answer_key): keys 1 to 4 are letters A to D."""
    key = F.col("answer_key")
    truth = F.when(key.isin("1", "2", "3", "4"), F.char(F.lit(64) + F.when(key.isin("1", "2", "3", "4"), key).cast("int"))).otherwise(key)
    prompt = F.concat("question", F.lit("\n\n"), lettered(F.col("choices")), F.lit(f"\n\n{ONE_LETTER}"))
    return _items(rows, "arc_challenge", "arc", "multiple_choice", None, order, "question", truth, prompt, F.create_map(F.lit("choices"), F.to_json("choices")))


LOADERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"math500": competition, "gsm8k": word_problems, "gpqa_diamond": shuffled_choices, "arc_challenge": choice_questions}


def load(name: str, rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The items of a question set by its name, numbered in the stated order; the first ``limit`` of them if that is given."""
    if name not in LOADERS:
        raise ValueError(f"unknown question set: {name}; there are {sorted(LOADERS)}")
    items = LOADERS[name](rows, order)
    return items if limit is None else items.orderBy("item_id").limit(limit)
