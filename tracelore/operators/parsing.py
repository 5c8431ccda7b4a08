"""Traces to labelled episodes: segment, classify by patterns, refine by context, sum up."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.functions.classing import TABLES, labels
from tracelore.functions.patterns import ANSWER_SEVEN, ANSWER_SIX, LEGACY, PLAN
from tracelore.functions.segmenting import plain_sentences, segment


def classify(text: Column, table: str = "seven") -> Column:
    """struct(behavior, confidence, matched_pattern): the strongest class with a match, else F.

    Confidence is 1 with one class matching, 0.7 with several, 0.5 with none, 0 for blank text.
    """
    patterns = TABLES[table]

    def judge(s: Column) -> Column:
        # per class one look for any pattern; which pattern it was is asked of the winner only
        seen = F.struct(*[s.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)).alias(b) for b, ps in patterns.items()])

        def name(hits: Column) -> Column:
            winner, which = F.lit("F"), F.lit(None).cast("string")
            for b, ps in reversed(patterns.items()):
                first = F.lit(None).cast("string")
                for p in reversed(ps):
                    first = F.when(s.rlike("(?i)" + p), F.lit(p)).otherwise(first)
                hit = hits.getField(b)
                winner, which = F.when(hit, F.lit(b)).otherwise(winner), F.when(hit, first).otherwise(which)
            n = sum((hits.getField(b).cast("int") for b in patterns), F.lit(0))
            return F.struct(winner.alias("behavior"), F.when(n == 0, 0.5).when(n == 1, 1.0).otherwise(0.7).alias("confidence"), which.alias("matched_pattern"))

        return _once(seen, name)

    blank = F.struct(F.lit("F").alias("behavior"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("matched_pattern"))
    s = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return _once(s, lambda x: F.when(x == "", blank).otherwise(judge(x)))


def _once(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def classify_legacy(text: Column) -> Column:
    """The first class of the older table that matches, else F."""
    s = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("F")
    for b, ps in reversed(LEGACY.items()):
        out = F.when(s.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(b)).otherwise(out)
    return out


def refine(episodes: DataFrame, keys: list[str], table: str = "seven") -> DataFrame:
    """Labels and confidences corrected by context, rule after rule.

    A last F that looks like an answer becomes C; the middle one of three V gains confidence;
    with seven classes, a first F with little confidence that names a task becomes S, and
    traces of one episode stay as they are.
    """
    w = Window.partitionBy(*keys).orderBy("position")
    n = F.count("*").over(Window.partitionBy(*keys))
    seven = table == "seven"
    e = episodes.withColumn("_n", n)
    answer = (F.col("position") == F.col("_n") - 1) & (F.col("behavior") == "F") & F.col("text").rlike("(?i)" + (ANSWER_SEVEN if seven else ANSWER_SIX))
    if seven:
        answer = answer & (F.col("_n") > 1)
    e = e.withColumns({"behavior": F.when(answer, "C").otherwise(F.col("behavior")), "confidence": F.when(answer, 0.6).otherwise(F.col("confidence")), "matched_pattern": F.when(answer, "context:last").otherwise(F.col("matched_pattern"))})
    middle = (F.col("behavior") == "V") & (F.lag("behavior").over(w) == "V") & (F.lead("behavior").over(w) == "V") & (F.col("confidence") < 1)
    e = e.withColumn("confidence", F.when(middle, F.least(F.lit(1.0), F.col("confidence") + 0.2)).otherwise(F.col("confidence")))
    if seven:
        plan = (F.col("position") == 0) & (F.col("_n") >= 3) & (F.col("behavior") == "F") & (F.col("confidence") < 0.6) & F.col("text").rlike("(?i)" + PLAN)
        e = e.withColumns({"behavior": F.when(plan, "S").otherwise(F.col("behavior")), "confidence": F.when(plan, 0.6).otherwise(F.col("confidence")), "matched_pattern": F.when(plan, "context:first").otherwise(F.col("matched_pattern"))})
    return e.drop("_n")


def parse(traces: DataFrame, text: str, keys: list[str], table: str = "seven", least: int = 4) -> DataFrame:
    """One row per episode: keys, position, text, behavior, confidence, matched_pattern, token_count. Blank traces give none.

    Traces are cut and their sentences classified in the same worker, a batch at a time;
    the corrections by context are native.
    """
    schema = T.StructType([*(T.StructField(k, traces.schema[k].dataType) for k in keys), *EPISODE])
    rows = traces.select(*keys, text).mapInArrow(lambda batches: _episodes(batches, table, least, schema.names), schema)
    return refine(rows, keys, table)


EPISODE = [T.StructField("position", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("behavior", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("matched_pattern", T.StringType()), T.StructField("token_count", T.IntegerType())]
#: Traces whose sentences are classified at once.
TRACES = 500


def _episodes(batches: Iterator[pa.RecordBatch], table: str, least: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, len(whole), TRACES):
            batch = whole.slice(a, TRACES)
            parts = [segment(t, least) for t in batch.column(batch.num_columns - 1).to_pylist()]
            sentences = [s for part in parts for s in part]
            if not sentences:
                continue
            behavior, confidence, which = labels(sentences, table)
            row = pa.array([k for k, part in enumerate(parts) for _ in part], pa.int64())
            place = pa.array([k for part in parts for k in range(len(part))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(row) for k in range(batch.num_columns - 1)), place, pa.array(sentences, pa.string()), pa.array(behavior, pa.string()), pa.array(confidence), pa.array(which, pa.string()), pa.array([len(s.split()) for s in sentences], pa.int32())], names
            )


def parse_legacy(traces: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Episodes by the older splitter and classes, natively throughout."""
    rows = traces.select(*keys, F.posexplode(plain_sentences(F.col(text))).alias("position", "text"))
    return rows.withColumn("behavior", classify_legacy(F.col("text")))


def summary(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per trace: the sequence, episodes, label changes, mean confidence and whether each class occurs."""
    w = Window.partitionBy(*keys).orderBy("position")
    e = episodes.withColumn("_changed", (F.col("behavior") != F.lag("behavior").over(w)).cast("long"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "behavior"))), lambda x: x.getField("behavior")), "")
    return e.groupBy(*keys).agg(seq.alias("behavior_sequence"), F.count("*").alias("num_episodes"), F.coalesce(F.sum("_changed"), F.lit(0)).alias("num_behavior_changes"), F.avg("confidence").alias("mean_confidence"), *[F.max((F.col("behavior") == b).cast("int")).alias(f"has_{b}") for b in "FVBRSHCX"])


def truncated(steps: Column, first: int | None = None, last: int | None = None) -> Column:
    """The first or the last so many elements of an array."""
    return F.slice(steps, 1, first) if first else F.slice(steps, F.greatest(F.size(steps) - last + 1, F.lit(1)), F.lit(last))
