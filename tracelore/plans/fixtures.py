"""Logical inputs of the trace operators, built from the tables of a data folder.

Each has a DataFrame form and a SQL form (a common table expression) of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelore.plans.registry import table

#: The behavior alphabet.
BEHAVIORS = ("F", "V", "B", "R", "S", "H", "C")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, y, grp, position, behavior, token_count, confidence): one trace per user, one episode per event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    kind = F.col("event_type")
    behavior = (
        F.when((kind == "click") & (F.col("event_id") % 7 == 0), "S").when(kind == "click", "F")
        .when((kind == "view") & (F.col("event_id") % 11 == 0), "R").when(kind == "view", "V")
        .when(kind == "error", "B").when(kind == "signup", "H").otherwise("C")
    )
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("item_id"), (F.col("user_id") % 2).alias("y"), (F.col("user_id") % 4).alias("grp"), position.cast("long").alias("position"), behavior.alias("behavior"),
        (F.floor("value") + 1).cast("long").alias("token_count"), F.element_at(F.array(F.lit(0.5), F.lit(0.7), F.lit(1.0)), (F.col("event_id") % 3 + 1).cast("int")).alias("confidence"), F.col("value"),
    )


EPISODES = """ep AS (SELECT user_id AS item_id, user_id % 2 AS y, user_id % 4 AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position,
  CASE WHEN event_type = 'click' AND event_id % 7 = 0 THEN 'S' WHEN event_type = 'click' THEN 'F' WHEN event_type = 'view' AND event_id % 11 = 0 THEN 'R'
    WHEN event_type = 'view' THEN 'V' WHEN event_type = 'error' THEN 'B' WHEN event_type = 'signup' THEN 'H' ELSE 'C' END AS behavior,
  (1 + floor(value))::BIGINT AS token_count, [0.5::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE][event_id % 3 + 1] AS confidence, value FROM events)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, y, grp, seq): the trace as a string of behaviors."""
    return episodes(spark, sf_dir).groupBy("item_id", "y", "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "behavior"))), lambda x: x.getField("behavior")), "").alias("seq"))


SEQUENCES = EPISODES + ",\nsq AS (SELECT item_id, y, grp, string_agg(behavior, '' ORDER BY position) AS seq FROM ep GROUP BY item_id, y, grp)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, grp, y, p_a, p_b): two models' held-out probabilities, from labelled documents."""
    d, y = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(y, "doc_id").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("grp"), F.col("quality").cast("int").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p_a"), ((F.col("doc_id") * 37 % 101) / 101.0).alias("p_b"))


PREDICTIONS = """pr AS (SELECT d.doc_id AS item_id, lang AS grp, quality::INT AS y, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS p_a, (d.doc_id * 37 % 101) / 101.0::DOUBLE AS p_b
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, grp, y, p): a large table of predictions, from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("grp"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("p"))


ORDER_PREDICTIONS = """op AS (SELECT o_orderkey AS item_id, o_orderpriority AS grp, (o_orderstatus = 'F')::INT AS y, least(1.0::DOUBLE, o_totalprice / 500000.0::DOUBLE) AS p FROM orders)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, step, behavior, v): unit step embeddings, ten to a trace."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return e.select(F.floor(F.col("vec_id") / 10).alias("item_id"), (F.col("vec_id") % 10).alias("step"), F.element_at(F.array(*map(F.lit, BEHAVIORS)), (F.col("vec_id") % 7 + 1).cast("int")).alias("behavior"), v.alias("raw"), norm.alias("norm")).select("item_id", "step", "behavior", F.transform("raw", lambda x: x / F.greatest("norm", F.lit(1e-12))).alias("v"))


STEPS = """st AS (SELECT vec_id // 10 AS item_id, vec_id % 10 AS step, ['F','V','B','R','S','H','C'][vec_id % 7 + 1] AS behavior,
  list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings)"""
