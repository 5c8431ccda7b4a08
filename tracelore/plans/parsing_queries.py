"""Queries that parse and score texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.functions import answers as A
from tracelore.functions.patterns import LEGACY
from tracelore.operators import parsing as P
from tracelore.plans.evaluation_queries import rounded
from tracelore.plans.registry import query, table


def _q(p: str) -> str:
    return p.replace("'", "''")


_LEGACY = "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i){_q('|'.join(f'(?:{p})' for p in ps))}') THEN '{b}'" for b, ps in LEGACY.items()) + " ELSE 'F' END"


@query(f"""SELECT doc_id, i - 1 AS line, {_LEGACY} AS behavior FROM (SELECT doc_id, i, lower(l) AS s FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))""")
def legacy_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    return d.select("doc_id", F.col("line").cast("long").alias("line"), P.classify_legacy(F.col("text")).alias("behavior"))


@query()
def parsed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven classes over all turns; the segmenter has lookarounds, so there is no SQL."""
    return P.parse(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])


@query()
def parsed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six classes over all documents, one row each."""
    return rounded(P.summary(P.parse(table(spark, sf_dir, "documents"), "text", ["doc_id"], "six"), ["doc_id"]))


_PARTS = """string_split(regexp_replace(trim(line), '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"""


@query(f"""WITH l AS (SELECT conv_id, turn, unnest(string_split_regex(coalesce(text, ''), '\n+')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\n+'), 1) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, unnest({_PARTS}) AS part, generate_subscripts({_PARTS}, 1) AS j FROM l),
t AS (SELECT conv_id, turn, trim(part) AS text, lower(trim(part)) AS s, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) - 1)::INT AS position FROM p WHERE trim(part) <> '')
SELECT conv_id, turn, position, text, {_LEGACY} AS behavior FROM t""")
def parsed_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_legacy(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])


_TAGGED = "CASE turn % 3 WHEN 0 THEN '<think>' || text || '</think> ' || role WHEN 1 THEN text || '</think>' || role ELSE text END"


@query(f"""WITH c AS (SELECT conv_id, turn, {_TAGGED} AS t FROM conversations)
SELECT conv_id, turn, trim(CASE WHEN contains(t, '<think>') THEN regexp_extract(t, '(?s)<think>(.*?)</think>', 1) WHEN contains(t, '</think>') THEN split_part(t, '</think>', 1) ELSE '' END, ' ' || chr(9) || chr(10) || chr(13)) AS trace,
trim(CASE WHEN contains(t, '</think>') THEN split_part(t, '</think>', 2) ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM c""")
def think_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", F.expr(_TAGGED))
    return c.select("conv_id", "turn", A.think_block(F.col("t")).alias("b")).select("conv_id", "turn", "b.trace", "b.answer")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN (['A','B','C','D'])[event_id % 3 + 1] WHEN 1 THEN (['A','B','C','D'])[event_id % 4 + 1] WHEN 2 THEN 'D' ELSE 'A' END AS letter,
CASE event_id % 2 WHEN 0 THEN floor(value * 100)::BIGINT::VARCHAR ELSE event_id::VARCHAR END AS number FROM events""")
def extracted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices and numbers in sentences made from events."""
    e = table(spark, sf_dir, "events")
    letter = lambda n: F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("event_id") % n + 1).cast("int"))
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, F.concat(F.lit("So the answer is ("), letter(3), F.lit(")."))).when(kind == 1, F.concat(F.lit("Thinking it over:\n"), letter(4))).when(kind == 2, F.lit(r"Hence \boxed{D}")).otherwise(F.lit("Only a remains"))
    number = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("steps 1, 2\n#### "), F.format_number(F.floor(F.col("value") * 100), 0))).otherwise(F.concat(F.lit("from 3 to "), F.col("event_id").cast("string")))
    return e.select("event_id", A.native_choice(said).alias("letter"), A.native_after_marks(number).alias("number"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS kind, l_quantity::BIGINT AS q, l_partkey % 50 + 1 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE kind WHEN 1 THEN q % 4 = t % 4 ELSE q = t END AS is_correct, CASE kind WHEN 0 THEN q::VARCHAR WHEN 1 THEN (['A','B','C','D'])[q % 4 + 1] ELSE '\\frac{' || q || '}{4}' END AS extracted_answer,
CASE kind WHEN 0 THEN 'numeric_equiv' WHEN 1 THEN 'mc_letter_match' ELSE 'math_equiv' END AS comparison_method FROM a""")
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from lineitem rows against made-up truths: a third each numbers after a mark, choices, and fractions against decimals."""
    li = table(spark, sf_dir, "lineitem")
    kind, q, t = F.col("l_linenumber") % 3, F.col("l_quantity").cast("long"), F.col("l_partkey") % 50 + 1
    letter = lambda x: F.element_at(F.array(*map(F.lit, "ABCD")), (x % 4 + 1).cast("int"))
    answer = F.when(kind == 0, F.concat(F.lit("Therefore, the answer is "), q.cast("string"), F.lit("."))).when(kind == 1, F.concat(F.lit("I choose ("), letter(q), F.lit(")."))).otherwise(F.concat(F.lit("So $x$ is \\boxed{\\frac{"), q.cast("string"), F.lit("}{4}}.")))
    decimal = F.concat(F.floor(t * 25 / 100).cast("string"), F.lit("."), F.lpad((t * 25 % 100).cast("string"), 2, "0"))
    truth = F.when(kind == 0, F.concat(F.lit("steps\n#### "), t.cast("string"))).when(kind == 1, letter(t)).otherwise(decimal)
    name = F.element_at(F.array(F.lit("exact_match_numeric"), F.lit("multiple_choice"), F.lit("exact_match_math")), (kind + 1).cast("int"))
    s = A.score_answer(answer, truth, name, F.when(kind == 0, "gsm8k"))
    return li.select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.is_correct", "s.extracted_answer", "s.comparison_method")
