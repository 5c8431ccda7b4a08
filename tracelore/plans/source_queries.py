"""Queries that write tables in the formats of sources and sinks and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelore.operators import relational as R
from tracelore.plans.evaluation_queries import rounded
from tracelore.plans.fixtures import PREDICTIONS, predictions
from tracelore.plans.parsing_queries import _TAGGED
from tracelore.plans.registry import query, table
from tracelore.plans.storage import folder
from tracelore.sources import loaders, npz, records
from tracelore.streaming import episodes as S


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of JSON and back."""
    path, c = folder(spark, "jsonl"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records.write_jsonl(c, path)
    return records.read_jsonl(spark, path, c.schema).where(F.col(records.CORRUPT).isNull()).select(c.columns)


@query("""SELECT c_custkey AS item_id, c_mktsegment AS "group", CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_acctbal END AS balance, c_nationkey::DOUBLE AS nation FROM customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature family as CSV by group and back; some values are missing, some not finite."""
    path, key = folder(spark, "csv"), F.col("c_custkey")
    balance = F.when(key % 14 == 0, F.lit(float("nan"))).when(key % 7 != 0, F.col("c_acctbal"))
    records.write_csv(table(spark, sf_dir, "customer").select(key.alias("item_id"), balance.alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_mktsegment").alias("group")), path)
    return records.read_csv_family(spark, path, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("balance", T.DoubleType()), T.StructField("nation", T.DoubleType())]))


@query(f"""WITH {PREDICTIONS} SELECT grp AS "group", item_id::VARCHAR AS item_id, y AS y_true, round(p_a, 6) AS oof_prob, (item_id % 5)::INT AS oof_fold FROM pr""")
def npz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions as one archive per group and back."""
    path = folder(spark, "npz")
    rows = predictions(spark, sf_dir).select(F.col("grp").alias("group"), F.col("item_id").cast("string").alias("item_id"), F.col("y").alias("y_true"), F.col("p_a").alias("oof_prob"), (F.col("item_id") % 5).cast("int").alias("oof_fold"))
    npz.write_predictions(rows, path)
    return rounded(npz.read_predictions(spark, path))


@query("""SELECT 'label' || label AS "group", len(embedding)::INT AS dimension, count(DISTINCT vec_id // 10) AS n_items, count(*) AS n_steps FROM embeddings GROUP BY 1, 2""")
def npz_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step embeddings as one archive per label and back, by their size."""
    path, v = folder(spark, "npz-steps"), F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label"), F.col("label")).alias("group"), F.floor(v / 10).cast("string").alias("item_id"), F.lit(1).alias("is_correct"), (v % 10).cast("int").alias("step"), (v % 7).cast("int").alias("step_type"), "embedding")
    npz.write_steps(rows, path)
    return npz.by_dimension(npz.read_steps(spark, path))


_METRICS = "SELECT o_orderpriority AS dataset, 'b' || o_custkey % 3 AS baseline, 'c' || o_orderkey % 4 AS classifier, round(avg(o_totalprice) / 600000, 6) AS value FROM orders GROUP BY 1, 2, 3"


@query(f"SELECT dataset, baseline, arg_min(classifier, (-value, classifier)) AS classifier, max(value) AS value FROM ({_METRICS}) GROUP BY 1, 2")
def best_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as nested JSON, one line per data set, read again for the best classifier of each baseline."""
    path = folder(spark, "results")
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.concat(F.lit("b"), F.col("o_custkey") % 3).alias("baseline"), F.concat(F.lit("c"), F.col("o_orderkey") % 4).alias("classifier")).agg(F.round(F.avg("o_totalprice") / 600000, 6).alias("value"))
    records.write_results(m.withColumn("metric", F.lit("auroc_mean")), path)
    return records.best_classifiers(records.read_results(spark, path))


@query("SELECT n_nationkey, n_name FROM nation")
def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped after some rows, and one that adds the rest."""
    path, n = folder(spark, "append"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    records.append_new(n.where("n_nationkey < 9"), path, ["n_nationkey"])
    records.append_new(n, path, ["n_nationkey"])
    return spark.read.parquet(path)


@query("""SELECT n_nationkey, 'r' || n_regionkey AS "group", CASE WHEN n_regionkey <= 2 THEN 1 ELSE 2 END AS run FROM nation""")
def kept_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family built in two runs: groups that are there already stay as they are."""
    path = folder(spark, "family")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("r"), F.col("n_regionkey")).alias("group"))
    records.write_family(n.where("n_regionkey <= 2").select("n_nationkey", "group", F.lit(1).alias("run")), path)
    records.write_family(n.select("n_nationkey", "group", F.lit(2).alias("run")), path)
    return spark.read.parquet(path)


@query(f"""WITH c AS (SELECT conv_id, turn, {_TAGGED} AS t, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS given, text FROM conversations),
x AS (SELECT *, length(given) <= 10 AS short, trim(CASE WHEN contains(t, '<think>') THEN regexp_extract(t, '(?s)<think>(.*?)</think>', 1) WHEN contains(t, '</think>') THEN split_part(t, '</think>', 1) ELSE '' END, ' ' || chr(9) || chr(10) || chr(13)) AS trace FROM c)
SELECT conv_id, turn, CASE WHEN short THEN trace ELSE given END AS reasoning_trace, CASE WHEN short THEN length(trace) ELSE -1 END::BIGINT AS trace_length FROM x""")
def repaired_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose trace is short get it from the full response."""
    c = table(spark, sf_dir, "conversations").withColumn("full_response", F.expr(_TAGGED))
    c = c.select("conv_id", "turn", "full_response", F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")).alias("reasoning_trace"), F.lit("").alias("answer_text"), F.lit(-1).cast("long").alias("trace_length"), F.lit(0).cast("long").alias("trace_token_count"))
    return records.repaired(c).select("conv_id", "turn", "reasoning_trace", F.col("trace_length").cast("long").alias("trace_length"))


@query("SELECT doc_id, text FROM documents WHERE trim(coalesce(text, '')) <> ''")
def usable_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("reasoning_trace"), F.col("text").alias("full_response"))
    return records.usable_traces(d).select("doc_id", "text")


@query("""WITH n AS (SELECT r_regionkey, r_name, list(n_name ORDER BY n_name) AS c FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT 'arc_' || lpad((row_number() OVER (ORDER BY r_regionkey) - 1)::VARCHAR, 4, '0') AS item_id, r_name AS problem, chr(65 + (r_regionkey % 4)::INT) AS ground_truth,
r_name || chr(10) || chr(10) || list_aggregate(list_transform(c, lambda x, i: '(' || chr(64 + i::INT) || ') ' || x), 'string_agg', chr(10)) || chr(10) || chr(10) || 'Please reason step by step and provide your final answer as a single letter.' AS prompt FROM n""")
def loaded_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as questions, their nations as choices, the right one given by number."""
    n = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    q = n.groupBy("r_regionkey", F.col("r_name").alias("question")).agg(F.array_sort(F.collect_list("n_name")).alias("choices")).withColumn("answer_key", (F.col("r_regionkey") % 4 + 1).cast("string"))
    return loaders.load("arc_challenge", q, "r_regionkey").select("item_id", "problem", "ground_truth", "prompt")


@query("""SELECT 'math500_' || lpad((row_number() OVER (ORDER BY item_id) - 1)::VARCHAR, 4, '0') AS item_id, 'math500' AS dataset, text AS problem, item_id::VARCHAR AS ground_truth, 'exact_match_math' AS answer_type, text AS prompt FROM benchmark""")
def loaded_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), F.col("text").alias("problem"), F.col("item_id").cast("string").alias("answer"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("subject"))
    return loaders.load("math500", b, "place").select("item_id", "dataset", "problem", "ground_truth", "answer_type", "prompt")


@query("""SELECT f AS file, regexp_replace(regexp_extract(f, '([^/]*)\\.[a-z]+$', 1), '(_traces|_parsed|_features)+$', '') AS "group" FROM (SELECT 'data/' || lower(p_brand) || '_m' || p_size % 2 || (['_traces', '_parsed', '_features', ''])[p_size % 4 + 1] || '.jsonl' AS f FROM part) GROUP BY 1""")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of groups from names of files."""
    end = F.element_at(F.array(*map(F.lit, ("_traces", "_parsed", "_features", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    f = table(spark, sf_dir, "part").select(F.concat(F.lit("data/"), F.lower("p_brand"), F.lit("_m"), (F.col("p_size") % 2).cast("string"), end, F.lit(".jsonl")).alias("file")).distinct()
    return f.select("file", R.strip_suffixes(F.col("file"), list(records.SUFFIXES)).alias("group"))


@query("""SELECT subset, "column" FROM (VALUES ('all', ['hand_a', 'ng_b', 't_c', 'g_d', 'oof_e', 'h0_f']), ('oof', ['oof_e']), ('structure', ['ng_b', 't_c', 'g_d', 'h0_f']), ('no_oof', ['hand_a', 'ng_b', 't_c', 'g_d', 'h0_f']), ('hand', ['hand_a'])) v(subset, c), unnest(c) u("column")""")
def column_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of every named subset of families."""
    columns = ["hand_a", "ng_b", "t_c", "g_d", "oof_e", "h0_f", "other"]
    return spark.createDataFrame([(s, c) for s in R.SUBSETS for c in R.subset_columns(columns, s)], "subset string, column string")


@query()
def streamed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns parsed as files of them arrive; the same rows as parsed_episodes."""
    base, c = folder(spark, "parse"), table(spark, sf_dir, "conversations")
    c.write.parquet(f"{base}/in")
    S.parse_folder(spark, c.schema, f"{base}/in", f"{base}/out", f"{base}/checkpoint", ["conv_id", "turn"]).awaitTermination()
    return spark.read.parquet(f"{base}/out")
