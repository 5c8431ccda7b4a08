"""Queries that join, reshape and summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.operators import evaluation as E
from tracelore.operators import relational as R
from tracelore.operators import sequences as S
from tracelore.plans.evaluation_queries import rounded
from tracelore.plans.fixtures import EPISODES, PREDICTIONS, episodes, predictions
from tracelore.plans.registry import query, table


@query("""WITH a AS (SELECT o_custkey AS item_id, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY 1), b AS (SELECT c_custkey AS item_id, c_acctbal, c_nationkey FROM customer)
SELECT c_custkey AS item_id, c_mktsegment, n_orders, round(spend, 2) AS spend, c_acctbal, c_nationkey FROM customer c JOIN a ON a.item_id = c_custkey""")
def join_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "item_id"), table(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_custkey").alias("item_id")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return R.join_families(c.select("item_id", "c_mktsegment"), [a, c.select("item_id", "c_acctbal", "c_mktsegment", "c_nationkey")], ["item_id"])


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1), j AS (SELECT c_custkey, c_acctbal, n_orders, done FROM customer LEFT JOIN a ON k = c_custkey)
SELECT 'c_acctbal' AS "column", count(*) AS n_rows, count(c_acctbal) AS n_present FROM j UNION ALL SELECT 'n_orders', count(*), count(n_orders) FROM j UNION ALL SELECT 'done', count(*), count(done) FROM j""")
def left_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "item_id"), table(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_custkey").alias("item_id")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return R.coverage(R.join_families(c.select("item_id", "c_acctbal"), [a], ["item_id"], "left"), ["c_acctbal", "n_orders", "done"])


@query("""SELECT count(*) AS n_shared, count(*) FILTER (l.quality IS DISTINCT FROM (d.n_chars > 500)::INT) AS n_disagree FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def label_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of some documents against a rule that labels all of them by length."""
    y, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return R.label_disagreements(y.select("doc_id", F.col("quality").alias("y")), d.select("doc_id", (F.col("n_chars") > 500).cast("int").alias("y")), ["doc_id"], "y")


@query("""SELECT d.doc_id, quality AS y, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def checked_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(y, "doc_id")
    return R.checked_join(y, d, ["doc_id"], "y").select("doc_id", "y", "lang")


@query("""SELECT coalesce(a.k, b.k) AS nationkey, n_customers, n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k""")
def outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nationkey", "outer")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('en', 'de') GROUP BY source")
def semi_filter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    keep = spark.createDataFrame([("en",), ("de",)], "lang string")
    return d.join(F.broadcast(keep), "lang", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    a = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_first(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT count(*) AS n_shared, round(avg((o_orderkey % 5 = (o_orderkey + o_custkey) % 5)::INT), 6) AS agreement FROM orders")
def fold_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return rounded(R.fold_agreement(o.select("o_orderkey", (F.col("o_orderkey") % 5).alias("f")), o.select("o_orderkey", ((F.col("o_orderkey") + F.col("o_custkey")) % 5).alias("f")), ["o_orderkey"], "f"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_METRIC = "SELECT o_orderstatus AS src, o_orderpriority AS dst, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2"


@query(f"""SELECT src, {", ".join(f'''round(max(v) FILTER (dst = '{p}'), 2) AS "{p}"''' for p in _PRIORITIES)} FROM ({_METRIC}) GROUP BY src""")
def pivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("src"), F.col("o_orderpriority").alias("dst")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return R.pivot_matrix(m, "src", "dst", "v", _PRIORITIES)


def _transfer(year: str) -> str:
    return f"SELECT o_orderpriority AS src, (['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'])[o_custkey % 5 + 1] AS dst, avg(o_totalprice) / 500000 AS v FROM orders WHERE o_orderkey % 2 = {year} GROUP BY 1, 2"


@query(f"""WITH d AS (SELECT coalesce(a.src, b.src) AS src, b.v - a.v AS d FROM ({_transfer("0")}) a FULL JOIN ({_transfer("1")}) b ON a.src = b.src AND a.dst = b.dst WHERE coalesce(a.src, b.src) <> coalesce(a.dst, b.dst))
SELECT src, count(d) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(min(d), 6) AS low, round(max(d), 6) AS high, round(stddev_pop(d), 6) AS sd_pop, round(stddev_samp(d), 6) AS sd_samp FROM d GROUP BY src""")
def matrix_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("dst", F.element_at(F.array(*map(F.lit, _PRIORITIES)), (F.col("o_custkey") % 5 + 1).cast("int")))
    one = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_orderpriority").alias("src"), "dst").agg((F.avg("o_totalprice") / 500000).alias("v"))
    return rounded(R.matrix_delta(one(0), one(1), "src", "dst", "v"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""WITH m AS (SELECT l_shipdate::DATE AS day, l_returnflag AS name, round(sum(l_extendedprice), 2) AS score FROM lineitem GROUP BY 1, 2) SELECT day, arg_min(name, (-score, name)) AS best, max(score) AS best_score FROM m GROUP BY day""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("name")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return R.best_of(m, ["day"], "name", "score")


@query("""WITH t AS (SELECT event_type, value - 1 AS diff, (event_id % 100) / 100.0::DOUBLE AS p FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff > 0 AND p < 0.05) AS sig_wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff < 0 AND p < 0.05) AS sig_losses FROM t GROUP BY event_type""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 1).alias("diff"), ((F.col("event_id") % 100) / 100.0).alias("p"))
    return R.outcome_counts(t, ["event_type"], "diff", "p")


@query("""SELECT c_mktsegment, round(sum(c_acctbal * n) / sum(n), 6) AS weighted_mean FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return rounded(R.weighted_mean(table(spark, sf_dir, "customer").join(n, "c_custkey"), ["c_mktsegment"], "c_acctbal", "n"))


@query("""SELECT DISTINCT g AS grp, regexp_extract(g, '^(.*)_[^_]*$', 1) AS dataset, regexp_extract(g, '([^_]*)$', 1) AS model FROM (SELECT lower(replace(p_type, ' ', '_')) || '_m' || p_size % 2 AS g FROM part)""")
def group_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").select(F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit("_m"), (F.col("p_size") % 2).cast("string")).alias("grp")).distinct()
    a, b = R.split_group(F.col("grp"))
    return g.select("grp", a.alias("dataset"), b.alias("model"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))""")
def slice_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity"), F.grouping_id().cast("long").alias("level")))


_BINS = "SELECT *, [" + ", ".join(f"quantile_cont(n_chars, {k / 5}) OVER ()" for k in range(1, 5)) + "] AS e FROM documents"


@query(f"""SELECT doc_id, len(list_filter(e, lambda x: n_chars > x))::INT AS bin_right, len(list_filter(e, lambda x: n_chars >= x))::INT AS bin_left FROM ({_BINS})""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    right = R.quantile_bins(d, "n_chars", 5).select("doc_id", "n_chars", F.col("bin").alias("bin_right"))
    return R.quantile_bins(right, "n_chars", 5, closed="left").select("doc_id", "bin_right", F.col("bin").alias("bin_left"))


@query("""SELECT doc_id, lang, quality FROM (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY md5(d.doc_id || '|42'), d.doc_id) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE n <= 10""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return R.stratified_sample(d, ["lang", "quality"], "doc_id", 10)


_CM = "SELECT quality AS tr, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2"


@query(f"""WITH m AS ({_CM}), w AS (SELECT sum(n) AS n, sum(CASE WHEN tr = predicted THEN n ELSE 0 END) AS hit FROM m), a AS (SELECT tr AS c, sum(n) AS a FROM m GROUP BY 1), b AS (SELECT predicted AS c, sum(n) AS b FROM m GROUP BY 1),
k AS (SELECT n::BIGINT AS n, hit / n AS acc, (SELECT coalesce(sum(a * b), 0) FROM a JOIN b USING (c)) / (n * n) AS ex FROM w)
SELECT n, round(acc, 6) AS accuracy, round(ex, 6) AS expected, round(CASE WHEN ex < 1 THEN (acc - ex) / (1 - ex) ELSE 0 END, 6) AS kappa FROM k""")
def annotation_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.kappa(R.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")))


@query(f"""WITH m AS ({_CM}), t AS (SELECT tr AS label, sum(n)::BIGINT AS support, sum(CASE WHEN tr = predicted THEN n ELSE 0 END) AS tp FROM m GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS named FROM m GROUP BY 1),
j AS (SELECT label, coalesce(support, 0) AS support, coalesce(coalesce(tp, 0) / nullif(named, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM t FULL JOIN p USING (label))
SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, support FROM j""")
def annotation_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.per_class(R.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")))


@query("SELECT doc_id, (lang = 'de')::INT AS lang_de, (lang = 'en')::INT AS lang_en, (lang = 'es')::INT AS lang_es, (lang = 'fr')::INT AS lang_fr FROM documents")
def one_hot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    # one row per language
    names = [r["lang"] for r in d.where("lang IS NOT NULL").select("lang").distinct().collect()]
    return R.one_hot(d, "lang", names, "lang_").drop("lang")


@query("""WITH p AS (SELECT event_id, (event_id % 1000) / 10000.0::DOUBLE AS p, value / 3 AS lo, value / 2 AS hi FROM events)
SELECT event_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, CASE WHEN lo >= 0.65 THEN 'supported' WHEN hi < 0.65 THEN 'rejected' ELSE 'undecided' END AS verdict FROM p""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R.stars((F.col("event_id") % 1000) / 10000.0).alias("stars"), R.verdict(F.col("value") / 3, F.col("value") / 2).alias("verdict"))


@query("""SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys, round(avg(quality), 6) AS base_rate, lower(to_hex(bit_xor(('0x' || substr(sha256(doc_id || '|' || coalesce(quality::VARCHAR, '')), 1, 15))::BIGINT))) AS digest FROM labels""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.provenance(table(spark, sf_dir, "labels"), ["doc_id"], "quality"))


_FEATURES = [f"prop_{b}" for b in "FVBRSHC"] + ["vf_ratio", "mean_pos_B", "first_conclude_pos", "n_tokens"]


@query(f"""WITH {EPISODES}, b AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM ep), x AS (SELECT item_id, max(y) AS y, {", ".join(f"count(*) FILTER (behavior = '{b}') / count(*) AS prop_{b}" for b in "FVBRSHC")},
  count(*) FILTER (behavior = 'V') / greatest(count(*) FILTER (behavior = 'F'), 1) AS vf_ratio, coalesce(avg(position / greatest(n - 1, 1)) FILTER (behavior = 'B'), 0) AS mean_pos_B, coalesce(min(position / greatest(n - 1, 1)) FILTER (behavior = 'C'), 1) AS first_conclude_pos, sum(token_count)::DOUBLE AS n_tokens FROM b GROUP BY item_id),
u AS (UNPIVOT x ON {", ".join(_FEATURES)} INTO NAME feature VALUE value), s AS (SELECT feature, y, CASE WHEN hi > lo THEN (CASE WHEN feature IN ('prop_B', 'prop_H') THEN 1 - (value - lo) / (hi - lo) ELSE (value - lo) / (hi - lo) END) ELSE (CASE WHEN feature IN ('prop_B', 'prop_H') THEN 1 ELSE 0 END) END AS v
  FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM u)),
r AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rk FROM s)
SELECT feature, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auroc FROM r GROUP BY feature""")
def single_feature_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir)
    x = S.proportions(e).join(e.groupBy("item_id").agg(F.max("y").alias("y")), "item_id")
    long_ = R.scaled_features(x, ["item_id", "y"], _FEATURES, inverted=("prop_B", "prop_H"))
    return rounded(E.auroc_ci(long_, ["feature"], p="value").select("feature", "auroc"))


@query(f"""WITH {PREDICTIONS}, l AS (SELECT * FROM pr), f AS (SELECT doc_id AS item_id, quality, toxic FROM labels) SELECT item_id, grp, y, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, toxic, (row_number() OVER (PARTITION BY grp, y ORDER BY md5(item_id || '|42'), item_id) - 1)::BIGINT % 5 AS fold FROM l JOIN f USING (item_id)""")
def hybrid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two models with a feature family, canonical folds and a checked label, one row per item."""
    p = R.keep_first(predictions(spark, sf_dir), ["item_id"], ["grp"])
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("y"), "toxic")
    j = R.checked_join(p, y, ["item_id"], "y")
    return rounded(E.stratified_folds(j, ["grp", "y"], "item_id").withColumn("fold", F.col("fold").cast("long")).select("item_id", "grp", "y", "p_a", "p_b", "toxic", "fold"))
