"""Queries that evaluate predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.operators import evaluation as E
from tracelore.plans.fixtures import ORDER_PREDICTIONS, PREDICTIONS, order_predictions, predictions
from tracelore.plans.registry import query, r6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else c for c, t in df.dtypes])


_SLICED = f"""{ORDER_PREDICTIONS}, sl AS (SELECT *, 'overall' AS k, 'all' AS v FROM op UNION ALL SELECT *, 'group', grp FROM op),
rk AS (SELECT k, v, y, rank() OVER (PARTITION BY k, v ORDER BY p) + (count(*) OVER (PARTITION BY k, v, p) - 1) / 2 AS tz, rank() OVER (PARTITION BY k, v, y ORDER BY p) + (count(*) OVER (PARTITION BY k, v, y, p) - 1) / 2 AS tx,
  sum(y) OVER (PARTITION BY k, v) AS m, sum(1 - y) OVER (PARTITION BY k, v) AS n FROM sl),
cp AS (SELECT k, v, y, m, n, CASE WHEN y = 1 THEN (tz - tx) / n END AS vp, CASE WHEN y = 0 THEN 1 - (tz - tx) / m END AS vn FROM rk),
au AS (SELECT k, v, max(m)::BIGINT AS n_pos, max(n)::BIGINT AS n_neg, avg(vp) AS a, coalesce(var_samp(vp), 0) / max(m) + coalesce(var_samp(vn), 0) / max(n) AS va FROM cp GROUP BY k, v)"""


@query(f"""WITH {_SLICED} SELECT k AS slice_kind, v AS slice_value, n_pos, n_neg, round(a, 6) AS auroc, round(va, 6) AS var_auroc,
round(CASE WHEN va <= 0 OR a <= 0 OR a >= 1 THEN greatest(0, a - {E.Z_975} * sqrt(va)) ELSE 1 / (1 + exp(-(ln(a / (1 - a)) - {E.Z_975} * sqrt(va) / (a * (1 - a))))) END, 6) AS ci_low,
round(CASE WHEN va <= 0 OR a <= 0 OR a >= 1 THEN least(1, a + {E.Z_975} * sqrt(va)) ELSE 1 / (1 + exp(-(ln(a / (1 - a)) + {E.Z_975} * sqrt(va) / (a * (1 - a))))) END, 6) AS ci_high FROM au""")
def auroc_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.with_slices(order_predictions(spark, sf_dir), group=F.col("grp"))
    return rounded(E.auroc_ci(rows, ["slice_kind", "slice_value"]))


def _erf2(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = "0.17087277::DOUBLE"
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({k}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def _parts(p: str) -> str:
    return f"""CASE WHEN y = 1 THEN (rank() OVER (PARTITION BY grp ORDER BY {p}) + (count(*) OVER (PARTITION BY grp, {p}) - 1) / 2 - rank() OVER (PARTITION BY grp, y ORDER BY {p}) - (count(*) OVER (PARTITION BY grp, y, {p}) - 1) / 2) / sum(1 - y) OVER (PARTITION BY grp)
  ELSE 1 - (rank() OVER (PARTITION BY grp ORDER BY {p}) + (count(*) OVER (PARTITION BY grp, {p}) - 1) / 2 - rank() OVER (PARTITION BY grp, y ORDER BY {p}) - (count(*) OVER (PARTITION BY grp, y, {p}) - 1) / 2) / sum(y) OVER (PARTITION BY grp) END"""


@query(f"""WITH {PREDICTIONS}, c AS (SELECT grp, y, {_parts("p_a")} AS a, {_parts("p_b")} AS b FROM pr),
g AS (SELECT grp, avg(a) FILTER (y = 1) AS auroc_a, avg(b) FILTER (y = 1) AS auroc_b, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
  coalesce(var_samp(a - b) FILTER (y = 1), 0) / count(*) FILTER (y = 1) + coalesce(var_samp(a - b) FILTER (y = 0), 0) / count(*) FILTER (y = 0) AS var_diff FROM c GROUP BY grp),
z AS (SELECT *, auroc_a - auroc_b AS diff, (auroc_a - auroc_b) / sqrt(var_diff) AS z FROM g)
SELECT grp, round(auroc_a, 6) AS auroc_a, round(auroc_b, 6) AS auroc_b, n_pos, n_neg, round(var_diff, 6) AS var_diff, round(diff, 6) AS diff, round(z, 6) AS z, round({_erf2("z")}, 6) AS p_two_sided,
round(diff - {E.Z_975} * sqrt(var_diff), 6) AS ci_low, round(diff + {E.Z_975} * sqrt(var_diff), 6) AS ci_high FROM z""")
def paired_delong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.paired_delong(predictions(spark, sf_dir), ["grp"]))


_BIN = "CASE " + " ".join(f"WHEN p >= {E.EDGES[k]!r}::DOUBLE AND p < {E.EDGES[k + 1]!r}::DOUBLE THEN {k}" for k in range(10)) + " END"


@query(f"""WITH {ORDER_PREDICTIONS}, b AS (SELECT grp, {_BIN} AS bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM op GROUP BY 1, 2)
SELECT grp, round(sum(CASE WHEN bin IS NULL THEN 0 ELSE n * abs(acc - conf) END) / sum(n), 6) AS ece FROM b GROUP BY grp""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.calibration_error(order_predictions(spark, sf_dir), ["grp"]))


@query(f"""WITH {ORDER_PREDICTIONS}, s AS (SELECT grp, p, sum(y) AS pos, count(*) AS c FROM op GROUP BY grp, p),
t AS (SELECT grp, pos / sum(pos) OVER (PARTITION BY grp) * sum(pos) OVER w / sum(c) OVER w AS part FROM s WINDOW w AS (PARTITION BY grp ORDER BY p DESC)),
a AS (SELECT grp, sum(part) AS ap FROM t GROUP BY grp),
m AS (SELECT grp, count(*) AS n, avg(((p >= 0.5) = (y = 1))::INT) AS acc, coalesce(2 * count(*) FILTER (p >= 0.5 AND y = 1) / nullif(2 * count(*) FILTER (p >= 0.5 AND y = 1) + count(*) FILTER (p >= 0.5 AND y = 0) + count(*) FILTER (p < 0.5 AND y = 1), 0), 0) AS f1, avg(y) AS br FROM op GROUP BY grp)
SELECT grp, n, round(acc, 6) AS accuracy, round(f1, 6) AS f1, round(br, 6) AS base_rate, round(ap, 6) AS auprc FROM m JOIN a USING (grp)""")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.threshold_metrics(order_predictions(spark, sf_dir), ["grp"]))


_CONF = """cf AS (SELECT grp, row_number() OVER w AS k, count(*) OVER (PARTITION BY grp) AS n, sum(1 - y) OVER (PARTITION BY grp ORDER BY 1 - p, item_id ROWS UNBOUNDED PRECEDING) AS cw, sum(1 - y) OVER (PARTITION BY grp) AS aw FROM op WINDOW w AS (PARTITION BY grp ORDER BY 1 - p, item_id))"""


@query(f"""WITH {ORDER_PREDICTIONS}, {_CONF}, r AS (SELECT *, cw / k AS risk, greatest(0, k - (n - aw)) / k AS orc, (k = 1 OR k = n) AS edge FROM cf),
s AS (SELECT grp, max(n) AS n, (sum(risk) - sum(risk) FILTER (edge) / 2) / max(n) AS m, (sum(orc) - sum(orc) FILTER (edge) / 2) / max(n) AS o, max(aw) / max(n) * (max(n) - 1) / max(n) AS r FROM r GROUP BY grp)
SELECT grp, n, round(m, 6) AS aurc_method, round(o, 6) AS aurc_oracle, round(r, 6) AS aurc_random, round(CASE WHEN r - o > 1e-12 THEN (r - m) / (r - o) ELSE 0 END, 6) AS prr FROM s""")
def rejection_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.rejection_ratio(order_predictions(spark, sf_dir), ["grp"]))


@query(f"""WITH {ORDER_PREDICTIONS}, {_CONF}, g AS (SELECT grp, n, i AS point, 0.05::DOUBLE + i * (0.95::DOUBLE / 99) AS coverage FROM (SELECT DISTINCT grp, n FROM cf), range(0, 100) t(i)),
j AS (SELECT *, greatest(floor(coverage * n), 1)::BIGINT AS k FROM g)
SELECT j.grp, point::INT AS point, round(coverage, 6) AS coverage, j.k, round(1 - cw / j.k, 6) AS accuracy FROM j JOIN cf ON cf.grp = j.grp AND cf.k = j.k""")
def selective_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.selective_curve(order_predictions(spark, sf_dir), ["grp"]))


@query(f"""WITH {ORDER_PREDICTIONS}, c AS (SELECT grp, row_number() OVER w AS k, count(*) OVER (PARTITION BY grp) AS n, sum(((p >= 0.5) <> (y = 1))::INT) OVER (PARTITION BY grp ORDER BY 1 - CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, item_id ROWS UNBOUNDED PRECEDING) AS cw FROM op
  WINDOW w AS (PARTITION BY grp ORDER BY 1 - CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, item_id)),
g AS (SELECT grp, n, unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]) AS coverage FROM (SELECT DISTINCT grp, n FROM c)), j AS (SELECT *, greatest(ceil(coverage * n), 1)::BIGINT AS k FROM g)
SELECT j.grp, coverage, j.k, round(1 - cw / j.k, 6) AS accuracy FROM j JOIN c ON c.grp = j.grp AND c.k = j.k""")
def selective_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.selective_accuracy(order_predictions(spark, sf_dir), ["grp"], [0.5, 0.7, 0.8, 0.9, 1.0]))


def _conformal_sql(cal: str, test: str, alpha: float) -> str:
    return f"""cal AS (SELECT grp, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM op WHERE {cal}),
n AS (SELECT grp, count(*) AS n, (count(*) - 1) * least(1.0::DOUBLE, ceil((count(*) + 1) * (1 - {alpha}::DOUBLE)) / count(*)) AS h FROM cal GROUP BY grp),
o AS (SELECT grp, s, row_number() OVER (PARTITION BY grp ORDER BY s) - 1 AS i FROM cal),
q AS (SELECT n.grp, n.n, max(CASE WHEN i = floor(h) THEN s END) + (max(CASE WHEN i = ceil(h) THEN s END) - max(CASE WHEN i = floor(h) THEN s END)) * (max(h) - floor(max(h))) AS th FROM n JOIN o USING (grp) GROUP BY n.grp, n.n),
t AS (SELECT op.grp, y, n, th, (1 - p <= th) AS in1, (p <= th) AS in0 FROM op JOIN q ON op.grp = q.grp WHERE {test})
SELECT grp, {alpha}::DOUBLE AS alpha, round(max(th), 6) AS threshold, max(n) AS n_cal, count(*) AS n_test, round(avg(CASE WHEN y = 1 THEN in1 ELSE in0 END::INT), 6) AS coverage, round(avg(in0::INT + in1::INT), 6) AS avg_set_size,
round(avg((in0::INT + in1::INT = 1)::INT), 6) AS singleton_fraction, round(avg((in0::INT + in1::INT = 0)::INT), 6) AS empty_fraction, round(avg(CASE WHEN in0::INT + in1::INT = 1 THEN (in1 = (y = 1))::INT END), 6) AS singleton_accuracy FROM t GROUP BY grp"""


@query(f"WITH {ORDER_PREDICTIONS}, {_conformal_sql('item_id % 2 = 0', 'item_id % 2 = 1', 0.1)}")
def conformal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_predictions(spark, sf_dir)
    half = F.col("item_id") % 2
    return rounded(E.conformal(rows.where(half == 0), rows.where(half == 1), ["grp"], 0.1))


@query(f"""WITH {ORDER_PREDICTIONS}, f AS (SELECT item_id, grp, y, ((row_number() OVER (PARTITION BY grp, y ORDER BY md5(item_id || '|42'), item_id) - 1) % 5)::INT AS fold FROM op) SELECT * FROM f""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified_folds(order_predictions(spark, sf_dir), ["grp", "y"], "item_id").select("item_id", "grp", "y", "fold")


@query(f"""WITH {ORDER_PREDICTIONS}, f AS (SELECT *, ((row_number() OVER (PARTITION BY grp, y ORDER BY md5(item_id || '|42'), item_id) - 1) % 5)::INT AS fold FROM op),
m AS (SELECT grp, fold, avg(((p >= 0.5) = (y = 1))::INT) AS accuracy, avg(y) AS base_rate FROM f GROUP BY grp, fold)
SELECT grp, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, round(avg(base_rate), 6) AS base_rate_mean, round(stddev_pop(base_rate), 6) AS base_rate_std FROM m GROUP BY grp""")
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = E.stratified_folds(order_predictions(spark, sf_dir), ["grp", "y"], "item_id")
    m = f.groupBy("grp", "fold").agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.avg(F.col("y").cast("double")).alias("base_rate"))
    return rounded(E.fold_summary(m, ["accuracy", "base_rate"], ["grp"]))


@query(f"""WITH {ORDER_PREDICTIONS}, nm AS (SELECT grp AS target FROM op GROUP BY grp HAVING count(*) >= 30), cal AS (SELECT target, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM op JOIN nm ON grp <> target),
n AS (SELECT target, count(*) AS n, (count(*) - 1) * least(1.0::DOUBLE, ceil((count(*) + 1) * (1 - 0.2::DOUBLE)) / count(*)) AS h FROM cal GROUP BY target), o AS (SELECT target, s, row_number() OVER (PARTITION BY target ORDER BY s) - 1 AS i FROM cal),
q AS (SELECT n.target, n.n, max(CASE WHEN i = floor(h) THEN s END) + (max(CASE WHEN i = ceil(h) THEN s END) - max(CASE WHEN i = floor(h) THEN s END)) * (max(h) - floor(max(h))) AS th FROM n JOIN o USING (target) GROUP BY n.target, n.n),
t AS (SELECT q.target, y, n, th, (1 - p <= th) AS in1, (p <= th) AS in0 FROM op JOIN q ON op.grp = q.target)
SELECT target, round(max(th), 6) AS threshold, max(n) AS n_cal, count(*) AS n_test, round(avg(CASE WHEN y = 1 THEN in1 ELSE in0 END::INT), 6) AS coverage FROM t GROUP BY target""")
def conformal_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.leave_one_out(order_predictions(spark, sf_dir), "grp", 0.2).select("target", "threshold", "n_cal", "n_test", "coverage"))
