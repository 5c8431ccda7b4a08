"""Queries over step embeddings, token trajectories, texts and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.operators import confidence as C
from tracelore.operators import lexical as L
from tracelore.operators import trajectory as T
from tracelore.operators import vectors as V
from tracelore.plans.evaluation_queries import rounded
from tracelore.plans.fixtures import EPISODES, STEPS, episodes, steps
from tracelore.plans.registry import query, r6, table

_SIMS = f"""{STEPS}, sz AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM st),
sm AS (SELECT a.item_id, a.step AS i, b.step AS j, a.n, a.behavior, list_dot_product(a.v, b.v) AS sim FROM sz a JOIN st b ON a.item_id = b.item_id AND b.step < a.step)"""
_TAIL = "greatest(round_even(n * 0.2::DOUBLE, 0)::BIGINT, 1)"


@query(f"""WITH {_SIMS}, b AS (SELECT item_id, avg(m) AS pr FROM (SELECT item_id, i, max(sim) AS m FROM sm GROUP BY item_id, i) GROUP BY item_id),
o AS (SELECT item_id, avg((sim >= 0.7)::INT) FILTER (i - j >= 2) AS rr, max((i - j) / n) FILTER (i - j >= 2 AND sim >= 0.7) AS ms, avg(sim) FILTER (i >= n - {_TAIL} AND j < n - {_TAIL} AND n >= 4) AS tr,
  avg(sim) FILTER (i - j = 1 AND behavior IN ('B', 'R', 'X')) AS ri FROM sm GROUP BY item_id)
SELECT item_id, round(coalesce(rr, 0), 6) AS recurrence_rate, round(coalesce(ms, 0), 6) AS max_cycle_span, round(coalesce(tr, 0), 6) AS termination_recycle, round(coalesce(ri, 0), 6) AS revision_ineffectiveness, round(coalesce(pr, 0), 6) AS progress_repetition
FROM (SELECT DISTINCT item_id FROM st) LEFT JOIN o USING (item_id) LEFT JOIN b USING (item_id)""")
def semantic_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.recurrence(steps(spark, sf_dir)))


@query(f"""WITH {STEPS}, c AS (SELECT *, (behavior IN ('V', 'B', 'R'))::INT AS fix, sum((behavior IN ('V', 'B', 'R'))::INT) OVER (PARTITION BY item_id ORDER BY step) AS c FROM st),
h AS (SELECT a.item_id, count(DISTINCT a.step) AS n FROM c a JOIN c b ON a.item_id = b.item_id AND b.step >= a.step + 3 AND b.c - b.fix > a.c AND list_dot_product(a.v, b.v) >= 0.1 GROUP BY a.item_id)
SELECT item_id, coalesce(n, 0) AS cycle_count FROM (SELECT DISTINCT item_id FROM st) LEFT JOIN h USING (item_id)""")
def embedding_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles at a low threshold, as the vectors of this table rarely point the same way."""
    return V.cycles(steps(spark, sf_dir), threshold=0.1)


_ENDS = f"""{STEPS}, sz AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY step) - 1 AS r FROM st)"""


@query(f"""WITH {_ENDS}, p AS (SELECT item_id, v AS p FROM st WHERE step = 0), k AS (SELECT *, {_TAIL} AS k, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM sz),
m AS (SELECT item_id, n, d, avg(x) FILTER (r >= n - 3) AS e, avg(x) FILTER (r < k) AS h, avg(x) FILTER (r >= n - k) AS t FROM k GROUP BY item_id, n, d),
g AS (SELECT item_id, n, list(e ORDER BY d) AS e, list(h ORDER BY d) AS h, list(t ORDER BY d) AS t FROM m GROUP BY item_id, n),
x AS (SELECT st.item_id, max(list_dot_product(v, p) / (sqrt(list_dot_product(p, p)) + 1e-9)) AS top FROM st JOIN p ON st.item_id = p.item_id GROUP BY st.item_id),
f AS (SELECT g.item_id, n, top, list_dot_product(p, e) / ((sqrt(list_dot_product(p, p)) + 1e-9) * (sqrt(list_dot_product(e, e)) + 1e-9)) AS ce, list_dot_product(p, h) / ((sqrt(list_dot_product(p, p)) + 1e-9) * (sqrt(list_dot_product(h, h)) + 1e-9)) AS ch,
  list_dot_product(p, t) / ((sqrt(list_dot_product(p, p)) + 1e-9) * (sqrt(list_dot_product(t, t)) + 1e-9)) AS ct FROM g JOIN p ON g.item_id = p.item_id JOIN x ON g.item_id = x.item_id)
SELECT item_id, round(greatest(0, ce), 6) AS problem_conclusion_sim, round(least(1, greatest(0, top)), 6) AS problem_trace_max_sim, round(CASE WHEN n >= 5 THEN ch - ct ELSE 0 END, 6) AS problem_drift FROM f""")
def problem_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return rounded(V.alignment(s, s.where("step = 0").select("item_id", F.col("v").alias("p"))))


@query(f"""WITH {_ENDS}, a AS (SELECT item_id, v AS p FROM st WHERE step = 9), c AS (SELECT sz.item_id, n, r::DOUBLE AS r, list_dot_product(v, p) / CASE WHEN list_dot_product(p, p) = 0 THEN 1 ELSE sqrt(list_dot_product(p, p)) END AS cos FROM sz JOIN a ON sz.item_id = a.item_id),
o AS (SELECT item_id, max(cos) AS mx, arg_min(r, (-cos, r)) AS am, arg_max(cos, r) AS fi, arg_min(cos, r) AS fs, coalesce(regr_slope(cos, r), 0) AS sl, avg(cos) AS me, stddev_pop(cos) AS sd, avg(cos) FILTER (r >= n - 5 OR n < 5) AS l5, count(*) AS n FROM c GROUP BY item_id)
SELECT item_id, round(mx, 6) AS max_cos, round(am / greatest(n - 1, 1), 6) AS peak_pos, round(fi, 6) AS final_cos, round(fs, 6) AS first_cos, round(sl, 6) AS slope, round(me, 6) AS mean, round(sd, 6) AS sd, round(fi - fs, 6) AS drift, round(l5, 6) AS last5_mean, (am < 0.3::DOUBLE * n)::INT AS early_peak, n AS n_steps FROM o""")
def answer_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return rounded(V.answer_cosines(s, s.where("step = 9").select("item_id", F.col("v").alias("p"))))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return episodes(spark, sf_dir).select("item_id", F.col("position").alias("t"), (-v).alias("logprob"), (v / (1 + v)).alias("entropy"))


_TOK = f"{EPISODES}, tk AS (SELECT item_id, position AS t, -value AS logprob, value / (1 + value) AS entropy FROM ep)"


@query(f"""WITH {_TOK}, n AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, entropy - avg(entropy) OVER (PARTITION BY item_id) AS dev FROM tk), l AS (SELECT *, lead(dev) OVER (PARTITION BY item_id ORDER BY t) AS nx FROM n)
SELECT item_id, round(avg(logprob), 6) AS mean_logprob, round(stddev_pop(logprob), 6) AS std_logprob, round(min(logprob), 6) AS min_logprob, round(avg((logprob < -5)::INT), 6) AS low_logprob_frac, round(avg(entropy), 6) AS mean_entropy, round(stddev_pop(entropy), 6) AS std_entropy,
round(max(entropy), 6) AS max_entropy, round(arg_min(t, (-entropy, t)) / greatest(count(*) - 1, 1), 6) AS max_entropy_pos, round(avg(entropy) FILTER (t >= n - {_TAIL}), 6) AS entropy_in_conclusion,
round(coalesce(sum(dev * nx) / (sum(dev * dev) + 1e-9), 0), 6) AS entropy_autocorr_lag1 FROM l GROUP BY item_id""")
def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.summary(_tokens(spark, sf_dir)))


@query(f"""WITH {_TOK}, q AS (SELECT *, count(*) OVER (PARTITION BY item_id) // 4 AS q FROM tk), p AS (SELECT *, CASE WHEN q = 0 THEN 3 ELSE least(t // greatest(q, 1), 3) END AS part FROM q)
SELECT item_id, {", ".join(f"round(avg({x}) FILTER (part = {k}), 6) AS {n}_q{k + 1}" for n, x in (("nll", "-logprob"), ("entropy", "entropy")) for k in range(4))} FROM p GROUP BY item_id""")
def trajectory_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.quartiles(_tokens(spark, sf_dir)))


@query(f"""WITH {_TOK}, n AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, -logprob AS nll FROM tk),
w AS (SELECT *, CASE WHEN t >= 49 AND n >= 50 THEN avg(nll) OVER (PARTITION BY item_id ORDER BY t ROWS 49 PRECEDING) END AS roll, CASE WHEN t >= 19 AND n >= 20 THEN avg(entropy) OVER (PARTITION BY item_id ORDER BY t ROWS 19 PRECEDING) END AS soft FROM n),
f AS (SELECT *, max(soft) OVER (PARTITION BY item_id ORDER BY t) - soft AS fall FROM w),
g AS (SELECT item_id, max(n) AS n, max(roll) AS roll, arg_min(t, (-roll, t)) FILTER (roll IS NOT NULL) AS ra, avg(nll) AS m, count(*) FILTER (nll > 8) AS sp, count(*) FILTER (nll > 8 AND t >= floor(n * 0.8::DOUBLE)) AS late, max(fall) AS fall, arg_min(t, (-soft, t)) FILTER (soft IS NOT NULL) AS sa FROM f GROUP BY item_id)
SELECT item_id, round(CASE WHEN n >= 50 THEN roll ELSE m END, 6) AS max_window_nll, round(CASE WHEN n >= 50 THEN (ra - 49) / greatest(n - 50, 1) ELSE 0 END, 6) AS max_window_pos, sp AS n_spikes, round(CASE WHEN sp > 0 THEN late / sp ELSE 0 END, 6) AS spike_tail_frac,
round(fall, 6) AS entropy_collapse, round((sa - 19) / greatest(n - 20, 1), 6) AS entropy_peak_pos FROM g""")
def trajectory_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.bursts(_tokens(spark, sf_dir)))


@query(f"""WITH {_TOK}, m AS (SELECT item_id, 'tail50' AS name, greatest(count(*) - 50, 0) AS lo, count(*) AS hi FROM tk GROUP BY item_id UNION ALL SELECT item_id, 'after_marker', 10, 30 FROM tk GROUP BY item_id)
SELECT tk.item_id, name, round(avg(-logprob), 6) AS mean_nll, round(max(-logprob), 6) AS max_nll FROM tk JOIN m ON tk.item_id = m.item_id AND t >= lo AND t < hi GROUP BY tk.item_id, name""")
def trajectory_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    n = t.groupBy("item_id").agg(F.count("*").alias("n"))
    marks = n.select("item_id", F.lit("tail50").alias("name"), F.greatest(F.col("n") - 50, F.lit(0)).alias("lo"), F.col("n").alias("hi")).union(n.select("item_id", F.lit("after_marker"), F.lit(10).cast("long"), F.lit(30).cast("long")))
    return rounded(T.spans(t, marks))


_W = "list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '')"


def _dens(p: str) -> str:
    # letters outside ASCII count as word characters for the Spark form; here any plain letter stands for them
    p = p.replace("'", "''")
    return f"len(regexp_extract_all(regexp_replace(t, '[À-ÖØ-öø-ɏ]', 'x', 'g'), '(?i){p}')) / greatest(len(w), 1)"


_CUES = f"""SELECT item_id, t, w, len(list_filter(w, lambda x: trim(x, '.,!?;:''"') IN ({", ".join(f"'{x}'" for x in L.WAIT_WORDS)}))) / greatest(len(w), 1) AS wait_density, {_dens(L.MAYBE)} AS maybe_density, {_dens(L.VERIFY)} AS verify_density, {_dens(L.ACTUALLY)} AS actually_density,
{_dens(L.NEGATION)} AS negation_density, (length(t) - length(replace(t, '?', ''))) / greatest(len(w), 1) AS question_mark_rate,
CASE WHEN len(w) >= 4 THEN 1 - len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) / (len(w) - 3) ELSE 0 END AS repetition_rate_4gram
FROM (SELECT doc_id AS item_id, coalesce(text, '') AS t, {_W.replace("(t)", "(coalesce(text, ''))")} AS w FROM documents)"""


@query(f"""SELECT item_id, {", ".join(f"round({c}, 6) AS {c}" for c in ("wait_density", "maybe_density", "verify_density", "actually_density", "negation_density", "question_mark_rate", "repetition_rate_4gram"))}, len(w)::BIGINT AS n_tokens FROM ({_CUES})""")
def cue_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.cue_densities(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "item_id")))


@query(f"""SELECT item_id, round(wait_density, 6) AS wait_ratio, round(question_mark_rate * greatest(len(w), 1)) AS question_mark_count, round(negation_density * greatest(len(w), 1)) AS negation_count, round(repetition_rate_4gram, 6) AS repetition_rate_4gram FROM ({_CUES})""")
def cue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.cue_counts(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "item_id")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("role = 'user'"), c.where("role = 'assistant'")
    return a.select("conv_id", "turn", F.col("text").alias("problem")).join(b.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"])


_KW = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z][a-z0-9]{{3,}}')), lambda x: x NOT IN (" + ", ".join(f"'{x}'" for x in sorted(set(L.STOP_WORDS))) + "))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {_KW.format("a.text")} AS p, {_KW.format("b.text")} AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN len(p) > 0 THEN len(list_intersect(p, t)) / len(p) ELSE 0 END, 6) AS coverage FROM p""")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("conv_id", "turn", r6(L.keyword_coverage(p, "problem", "answer")).alias("coverage"))


_HEDGE = L.HEDGES
_HV = f"""SELECT doc_id AS item_id, len(regexp_extract_all(coalesce(text, ''), '(?i){_HEDGE}'))::BIGINT AS h, len(regexp_extract_all(coalesce(text, ''), '(?i){L.VERIFY}'))::BIGINT AS v FROM documents"""


@query(f"""SELECT item_id, h AS hedge_count, v AS verify_count, round(h / (v + 1.0::DOUBLE), 6) AS hvr, (h = 0)::INT AS zero_hedge, round(1 / (1 + h / (v + 1.0::DOUBLE)), 6) AS confidence FROM ({_HV})""")
def hedge_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.hedge_verify(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "item_id")))


@query(f"""WITH h AS ({_HV}), j AS (SELECT h.h, quality AS y FROM h JOIN labels ON item_id = doc_id)
SELECT count(*) FILTER (h = 0) AS n_accept, round(count(*) FILTER (h = 0) / count(*), 6) AS coverage, round(avg(y) FILTER (h = 0), 6) AS precision, round(avg(y), 6) AS base_accuracy, round(avg(y) FILTER (h = 0) - avg(y), 6) AS lift FROM j""")
def zero_hedge_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = L.hedge_verify(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "item_id"))
    y = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    return rounded(L.zero_hedge_rule(h.join(y, "item_id"), "quality"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("item_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "text"))
    return s.withColumn("behavior", F.element_at(F.array(*map(F.lit, "FVBRSHC")), (F.col("position") % 7 + 1).cast("int")))


def _cycle_sql(stop: list[str], fix: str) -> str:
    return f"""WITH s AS (SELECT item_id, p - 1 AS position, ['F','V','B','R','S','H','C'][(p - 1) % 7 + 1] AS behavior, l AS text FROM (SELECT doc_id AS item_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)),
w AS (SELECT item_id, position, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\w\\p{{L}}\\p{{Nd}}]+')), lambda x: regexp_full_match(x, '\\w{{3,}}') AND x NOT IN ({", ".join(f"'{x}'" for x in stop)})) AS w, (behavior IN ({fix}))::INT AS own, sum((behavior IN ({fix}))::INT) OVER (PARTITION BY item_id ORDER BY position) AS c FROM s),
v AS (SELECT * FROM w WHERE len(w) > 0),
h AS (SELECT a.item_id, count(DISTINCT a.position) AS n FROM v a JOIN v b ON a.item_id = b.item_id AND b.position >= a.position + 3 AND b.c - b.own > a.c AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3 GROUP BY a.item_id)
SELECT item_id, coalesce(n, 0) AS cycle_count FROM (SELECT DISTINCT item_id FROM s) LEFT JOIN h USING (item_id)"""


@query(_cycle_sql(L.CYCLE_STOP_21, "'V', 'B', 'R'"))
def lexical_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as episodes; words are ASCII, and no letter or digit of any script may touch them."""
    return L.lexical_cycles(_sentences(spark, sf_dir), ("V", "B", "R"), L.CYCLE_STOP_21)


@query("""SELECT o_orderkey AS item_id, round(CASE WHEN floor(o_totalprice / 50)::BIGINT <= 0 THEN 0.5 ELSE 1 / (1 + exp(0.001::DOUBLE * (floor(o_totalprice / 50)::BIGINT - 2000))) END, 6) AS length_confidence,
round(1 / (1 + exp(0.2::DOUBLE * (exp(least(o_totalprice / 100000, 50)) - 10))), 6) AS perplexity_confidence, round(exp(least(o_totalprice / 100000, 50)), 6) AS perplexity FROM orders""")
def scalar_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n, nll = F.floor(F.col("o_totalprice") / 50), F.col("o_totalprice") / 100000
    return rounded(o.select(F.col("o_orderkey").alias("item_id"), C.length_confidence(n).alias("length_confidence"), C.perplexity_confidence(C.perplexity(nll)).alias("perplexity_confidence"), C.perplexity(nll).alias("perplexity")))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.99) AS q FROM orders) SELECT o_orderkey AS item_id, round(1 - least(o_totalprice / greatest(q, 1), 1), 6) AS confidence FROM orders, q""")
def quantile_length_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_totalprice")
    return rounded(C.quantile_length_confidence(o, "o_totalprice").select("item_id", "confidence"))


_AGREEMENT = """s AS (SELECT l_orderkey AS item_id, l_returnflag AS answer FROM lineitem), l AS (SELECT item_id, max(n) / sum(n) AS sc FROM (SELECT item_id, lower(trim(answer)) AS a, count(*) AS n FROM s WHERE answer IS NOT NULL GROUP BY 1, 2) GROUP BY item_id),
e AS (SELECT item_id, sum(n) AS n, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT item_id, trim(answer) AS a, count(*) AS n FROM s WHERE answer IS NOT NULL GROUP BY 1, 2) GROUP BY item_id),
ag AS (SELECT item_id, round(coalesce(sc, 0.5), 6) AS self_consistency, round(coalesce(CASE WHEN n <= 1 THEN 0.5 ELSE 1 - h / log2(n) END, 0.5), 6) AS semantic_confidence FROM (SELECT DISTINCT item_id FROM s) LEFT JOIN l USING (item_id) LEFT JOIN e USING (item_id))"""


@query(f"WITH {_AGREEMENT} SELECT * FROM ag")
def sample_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.agreement(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("answer"))))


@query(f"""WITH {_AGREEMENT}, o AS (SELECT o_orderkey AS item_id, floor(o_totalprice / 50)::BIGINT AS n, o_orderkey % 101 AS k, exp(least(o_totalprice / 100000, 50)) AS ppl, (o_orderkey % 10) / 10.0::DOUBLE AS p FROM orders)
SELECT item_id, round(CASE WHEN n <= 0 THEN 0.5 ELSE 1 / (1 + exp(0.001::DOUBLE * (n - 2000))) END, 6) AS trace_length, round(CASE WHEN k > 1 THEN k / 100.0::DOUBLE ELSE k END, 6) AS verbalized_confidence, round(1 / (1 + exp(0.2::DOUBLE * (ppl - 10))), 6) AS perplexity,
self_consistency, semantic_confidence AS semantic_entropy, round(p, 6) AS structural FROM o LEFT JOIN ag USING (item_id)""")
def unified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confidence score of records made from orders, with order lines as their samples."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    records = o.select(key.alias("item_id"), F.floor(F.col("o_totalprice") / 50).alias("trace_token_count"), F.concat(F.lit("Confidence: "), (key % 101).cast("string"), F.lit("%")).alias("answer_text"), F.lit("").alias("reasoning_trace"), (-F.col("o_totalprice") / 100000).alias("mean_log_prob"))
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("answer"))
    return rounded(C.all_scores(records, samples, o.select(key.alias("item_id"), ((key % 10) / 10.0).alias("p"))))


@query("""WITH n AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN text[1:100] || chr(10) || chr(10) || '[... middle truncated ...]' || chr(10) || chr(10) || right(text, 60) ELSE text END AS cut FROM n""")
def middle_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", C.middle_cut(F.col("text"), 200).alias("cut"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS item_id, l_linenumber AS layer FROM lineitem), w AS (SELECT item_id, layer, max(layer) OVER (PARTITION BY item_id) AS top, unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS fraction FROM l)
SELECT item_id, fraction, arg_min(layer, (abs(layer - fraction * top), layer)) AS layer FROM w GROUP BY item_id, fraction""")
def nearest_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as layers: the one nearest to each depth."""
    layers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("layer")).distinct()
    return V.nearest_layers(layers, [0.25, 0.5, 1.0])
