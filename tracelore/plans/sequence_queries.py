"""Queries over behavior sequences."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelore.operators import sequences as S
from tracelore.plans.fixtures import BEHAVIORS, EPISODES, SEQUENCES, episodes, sequences
from tracelore.plans.registry import query, r6

_REL = "position / greatest(n - 1, 1)"


@query(f"""WITH {EPISODES}, b AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM ep)
SELECT item_id, count(*) AS n_episodes, sum(token_count)::BIGINT AS n_tokens, {", ".join(f"round(count(*) FILTER (behavior = '{b}') / count(*), 6) AS prop_{b}, count(*) FILTER (behavior = '{b}') AS count_{b}" for b in BEHAVIORS)},
round(count(*) FILTER (behavior = 'V') / greatest(count(*) FILTER (behavior = 'F'), 1), 6) AS vf_ratio, round(coalesce(avg({_REL}) FILTER (behavior = 'B'), 0), 6) AS mean_pos_B,
round(coalesce(min({_REL}) FILTER (behavior = 'C'), 1), 6) AS first_conclude_pos FROM b GROUP BY item_id""")
def episode_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.proportions(episodes(spark, sf_dir))
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(f"""WITH {EPISODES}, g AS (SELECT item_id, position - lag(position) OVER (PARTITION BY item_id ORDER BY position) AS gap FROM ep WHERE behavior = 'V'),
c AS (SELECT item_id, stddev_pop(gap) / avg(gap) AS c FROM g GROUP BY item_id),
r AS (SELECT item_id, max(n) AS n FROM (SELECT item_id, i, count(*) AS n FROM (SELECT item_id, position - row_number() OVER (PARTITION BY item_id ORDER BY position) AS i FROM ep WHERE behavior = 'F') GROUP BY item_id, i) GROUP BY item_id)
SELECT item_id, round(coalesce(c.c, 0), 6) AS clustering, coalesce(r.n, 0) AS longest_run FROM (SELECT DISTINCT item_id FROM ep) LEFT JOIN c USING (item_id) LEFT JOIN r USING (item_id)""")
def runs_and_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir)
    return S.clustering(e).join(S.longest_run(e), "item_id").select("item_id", r6("clustering").alias("clustering"), "longest_run")


_ENTROPY = f"""{EPISODES}, p AS (SELECT item_id, a, b, count(*) AS n FROM (SELECT item_id, behavior AS a, lead(behavior) OVER (PARTITION BY item_id ORDER BY position) AS b FROM ep) WHERE b IS NOT NULL GROUP BY item_id, a, b),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY item_id, a) AS p, n / sum(n) OVER (PARTITION BY item_id) AS j FROM p),
w AS (SELECT item_id, a, -sum(p * log2(p)) AS h, sum(n) AS n, -sum(j * log2(j)) AS hj FROM q GROUP BY item_id, a),
h AS (SELECT item_id, sum(h * n) / sum(n) AS h_weighted, avg(h) AS h_mean, sum(hj) AS h_joint FROM w GROUP BY item_id)"""


@query(f"WITH {_ENTROPY} SELECT item_id, round(coalesce(h_weighted, 0), 6) AS h_weighted, round(coalesce(h_mean, 0), 6) AS h_mean, round(coalesce(h_joint, 0), 6) AS h_joint FROM (SELECT DISTINCT item_id FROM ep) LEFT JOIN h USING (item_id)")
def transition_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.transition_entropy(episodes(spark, sf_dir))
    return out.select("item_id", *[r6(c).alias(c) for c in out.columns[1:]])


@query(f"""WITH {_ENTROPY}, s AS (SELECT item_id, y, count(*) FILTER (behavior = 'V') / greatest(count(*) FILTER (behavior = 'F'), 1) AS vf FROM ep GROUP BY item_id, y)
SELECT y, count(*) AS n_traces, round(avg(coalesce(h_weighted, 0)), 6) AS mean_entropy, round(avg(vf), 6) AS mean_vf_ratio FROM s LEFT JOIN h USING (item_id) GROUP BY y""")
def behavior_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: traces of each label, their mean transition entropy and verify-to-forward ratio."""
    e = episodes(spark, sf_dir)
    label = e.groupBy("item_id").agg(F.first("y").alias("y"))
    one = label.join(S.transition_entropy(e), "item_id").join(S.proportions(e).select("item_id", "vf_ratio"), "item_id")
    return one.groupBy("y").agg(F.count("*").alias("n_traces"), r6(F.avg("h_weighted")).alias("mean_entropy"), r6(F.avg("vf_ratio")).alias("mean_vf_ratio"))


@query(f"""WITH {EPISODES}, c AS (SELECT behavior, grp, count(*) AS n FROM ep GROUP BY behavior, grp UNION ALL SELECT behavior, NULL, count(*) FROM ep GROUP BY behavior)
SELECT behavior, grp, n, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM c""")
def behavior_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distribution(episodes(spark, sf_dir)).withColumn("share", r6("share"))


_GRAMS = ["".join(g) for g in product(BEHAVIORS, repeat=2)]


def _count(g: str) -> str:
    return f"len(list_filter(range(1, length(seq) - {len(g) - 2}), lambda i: seq[i:i + {len(g) - 1}] = '{g}'))"


@query(f"""WITH {SEQUENCES} SELECT item_id, {", ".join(f"{_count(g)}::DOUBLE AS ng2_{g}_count, round({_count(g)} / greatest(length(seq) - 1, 1), 6) AS ng2_{g}_rate" for g in _GRAMS)} FROM sq""")
def bigram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.gram_features(sequences(spark, sf_dir), _GRAMS, "ng2")
    return out.select("item_id", *[r6(c).alias(c) for c in out.columns[1:]])


_TRI = ["FVF", "BVF", "HBV", "CFF", "VVV", "FFC"]


@query(f"""WITH {SEQUENCES} SELECT item_id, {", ".join(f"{_count(g)}::DOUBLE AS ng3_{g}_count, round({_count(g)} / greatest(length(seq) - 2, 1), 6) AS ng3_{g}_rate, contains(seq, '{g}')::INT::DOUBLE AS rare_{g}" for g in _TRI)},
length(seq) AS behavior_seq_len FROM sq""")
def trigram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir)
    out = S.gram_features(s, _TRI, "ng3")
    out = out.select("item_id", *[r6(c).alias(c) for c in out.columns[1:]])
    return out.join(S.motif_flags(s, _TRI), "item_id").join(s.select("item_id", F.char_length("seq").cast("long").alias("behavior_seq_len")), "item_id")


@query(f"""WITH {SEQUENCES} SELECT item_id, {", ".join(f"round(coalesce(list_sum(list_transform(list_filter(range(1, length(seq) - {len(m) - 2}), lambda i: seq[i:i + {len(m) - 1}] = '{m}'), lambda i: i / length(seq))), 0), 6) AS pos_{m}" for m in S.POSITION_MOTIFS)} FROM sq""")
def position_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.motif_positions(sequences(spark, sf_dir))
    return out.select("item_id", *[r6(c).alias(c) for c in out.columns[1:]])


@query(f"""WITH {SEQUENCES}, g AS (SELECT g, count(*) AS freq, count(DISTINCT item_id) AS docs FROM (SELECT item_id, seq[i:i + 2] AS g FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM sq)) GROUP BY g),
t AS (SELECT g AS gram, freq, docs, 'top' AS kind, row_number() OVER (ORDER BY freq DESC, g) AS rank FROM g),
r AS (SELECT g AS gram, freq, docs, 'rare' AS kind, row_number() OVER (ORDER BY freq, g) AS rank FROM g WHERE docs < (SELECT count(*) FROM sq) * 0.05)
SELECT * FROM t WHERE rank <= 50 UNION ALL SELECT * FROM r WHERE rank <= 20""")
def ngram_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary(sequences(spark, sf_dir))


_TIMING = f"""{EPISODES}, z AS (SELECT item_id, count(*) AS len FROM ep GROUP BY item_id), bs AS (SELECT unnest(['F','V','B','R','S','H','C']) AS behavior),
gp AS (SELECT item_id, behavior, position, position - lag(position) OVER (PARTITION BY item_id, behavior ORDER BY position) AS gap FROM ep),
a AS (SELECT item_id, behavior, count(*) AS n, min(position) AS f, max(position) AS l, avg(gap) AS m, stddev_pop(gap) AS s, count(gap) AS k FROM gp GROUP BY item_id, behavior),
tm AS (SELECT item_id, behavior, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN -1 WHEN len > 1 THEN f / (len - 1) ELSE 0 END AS first_pos, CASE WHEN n IS NULL THEN -1 WHEN len > 1 THEN l / (len - 1) ELSE 0 END AS last_pos,
  coalesce(m, -1) AS iei_mean, CASE WHEN k > 0 THEN s ELSE -1 END AS iei_sd, CASE WHEN coalesce(k, 0) < 2 THEN -1 WHEN s + m <= 1e-12 THEN 0 ELSE (s - m) / (s + m) END AS burstiness
  FROM z CROSS JOIN bs LEFT JOIN a USING (item_id, behavior))"""


@query(f"WITH {_TIMING} SELECT item_id, behavior, n, round(first_pos::DOUBLE, 6) AS first_pos, round(last_pos::DOUBLE, 6) AS last_pos, round(iei_mean::DOUBLE, 6) AS iei_mean, round(iei_sd::DOUBLE, 6) AS iei_sd, round(burstiness::DOUBLE, 6) AS burstiness FROM tm")
def behavior_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.behavior_timing(episodes(spark, sf_dir))
    return out.select("item_id", "behavior", "n", *[r6(c).alias(c) for c in out.columns[3:]])


_STATS = ("n", "first_pos", "last_pos", "iei_mean", "iei_sd", "burstiness")


@query(f"""WITH {_TIMING} SELECT item_id, {", ".join(f"round((max({s}) FILTER (behavior = '{b}'))::DOUBLE, 6) AS t_{s}_{b}" for b in BEHAVIORS for s in _STATS)} FROM tm GROUP BY item_id""")
def timing_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.wide_timing(S.behavior_timing(episodes(spark, sf_dir)))
    return out.select("item_id", *[r6(F.col(c).cast("double")).alias(c) for c in out.columns[1:]])


@query(f"""WITH {EPISODES}, r AS (SELECT item_id, position, CASE WHEN lead(position) OVER w IS NOT NULL THEN token_count::DOUBLE END AS gap, (behavior <> lag(behavior) OVER w)::INT AS ch, count(*) OVER (PARTITION BY item_id) AS len FROM ep WINDOW w AS (PARTITION BY item_id ORDER BY position)),
m AS (SELECT *, min(gap) OVER (PARTITION BY item_id) AS lo, max(gap) OVER (PARTITION BY item_id) AS hi FROM r),
b AS (SELECT item_id, CASE WHEN hi > lo THEN least(19, floor((gap - lo) / ((hi - lo) / 20)))::INT ELSE 0 END AS bin, count(*) AS n FROM m WHERE gap IS NOT NULL GROUP BY 1, 2),
h AS (SELECT item_id, -sum(p * ln(p)) / ln(20) AS e FROM (SELECT item_id, n / sum(n) OVER (PARTITION BY item_id) AS p FROM b) GROUP BY item_id),
s AS (SELECT item_id, avg(gap) AS m, stddev_pop(gap) AS sd, sum(ch) AS ch, max(len) AS len, sum(gap) AS t FROM m GROUP BY item_id)
SELECT item_id, round(coalesce(m, 0), 6) AS iei_mean, round(coalesce(sd, 0), 6) AS iei_sd, round(CASE WHEN t > 0 THEN coalesce(e, 0) ELSE 0 END, 6) AS iei_entropy, round(CASE WHEN len > 1 THEN ch / (len - 1) ELSE 0 END, 6) AS transition_rate FROM s LEFT JOIN h USING (item_id)""")
def timing_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.global_timing(episodes(spark, sf_dir))
    return out.select("item_id", *[r6(c).alias(c) for c in out.columns[1:]])
