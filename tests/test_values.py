"""Expected values: patterns, answers, segments, rank statistics, graphs, homology."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tracelore.functions import answers as A
from tracelore.functions.classing import labels
from tracelore.functions.segmenting import merged, segment
from tracelore.operators import confidence as C
from tracelore.operators import evaluation as E
from tracelore.operators import graphs as G
from tracelore.operators import homology as H
from tracelore.operators import modelling as M
from tracelore.operators import parsing as P
from tracelore.operators import relational as R
from tracelore.operators import sequences as S
from tracelore.operators import shapelets
from tracelore.operators import trajectory as T
from tracelore.plans import storage
from tracelore.plans.expected import BOXED, CHOSEN, CONFIDENCES, EQUIVALENT, JUDGED, MARKED, NORMALIZED, SCORED, SEGMENTS, SEVEN, SIX, STATED
from tracelore.sources import records

@pytest.mark.parametrize("table", ["seven", "six"])
def test_classes(spark, table):
    want = [(s, b) for b, ss in (SEVEN if table == "seven" else SIX).items() for s in ss]
    got = spark.createDataFrame(want, "s string, b string").select("s", "b", P.classify(F.col("s"), table).alias("c")).select("s", "b", "c.*").collect()
    assert [(r["s"], r["behavior"]) for r in got if r["behavior"] != r["b"]] == []
    assert all(r["confidence"] == 0.5 for r in got if r["b"] == "F")


@pytest.mark.parametrize("table", ["seven", "six"])
def test_classes_in_batches_are_those_of_expressions(spark, table):
    texts = [s for ss in (SEVEN if table == "seven" else SIX).values() for s in ss] + ["", "  ", "é wait, that is wrong", "Maybe a new approach", "maybe not", "Perhaps yes. perhaps", "Wait, let me check", "caféno error"]
    texts += [s for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect() for s in segment(r["text"])]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "k int, s string")
    want = [tuple(r) for r in rows.select("k", P.classify(F.col("s"), table).alias("c")).orderBy("k").select("c.*").collect()]
    assert list(zip(*labels(texts, table), strict=True)) == want


def test_blank_and_null_sentences(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",)], "s string").select(P.classify(F.col("s")).alias("c")).select("c.*").collect()
    assert {(r["behavior"], r["confidence"]) for r in rows} == {("F", 0.0)}


@pytest.mark.parametrize(("text", "low", "high"), SEGMENTS)
def test_segments(text, low, high):
    assert low <= len(segment(text)) <= high


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.characters(whitelist_categories=["Ll", "Lu"]), min_size=1, max_size=8), max_size=12), st.integers(1, 5))
def test_merging_keeps_words(words, least):
    assert " ".join(merged(words, least)).split() == " ".join(words).split()


def test_answers():
    for f, cases in ((A.boxed, BOXED), (A.normalized, NORMALIZED), (A.stated_answer, STATED), (A.after_marks, MARKED), (A.choice, CHOSEN)):
        assert [f(text) for text, _ in cases] == [want for _, want in cases]
    assert all(A.equivalent(a, b) is want for a, b, want in EQUIVALENT)
    assert [A.score(a, t, k, e)["is_correct"] for a, t, k, e, want in SCORED if want is not None] == [want for *_, want in SCORED if want is not None]
    assert A.score("I think C is correct", "C", "multiple_choice")["is_correct"]
    assert A.score("x", "3", "multiple_choice")["comparison_method"] == "extraction_failed"
    with pytest.raises(ValueError):
        A.score("1", "1", "other")


def test_think_blocks_and_bytes(spark):
    rows = [("<think>a b</think> c", "a b", "c"), ("a</think>b", "a", "b"), ("only", "", "only"), (None, "", "")]
    got = spark.createDataFrame(rows, "t string, a string, b string").select("a", "b", A.think_block(F.col("t")).alias("x")).collect()
    assert all((r["x"]["trace"], r["x"]["answer"]) == (r["a"], r["b"]) for r in got)
    assert spark.createDataFrame([("helloĠworldĊ",)], "t string").select(A.byte_text(F.col("t"))).first()[0] == "hello world\n"


def test_stated_confidence(spark):
    got = spark.createDataFrame([*CONFIDENCES, (None, 0.5)], "t string, w double").select("w", C.stated_confidence(F.col("t")).alias("g")).collect()
    assert all(math.isclose(r["w"], r["g"]) for r in got)
    judged = spark.createDataFrame(JUDGED, "t string, w double").select("w", C.judge_probability(F.col("t")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in judged)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=4, max_size=40))
def test_auroc_against_pairs(spark, rows):
    y, s = np.array([r[0] for r in rows]), np.array([r[1] / 5 for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    got = E.auroc_ci(spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, s, strict=True)], "grp string, y int, p double"), ["grp"]).first()["auroc"]
    if len(pos) and len(neg):
        assert math.isclose(got, ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()), abs_tol=1e-9)
    else:
        assert got is None


def test_sequences(spark):
    e = spark.createDataFrame([(1, k, b, 2, 1.0) for k, b in enumerate("FFVBFFFVC")] + [(2, 0, "F", 1, 1.0)], "item_id long, position long, behavior string, token_count long, confidence double")
    assert {r["item_id"]: r["longest_run"] for r in S.longest_run(e).collect()} == {1: 3, 2: 1}
    assert {r["item_id"]: r["h_weighted"] for r in S.transition_entropy(e).collect()}[2] == 0.0
    short = spark.createDataFrame([(1, "F"), (2, ""), (3, "FVFV")], "item_id long, seq string")
    assert {r["item_id"]: r["ng2_FV_count"] for r in S.gram_features(short, ["FV", "VF"], "ng2").collect()} == {1: 0.0, 2: 0.0, 3: 2.0}
    assert S.vocabulary(short.limit(0)).count() == 0


def test_graph_descriptors():
    d = G.describe(np.array(list("FVFVFVBF")))
    assert d["approx_diameter"] >= 1 and 0 <= d["avg_clustering"] <= 1 and d["spectral_radius"] > 0
    path = np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    assert np.allclose(G.betweenness(path), np.array([0, 3, 4, 3, 0]) * 2 / 12)
    assert G.describe(np.array(["F"]))["modularity"] == 0.0
    two = np.kron(np.eye(2), np.ones((3, 3)) - np.eye(3))
    assert math.isclose(G.modularity(two), 0.5)


def plain_bars(points):
    """Loops by reducing all triangles in order of diameter."""
    n = len(points)
    dist = np.linalg.norm(points[:, None] - points[None], axis=2)
    edges = sorted((dist[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    rank = {(a, b): k for k, (_, a, b) in enumerate(edges)}
    columns, out = {}, []
    for *_, faces in sorted((max(f), sorted(f, reverse=True), f) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n) for f in [(rank[a, b], rank[a, c], rank[b, c])]):
        column = set(faces)
        while column and max(column) in columns:
            column ^= columns[max(column)]
        if column:
            columns[max(column)] = column
            out.append((edges[max(column)][0], edges[max(faces)][0]))
    return sorted((b, d) for b, d in out if d > b)


def test_homology_against_all_triangles():
    rng = np.random.default_rng(3)
    for n in (4, 9, 14):
        x = rng.normal(size=(n, 2))
        assert np.allclose(sorted(map(tuple, H.bars(x)[1])), plain_bars(x))
    assert len(H.bars(rng.normal(size=(120, 13)))[0]) == 119


def test_path_types_against_single_steps():
    rng = np.random.default_rng(4)
    for _ in range(20):
        b = rng.choice(list("FVBRSHC"), int(rng.integers(1, 25)))
        n = len(b)
        edges = [(i, i + 1, 0) for i in range(n - 1)] + [(i, j, 1) for i in range(n) for j in range(i + 3, n) if b[i] == b[j]]
        edges += [(i, max(k for k in range(i) if b[k] in "FV"), 2) for i in range(n) if b[i] in "XRBS" and any(x in "FV" for x in b[:i])]
        d, kind = np.full((n, n), 99), np.zeros((n, n), int)
        np.fill_diagonal(d, 0)
        for i, j, k in edges:
            if d[i, j] > 1:
                d[i, j] = d[j, i] = 1
                kind[i, j] = kind[j, i] = k
        for k in range(n):
            for i in range(n):
                for j in range(n):
                    if d[i, k] + d[k, j] < d[i, j]:
                        d[i, j], kind[i, j] = d[i, k] + d[k, j], max(kind[i, k], kind[k, j])
        steps, got = G.path_types(b)
        assert (steps == np.minimum(d, G.MAX_PATH)).all() and (got == kind).all()


@pytest.mark.parametrize("few", [100_000, 3])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=500).tolist(), [3.0] * 40 + [7.0], rng.integers(0, 9, 100).astype(float).tolist(), [1.0]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert np.allclose(R.quantiles(rows, "v", [0, 0.1, 0.5, 0.9, 1]), np.quantile(values, [0, 0.1, 0.5, 0.9, 1]))
    assert math.isnan(R.quantiles(rows.limit(0), "v", [0.5])[0])


def test_homology_of_a_circle():
    t = np.linspace(0, 2 * np.pi, 20, endpoint=False)
    h0, h1 = H.bars(np.stack([np.cos(t), np.sin(t)], 1))
    assert len(h0) == 19 and np.allclose(h0, 2 * np.sin(np.pi / 20))
    long = h1[:, 1] - h1[:, 0]
    assert (long > 1).sum() == 1
    assert H.features(np.zeros((2, 3)))["h0_n_bars"] == 0.0


def test_checked_join_fails_on_disagreement(spark):
    a, b = spark.createDataFrame([(1, 1)], "k int, y int"), spark.createDataFrame([(1, 0, 5)], "k int, y int, x int")
    assert R.label_disagreements(a, b, ["k"], "y").first()["n_disagree"] == 1
    with pytest.raises(Exception, match="labels disagree"):
        R.checked_join(a, b, ["k"], "y").collect()


def test_records(spark, tmp_path):
    (tmp_path / "math_qwen_traces.jsonl").write_text('{"item_id": "a", "full_response": "<think>some longer trace</think>42"}\n\nnot json\n')
    (tmp_path / "pilot_x.jsonl").write_text('{"item_id": "p"}\n')
    rows = records.read_jsonl(spark, str(tmp_path / "*.jsonl")).cache()
    assert {r["group"] for r in rows.collect()} == {"math_qwen"}
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1
    fixed = records.repaired(rows.where("item_id = 'a'")).first()
    assert (fixed["reasoning_trace"], fixed["answer_text"], fixed["trace_token_count"]) == ("some longer trace", "42", 3)
    out = str(tmp_path / "out")
    part = spark.createDataFrame([("g", 1), ("g", 2)], "group string, item_id int")
    assert records.append_new(part.limit(1), out, ["item_id"]).count() == 1
    records.append_new(part, out, ["item_id"])
    assert spark.read.parquet(out).count() == 2
    family = str(tmp_path / "family")
    records.write_family(part, family)
    records.write_family(part.union(spark.createDataFrame([("h", 3)], part.schema)), family)
    assert spark.read.parquet(family).count() == 3


def test_out_of_fold(spark):
    rows = E.stratified_folds(spark.createDataFrame([(i, "g", i % 2, float(i % 2) + (i % 7) / 10) for i in range(40)], "item_id long, grp string, y int, x double"), ["grp", "y"], "item_id", 2)
    out = M.out_of_fold(rows, ["x"], "lr", 2)
    assert out.count() == 40
    assert E.auroc_ci(out, ["grp"]).first()["auroc"] > 0.9


def test_archives(spark, tmp_path):
    from tracelore.sources import npz

    np.savez(tmp_path / "a_traces.npz", item_ids=np.array(["x", "y"]), groups=np.array(["g", "g"]), y_true=np.array([0, 1]), oof_prob=np.array([0.1, 0.9]))
    rows = npz.read_predictions(spark, str(tmp_path)).orderBy("item_id").collect()
    assert [(r["item_id"], r["y_true"], r["oof_prob"], r["oof_fold"]) for r in rows] == [("x", 0, 0.1, None), ("y", 1, 0.9, None)]
    steps = tmp_path / "steps"
    steps.mkdir()
    np.savez(steps / "math_qwen.npz", item_ids=np.array(["x", "y"]), is_correct=np.array([0, 1]), offsets=np.array([0, 1, 3]), embeddings=np.ones((3, 4)))
    out = npz.by_dimension(npz.read_steps(spark, str(steps))).first()
    assert (out["group"], out["dimension"], out["n_items"], out["n_steps"]) == ("math_qwen", 4, 2, 3)


def test_aligned_distances_of_all_classes_without_a_join(spark):
    traces = [(1, 0, "FVBFV"), (2, 0, "FV"), (3, 1, "CCCFV"), (4, -1, "FVBBB" * 600), (5, None, "HHH")]
    s = spark.createDataFrame(traces, "item_id long, y long, seq string")
    got = shapelets.aligned(s, shapelets.candidates(s, by=("y",)))
    grams = {y: {q[i : i + k] for _, z, q in traces if z == y for k in shapelets.LENGTHS for i in range(len(q) - k + 1)} for y in (0, 1, -1, None)}
    names = set().union(*grams.values())

    def dist(y, q, g):
        ways = [sum(a != b for a, b in zip(q[i : i + len(g)], g, strict=True)) for i in range(len(q) - len(g) + 1)]
        return min(ways) / len(g) if ways and y is not None and g in grams[y] else 1.0

    want = sorted((i, len(g), g, dist(y, q, g)) for i, y, q in traces for g in names)
    assert sorted((r["item_id"], r["k"], r["gram"], r["dist"]) for r in got.collect()) == want
    assert "Join" not in got._jdf.queryExecution().toString()


def test_tfidf_of_all_folds_is_that_of_each_fold(spark):
    texts = [f"{'good fine' if i % 2 else 'poor weak'} word{i % 3} twice twice only{i} {'rare' + str(i % 7)}" for i in range(24)]
    rows = spark.createDataFrame([(i, "a", i % 2, i // 2 % 2, t) for i, t in enumerate(texts)], "item_id long, grp string, y int, fold int, text string").cache()
    want = {r["item_id"]: r["p"] for k in range(2) for r in M.probabilities(M.tfidf(rows.where(f"fold <> {k}")), rows.where(f"fold = {k}"), [], ["item_id"]).collect()}
    got = {r["item_id"]: r["p"] for r in M.tfidf_out_of_fold(rows, storage.stored, folds=2).collect()}
    assert got == pytest.approx(want, abs=1e-4) and len(got) == 24


def test_vocabularies_of_folds(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "a", "b"]), (2, 0, ["a", "c"]), (3, 1, ["d", "d", "d", "b", "c"]), (4, 1, ["c", "b"])], "item_id long, fold int, terms array<string>")
    assert M.fold_vocabularies(rows, 2, 9) == [["b", "c"], ["a"]]
    assert M.fold_vocabularies(rows, 2, 1) == [["b"], ["a"]]


def test_first_of_equal_windows_whatever_the_order_of_values(spark):
    """Sums of doubles differ by the order of equal values; of equal stretches the first is returned. NaN and infinity stay in their windows."""
    one = [0.3, 0.2, 0.1, 0.0, 0.0, 0.1, 0.2, 0.3]
    two = [0.1, 0.3, 0.2, 0.0, math.inf, 0.0, 0.0, 0.0]
    three = [math.nan, 0.3, 0.2, 0.1, 0.0, 0.1, 0.2, 0.3]
    rows = [(k, t, -x, x) for k, values in enumerate((one, two, three)) for t, x in enumerate(values)]
    tokens = spark.createDataFrame(rows, "item_id int, t long, logprob double, entropy double")
    got = {r["item_id"]: r for r in T.bursts(tokens, window=3, smooth=3).collect()}
    assert 0.3 + 0.2 + 0.1 < 0.1 + 0.2 + 0.3 and got[0]["max_window_pos"] == got[0]["entropy_peak_pos"] == 0.0
    assert got[0]["max_window_nll"] == pytest.approx(0.2) and got[0]["entropy_collapse"] == pytest.approx(0.2 - 0.1 / 3)
    assert got[1]["max_window_nll"] == math.inf and got[1]["max_window_pos"] == pytest.approx(2 / 5)
    assert math.isnan(got[2]["max_window_nll"]) and got[2]["max_window_pos"] == pytest.approx(1 / 5)
