"""Every query with SQL against DuckDB on the smallest data, and the entry points."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tracelore.operators import modelling
from tracelore.plans import catalog
from tracelore.plans.model_queries import labelled


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = a[c].astype(float), b[c].astype(float)
            assert (((x - y).abs() <= 1e-9 + 1e-9 * y.abs()) | (x.isna() & y.isna())).all(), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["graph_descriptors", "embedding_homology", "structural_homology", "graph_paths", "parsed_episodes", "parsed_summary", "question_only", "column_importance"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_streamed_parse_is_that_of_the_batch(spark):
    streamed, batch = (catalog.QUERIES[q](spark, SF).toPandas() for q in ("streamed_parse", "parsed_episodes"))
    same(streamed[sorted(batch.columns)], batch)


@pytest.mark.parametrize("name", ["tfidf_baseline", "calibrated_lr", "stacked_lr"])
def test_every_labelled_row_is_predicted_once(spark, name):
    got = [r["item_id"] for r in catalog.QUERIES[name](spark, SF).select("item_id").collect()]
    assert sorted(got) == sorted(r["item_id"] for r in labelled(spark, SF).select("item_id").collect())


@pytest.mark.parametrize(("query", "kind", "option", "size"), [("stacked_forest", "RandomForestClassifier", "numTrees", 100), ("tfidf_baseline", "CountVectorizer", "vocabSize", 20_000)])
def test_models_have_their_default_size(spark, monkeypatch, query, kind, option, size):
    def stop(**options):
        raise StopIteration(options[option])

    monkeypatch.setattr(modelling, kind, stop)
    with pytest.raises(StopIteration) as seen:
        catalog.QUERIES[query](spark, SF)
    assert seen.value.value == size


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
