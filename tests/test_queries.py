"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their schema."""

from __future__ import annotations

import math

import duckdb
import pytest

from gridspark import queries as grid
from gridspark import corrector_queries, model_queries, replay_queries, rule_queries, stream_queries  # noqa: F401
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else repr(x)
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(grid.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = grid.QUERIES[name](spark, SF)
    rel = duck.sql(grid.ORACLE_SQL[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(grid.QUERIES) - set(grid.ORACLE_SQL)))
def test_runs(spark, name):
    df = grid.QUERIES[name](spark, SF)
    assert df.columns == df.toPandas().columns.tolist()


def test_names_agree():
    assert set(grid.ORACLE_SQL) <= set(grid.QUERIES)


def test_bootstrap_takes_all_draws(spark, monkeypatch):
    made = grid.metrics.paired_bootstrap
    seen = []
    monkeypatch.setattr(grid.metrics, "paired_bootstrap", lambda rows, *x, draws=2000, **y: seen.append(draws) or made(rows, *x, draws=draws, **y))
    assert grid.QUERIES["a23_paired_bootstrap"](spark, SF).count() > 0 and seen == [2000]
