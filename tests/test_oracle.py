"""Every catalogue query against its DuckDB oracle SQL (the driver's check), at sf0.001."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry
from matingstats.plans.catalog import oracle_sql, queries
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["yob", "strategy", "n_pairs"]
    assert df.count() > 0


def test_every_query_has_sql_or_is_a_model():
    rows_only = set(queries()) - set(oracle_sql())
    assert rows_only == {"fisher_colony_mc", "fisher_colony_mc_refined", "fisher_mc_estimates"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert _canon(cols, rows) == _canon(dcols, drows)
