"""Every query with SQL against DuckDB on the smallest tables, and every other one for rows."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return "null"
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    return str(float(value)) if isinstance(value, numbers.Number) and not isinstance(value, bool | np.bool_) else str(value)


def plain(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        want = con.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["block_bootstrap_ci", "paired_bootstrap_ci", "alpha_bootstrap_ci"])
def test_bootstraps_run_all_replicates(spark, sf, name):
    from __spark_entry__ import queries

    assert {r.n for r in queries()[name](spark, sf).collect()} == {1000}
