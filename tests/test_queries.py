"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from docloom.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_progress_ends_after_its_start(spark, duck, tmp_path):
    events = "SELECT i AS event_id, ts, user_id, event_type, [0.99, 1.0, 1.01, 2.0, 0.0][i // 4 % 5 + 1]::DOUBLE AS value, props FROM (SELECT *, event_id AS i FROM events)"
    duck.execute(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = duck.execute(registry.ORACLE_SQL["progress_states"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet')")).df()
    assert rows(registry.QUERIES["progress_states"](spark, str(tmp_path)).toPandas()) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
