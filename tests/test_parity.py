"""Each query against its SQL, run by DuckDB over the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cladelake.plans import registry
from cladelake.plans.fixtures import TABLES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    number = (int, float, np.integer, np.floating)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, number) and not isinstance(x, bool) else x
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, db):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
        return
    want = db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
