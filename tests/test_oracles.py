"""Every query against its SQL in DuckDB, on the small tables."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from dubflow.plans import catalog

DATA = os.environ.get("DUBFLOW_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got) > 0
    if name in catalog.ORACLES:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
        want = db.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
