"""Every query with SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidewater.plans import mining, queries, tasks  # noqa: F401  (they register)
from tidewater.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Their tables have no such rows at this size.
MAY_BE_EMPTY: set[str] = set()


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def text(x: object) -> str:
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return ""
        return f"{x:.7g}" if isinstance(x, float) else str(x)

    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) or name in MAY_BE_EMPTY
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
