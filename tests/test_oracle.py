"""Every SQL-expressible registered query equals its DuckDB oracle on the
sf0.001 tables (rows, columns and values)."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from pricewise.plans.oracle import ORACLE

TABLES = ["orders", "part", "customer", "documents"]


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and math.isnan(v))
                          else (round(float(v), 6) if isinstance(v, float) else v))
    df = df.astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_dir, con, name):
    got = E.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(_norm(got), _norm(want))


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["train_id", "cat_main", "brand_name", "name_len", "desc_len", "is_top_brand", "brand_encoded"]
