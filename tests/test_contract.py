"""The driver's functions, and queries against their SQL."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.session import TABLES

SF = "/root/testdata/sf0.001"


def test_functions(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if pd.api.types.is_scalar(value) and pd.isna(value):
        return None
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)  # pandas turns whole numbers beside nulls to floats
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
