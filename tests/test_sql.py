"""Queries over the given tables against their SQL, row by row."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

NAMES = ("cost_profile", "cost_distribution_panel", "scores", "funnel_counts", "near_misses", "ewm", "watchlist_replay", "signals_with_outcomes", "scan", "publish_history", "publish_run")


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_those_of_the_sql(spark, sf_dir, engine, name):
    got, want = __spark_entry__.queries()[name](spark, sf_dir).toPandas(), engine.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    columns = sorted(got.columns)
    keys = [c for c in ("code", "date", "last_evaluated_date", "signal", "step_number", "k", "session", "artefact", "year") if c in columns]
    for df in (got, want):
        for c in columns:
            if c in ("date", "as_of") or c.endswith("_date"):
                df[c] = pd.to_datetime(df[c]).astype("datetime64[ns]")
    got, want = (df[columns].sort_values(keys).reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1.5e-6)
