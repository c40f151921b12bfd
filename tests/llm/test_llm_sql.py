"""Training-data queries over the given tables against their SQL, row by row."""

import duckdb
import pandas as pd
import pytest

from tidebars.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_those_of_the_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for view in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf_dir}/{view}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    key = next(c for c in ("page_id", "conv_id", "doc_id") if c in columns)
    got, want = (df[columns].sort_values(key).reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None), check_dtype=False)
