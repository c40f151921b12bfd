"""Frames worked out in one pass over the bars in order."""

import numpy as np
import pandas as pd
import pytest

from tidebars.functions import frames
from tidebars.operators import cost, features

LONG = 20  # rows of a window frame that is still worked out row by row


@pytest.mark.parametrize("n,m,k", [(1, None, 0), (5, None, 0), (20, 10, 1), (60, 30, 0), (120, 80, 3), (250, 120, 0)])
@pytest.mark.parametrize("rows", [0, 1, 4, 130, 400])
def test_frames_are_those_of_each_row_alone(n, m, k, rows):
    draw = np.random.default_rng(rows + n)
    x = np.where(draw.random(rows) < 0.2, np.nan, draw.integers(1, 500, rows) / 10)
    for func, plain in (("max", np.max), ("min", np.min), ("avg", np.mean), ("sum", np.sum)):
        got = frames.rolling(func, x, n, m, k)
        for t in range(rows):
            frame = x[max(0, t - k - n + 1) : max(0, t - k + 1)]
            frame = frame[~np.isnan(frame)]
            if len(frame) >= (m or n):
                assert got[t] == pytest.approx(plain(frame), rel=1e-12)
            else:
                assert np.isnan(got[t])


def test_std_of_whole_frames():
    x = np.random.default_rng(3).random(90)
    assert np.allclose(frames.rolling("std", x, 20), pd.Series(x).rolling(20).std(ddof=0), equal_nan=True)
    assert (frames.rolling("std", np.full(40, 0.1), 20)[19:] == 0).all()


def _bars(spark, codes=3, rows=300):
    draw = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=rows).date
    parts = []
    for k in range(codes):
        close = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, rows)))
        parts.append(pd.DataFrame({"code": f"{k:06d}", "date": days, "open": close, "high": close * 1.02, "low": close * 0.97, "close": close, "volume": draw.integers(1, 90, rows) * 1.0, "amount": 5.0, "turnover": draw.integers(1, 90, rows) / 10}))
    return spark.createDataFrame(pd.concat(parts))


def test_frames_move_over_batches(spark):
    bars, columns = _bars(spark), ["code", "date", *features.FRAMES]
    whole = features.in_order(bars).select(columns).toPandas().sort_values(["code", "date"], ignore_index=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cut = features.in_order(bars).select(columns).toPandas().sort_values(["code", "date"], ignore_index=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(whole, cut, check_exact=True)
    assert whole["_max_high_250_120_0"].notna().sum() == 3 * (300 - 119)


def _long_frames(df) -> list[str]:
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    found = re.findall(r"specifiedwindowframe\(RowFrame, -?(\w+)\$?\(?\)?, -?(\w+)", plan)
    return [x for x in found if x[0].isdigit() and int(x[0]) - (int(x[1]) if x[1].isdigit() else 0) >= LONG]


def test_no_long_frame_is_worked_out_row_by_row(spark):
    """A window frame of n rows costs n steps a row: half the time of the panel."""
    assert not _long_frames(features.feature_panel(_bars(spark, 1, 5)))


def test_no_long_frame_in_the_cost_panel(spark):
    assert not _long_frames(cost.cost_distribution_panel(_bars(spark, 1, 5)))
