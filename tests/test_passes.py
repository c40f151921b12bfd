"""Passes over an instrument's bars in order: what they take over from windows and groups, and that batches don't matter."""

import numpy as np
import pandas as pd
import pytest

from tidebars.operators import backtest, cost, features


def _bars(spark, codes=3, rows=300):
    draw = np.random.default_rng(8)
    parts = []
    for k in range(codes):
        n = rows - 90 * k
        close = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, n)))
        parts.append(pd.DataFrame({"code": f"{k:06d}", "date": pd.date_range("2020-01-01", periods=n).date, "open": close, "high": close * 1.02, "low": close * 0.97, "close": close, "volume": draw.integers(1, 90, n) * 1.0, "amount": 5.0, "turnover": draw.integers(1, 90, n) / 10}))
    return spark.createDataFrame(pd.concat(parts))


def _nodes(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _sorted(df, *keys):
    return df.toPandas().sort_values(list(keys), ignore_index=True)


def _in_small_batches(spark, df, *keys):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        return _sorted(df, *keys)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bases_are_not_searched_for_in_arrays_of_every_row(spark):
    """53 candidates a row, each a struct of a window's lag, were over half the time of the feature panel."""
    plan = _nodes(features.feature_panel(_bars(spark, 1, 5)))
    assert "array_min" not in plan and "lag(_base" not in plan


def test_the_best_base_is_the_first_of_least_quality(spark):
    rows = _sorted(features.feature_panel(_bars(spark, 1)), "code", "date")
    close, high, low = (rows[c].to_numpy() for c in ("close", "high", "low"))
    for t in (60, 150, 299):
        found = []
        for o in range(4, 21):
            s = t - o
            top, floor = high[s - 19 : s + 1].max(), low[s - 19 : s + 1].min()
            found.append(((top / floor - 1) * 100 + abs((close[s] / close[s - 19] - 1) * 100) * 0.6 + o * 0.15, o, top))
        best = min(found, key=lambda x: x[0])
        assert (rows["rebound_base_quality"][t], rows["rebound_base_offset"][t], rows["rebound_base_high"][t]) == pytest.approx(best, rel=1e-12)


def test_bases_move_over_batches(spark):
    df = features.feature_panel(_bars(spark)).select("code", "date", *features._base_columns("adaptive_base"), *features._base_columns("rebound_base")[1:])
    pd.testing.assert_frame_equal(_sorted(df, "code", "date"), _in_small_batches(spark, df, "code", "date"), check_exact=True)


def test_rows_of_the_cost_panel_are_sent_once(spark):
    """bars went to every block that looks back on them, as pandas groups."""
    plan = _nodes(cost.cost_distribution_panel(_bars(spark, 1, 5)))
    assert "FlatMapGroupsInPandas" not in plan and "Generate explode" not in plan


def test_the_cost_panel_does_not_depend_on_batches(spark):
    df = cost.cost_distribution_panel(_bars(spark), start="2020-03-01")
    whole = _sorted(df, "code", "date")
    assert len(whole) == 300 + 210 + 120 - 3 * 60
    pd.testing.assert_frame_equal(whole, _in_small_batches(spark, df, "code", "date"), check_exact=True)
    last = _sorted(cost.cost_profile(_bars(spark)), "code")
    pd.testing.assert_frame_equal(whole.groupby("code").tail(1).reset_index(drop=True), last, rtol=1e-9)


def test_peaks_by_height_then_place():
    draw = np.random.default_rng(2)
    heights = draw.integers(0, 9, (60, 40)).astype(float) + (np.arange(60) % 2 * 0.5)[:, None]
    one, two, counts = cost._peaks(heights, 4)
    for h, a, b, n in zip(heights, one, two, counts, strict=True):
        edged, chosen = np.concatenate(([0.0], h, [0.0])), []
        tops = np.flatnonzero((h >= edged[:-2]) & (h >= edged[2:]) & (h >= h.max() * 0.2))
        for i in sorted(tops.tolist(), key=lambda i: (-h[i], -i)):
            if all(abs(i - j) >= 4 for j in chosen):
                chosen.append(i)
        assert (a, b, n) == (chosen[0], chosen[1] if len(chosen) > 1 else -1, len(chosen))


def test_outcomes_gather_no_lists(spark):
    assert "collect_list" not in _nodes(backtest.forward_outcomes(_bars(spark, 1, 5)))


def test_a_scan_works_out_the_last_bars_alone(spark):
    """a scan's features were worked out for every bar, of which it reads one a code."""
    bars = _bars(spark, 4, 400)
    held = features.in_order(features.prepared(bars), features.READ, 130).groupBy("code").count().collect()
    assert [r["count"] for r in held] == [130] * 4
    want = features.latest_snapshot(features.feature_panel(bars)).drop("bars")
    for small in (False, True):
        last = features.latest_features(bars)
        got = _in_small_batches(spark, last, "code") if small else _sorted(last, "code")
        assert got["bars"].tolist() == [400, 310, 220, 130]
        pd.testing.assert_frame_equal(got[want.columns], _sorted(want, "code"), rtol=1e-9)


def test_a_scan_reads_no_feature_of_older_bars(spark, sf_dir):
    import __spark_entry__  # noqa: F401
    from tidebars.plans import catalog, runs
    from tidebars.sources import fixture

    bars = fixture.load_bars(spark, sf_dir)
    steps = runs.scan_steps(bars, fixture.load_universe(spark, sf_dir), fixture.load_benchmark(spark, sf_dir), fixture.load_flow(spark, sf_dir), catalog.AS_OF, catalog.FIXTURE, mainboard=False)
    assert "_left" in steps["scored"]({"status": steps["status"]})._jdf.queryExecution().analyzed().toString()


def test_eligible_rows_work_out_what_they_read(spark, sf_dir):
    """bases, costs and signals of every bar were worked out for rows that show none of them."""
    import __spark_entry__
    from tidebars.plans import catalog

    found = __spark_entry__.queries()["eligible_rows"](spark, sf_dir)
    assert "MapInArrow" not in _nodes(found)
    want = catalog._judged(spark, sf_dir).select("code", "date", "bars", "outcome_success")
    pd.testing.assert_frame_equal(_sorted(found, "code", "date"), _sorted(want, "code", "date"))
    assert found.count()
