"""Features, cost model, signals, flow, watchlist and backtest on hand-written bars."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.functions import frames
from tidebars.operators import backtest, cost, features, flow, market, signals, watchlist
from tidebars.plans.params import Params

DAY = date(2024, 1, 1)


def bars(spark, closes, code="000001", turnover=2.0, opens=None):
    closes, opens = [float(c) for c in closes], [float(o) for o in (closes if opens is None else opens)]
    rows = [(code, DAY + timedelta(i), o, max(o, c) + 1.0, min(o, c) - 1.0, c, 1000.0 + i, (1000.0 + i) * c, turnover) for i, (c, o) in enumerate(zip(closes, opens, strict=True))]
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double, turnover double")


def test_rsi_limits_and_moving_means(spark):
    up = features.trend(bars(spark, range(100, 139))).orderBy("date").collect()
    flat = features.trend(bars(spark, [100] * 40)).orderBy("date").collect()
    assert up[-1]["rsi14"] == 100.0 and flat[-1]["rsi14"] == 50.0 and up[13]["rsi14"] is None and up[14]["rsi14"] == 100.0
    assert up[4]["ma5"] == 102.0 and up[3]["ma5"] is None


def test_ewm_equals_the_recursion(spark):
    x = np.random.default_rng(1).uniform(50, 150, 300)
    got = [r["dif"] for r in features.trend(bars(spark, x)).orderBy("date").collect()]
    fast = slow = x[0]
    want = []
    for v in x:
        fast, slow = fast + 2 / 13 * (v - fast), slow + 2 / 27 * (v - slow)
        want.append(fast - slow)
    assert np.allclose(got, want, atol=1e-9)


def test_baselines_exclude_the_current_bar(spark):
    df = features.volumes(features.fill_change_cols(features.clean_bars(bars(spark, range(100, 130))))).orderBy("date").collect()
    assert df[20]["vma20_prev"] == pytest.approx(np.mean([1000 + i for i in range(20)])) and df[19]["vma20_prev"] is None


def test_later_bars_never_change_earlier_features(spark):
    x = np.random.default_rng(2).uniform(80, 120, 160).round()
    columns = ["adaptive_base_quality", "rebound_base_quality", "breakout_20", "position_120"]
    whole = features.feature_panel(bars(spark, x)).orderBy("date").select(columns).collect()
    part = features.feature_panel(bars(spark, x[:150])).orderBy("date").select(columns).collect()
    assert whole[:150] == part


def test_cost_distribution_equals_the_daily_recurrence(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(80, 120, 100)
    one = bars(spark, x).withColumn("turnover", F.when(F.day("date") == 9, 100.0).when(F.day("date") == 15, F.lit(None)).otherwise(F.col("turnover")))
    mass = {r["bin"]: r["mass"] for r in cost.cost_distribution_asof(one, lookback=60).collect()}
    shares = {}
    for r in cost.daily_mass(one).collect():
        shares.setdefault(r["date"], {})[r["bin"]] = r["share"]
    want, entries = {}, []
    for i, r in enumerate(one.orderBy("date").collect()):
        if r["turnover"] is not None:
            rate = r["turnover"] / 100
            entries = [(j, w * (1 - rate), s) for j, w, s in entries if w * (1 - rate) > 0] + [(i, rate, shares[r["date"]])]
        entries = [e for e in entries if e[0] > i - 60]
    for _, w, s in entries:
        for b, p in s.items():
            want[b] = want.get(b, 0) + w * p
    assert set(mass) >= {b for b, m in want.items() if m > 1e-12} and all(mass[b] == pytest.approx(m, abs=1e-12) for b, m in want.items() if m > 1e-12)
    profile = cost.cost_profile(one).first()
    assert profile["chip_profit_ratio_pct"] + profile["chip_overhead_ratio_pct"] == pytest.approx(100) and profile["chip_70_low"] <= profile["chip_peak_price"] * 1.5


def test_cost_panel_equals_the_profile_of_every_prefix(spark):
    rng = np.random.default_rng(5)
    x = np.exp(np.cumsum(rng.normal(0, 0.03, 130))) * 60
    late = [F.when(F.day("date") == 9, 100.0).when(F.day("date") == 15, F.lit(None)).otherwise(F.col("turnover")), F.when(F.day("date") == 20, F.col("open")).otherwise(F.col("low")), F.when(F.day("date") == 20, F.col("open")).otherwise(F.col("high"))]
    one = bars(spark, x).withColumns(dict(zip(("turnover", "low", "high"), late, strict=True))).withColumn("close", F.when(F.col("high") == F.col("low"), F.col("low")).otherwise(F.col("close")))
    one = one.unionByName(bars(spark, x[:3], code="000002", turnover=0.0)).cache()
    got = {r["date"]: r for r in cost.cost_distribution_panel(one, lookback=60, block=16).collect()}
    assert len(got) == 130 and {r["code"] for r in got.values()} == {"000001"}
    ends = [DAY + timedelta(i) for i in (0, 7, 8, 9, 14, 29, 59, 60, 77, 129)]
    prefixes = one.where("code = '000001'").join(F.broadcast(spark.createDataFrame([(e,) for e in ends], "end date")), F.col("date") <= F.col("end")).withColumn("code", F.col("end").cast("string"))
    want = cost.cost_profile(prefixes, lookback=60).collect()
    assert len(want) == len(ends)
    for r in want:
        for c in set(r.asDict()) - {"code"}:
            assert got[r["date"]][c] == (pytest.approx(r[c], abs=1e-8) if isinstance(r[c], float) else r[c]), (r["date"], c)
    assert cost.cost_distribution_panel(one.limit(0)).count() == 0


def test_ranks_take_the_mean_of_ties_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 20.0), (1, None)], "date int, x double")
    got = sorted(((r["x"] or 0, r["r"]) for r in signals.pct_rank_average(df, "x", "r").collect()), key=str)
    assert got == [(0, None), (10.0, 0.5), (10.0, 0.5), (20.0, 1.0)]


def scored(spark, **more):
    values = dict(
        code="000001", bars=200, amount_ma20_prev=5e7, one_price_limit=0, base_high_20_pre3=10.0, chip_peak_price=9.0, chip_model_coverage_pct=95.0, position_250=0.3, adaptive_base_position_120=0.3,
        adaptive_base_drawdown_120_pct=-20.0, adaptive_pre_base_decline_60_pct=-12.0, adaptive_base_high=10.0, adaptive_base_width_pct=12.0, adaptive_base_return_pct=2.0, adaptive_base_window=40, adaptive_base_offset=3,
        adaptive_base_turnover_sum_pct=20.0, chip_peak_band_share_pct=26.0, chip_70_width_pct=15.0, chip_peak_position=0.2, chip_peak_dominance=2.0, chip_significant_peak_count=1, chip_low_zone_share_pct=50.0,
        distribution_day_count_5=0.0, breakout_failed_fast=0, breakout_stall_distribution=0, benchmark_risk_ok=1, distance_from_adaptive_base_high_pct=-1.0, adaptive_launch_price_action=0, adaptive_ready_price_action=1,
        adaptive_rebound_price_action=0, adaptive_trend_votes=1, return_5d_pct=0.0, return_10d_pct=0.0, return_20d_pct=0.0, chip_peak_distance_pct=3.0, vol_ratio_20=1.0, up_down_volume_ratio_10=1.0, macd_rising=0,
    )
    values |= more
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if k == 'code' else 'int' if isinstance(v, int) and v is not None else 'double'}" for k, v in values.items()))


def test_scores_gates_and_funnel(spark):
    p = Params()
    row = signals.scores(scored(spark)).first()
    # base 12 + 8 + 4 + 3, profile 12 + 10 + 5 + 4 + 4, context 6 + 4 counted at -20, 5, 4 + 2 at -12, capped at 15, risk 5
    assert (row["chip_score_base"], row["chip_score_profile"], row["chip_score_context"], row["chip_score_risk"]) == (27, 35, 15, 5)
    ready = signals.select_signals(signals.scores(scored(spark)), p).collect()
    assert [r["signal"] for r in ready] == ["chip_base_ready"]
    launch = signals.select_signals(signals.scores(scored(spark, adaptive_launch_price_action=1, adaptive_trend_votes=4)), p).collect()
    assert [r["signal"] for r in launch] == ["chip_base_launch"]
    both = signals.scores(scored(spark).unionByName(scored(spark, code="000002", bars=10)))
    tail = {r["signal"]: r["remaining_count"] for r in signals.funnel_counts(both, p).where("step_number = 9").collect()}
    assert tail == {"chip_base_ready": 1, "chip_base_launch": 0, "chip_base_rebound": 0}
    miss = signals.near_misses(both, p).collect()
    assert [(r["code"], r["failed_at"], r["closest_signal"]) for r in miss] == [("000002", "history_bars", "chip_base_ready")]


def test_missing_distance_does_not_hide_a_failed_break(spark):
    df = signals.scores(scored(spark, breakout_failed_fast=1).withColumn("distance_from_adaptive_base_high_pct", F.lit(None).cast("double")))
    assert signals.signal_masks(df, Params()).first()["chip_base_ready"] is True


def test_outcomes(spark):
    rows = [("a", DAY + timedelta(i), o, h, low, o) for i, (o, h, low) in enumerate([(100.0, 101.0, 99.0), (100.0, 105.0, 97.0), (100.0, 115.0, 90.0), (100.0, 101.0, 99.0), (100.0, 101.0, 99.0)])]
    df = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double")
    got = backtest.forward_outcomes(df, 2, 12.0, 6.0).orderBy("date").collect()
    assert [r["outcome_success"] for r in got] == [0, 0, 0, None, None] and got[0]["drawdown_before_target_pct"] == pytest.approx(-10)


def test_flow(spark):
    rows = [("a", DAY + timedelta(i), 5.0) for i in range(20)] + [("b", DAY + timedelta(i), -1.0) for i in range(5)]
    out = {r["code"]: r for r in flow.flow_summary(spark.createDataFrame(rows, "code string, date date, main_net_inflow_amount double"), "2024-01-20").collect()}
    assert out["a"]["fund_flow_all_windows_positive"] == 1 and out["a"]["main_net_inflow_20d_amount"] == 100
    assert out["b"]["main_net_inflow_10d_amount"] is None and out["b"]["fund_flow_rank_reason"] == "stale since 2024-01-05"


def test_watchlist(spark):
    days = spark.createDataFrame([(DAY + timedelta(i), i + 1) for i in range(40)], "date date, session_no int")
    picked = spark.createDataFrame([("a", "chip_base_launch", 80.0, 10.0, 11.0, 9.0), ("a", "chip_base_ready", 80.0, 10.0, 11.0, 9.0)], "code string, signal string, score_total double, close double, resistance_price double, support_price double")
    empty, market_rows = spark.createDataFrame([], watchlist.COLUMNS), spark.createDataFrame([("a", 10.0)], "code string, close double")
    first = watchlist.watchlist_update(empty, picked, market_rows, days, "2024-01-02", 3)
    row = first.first()
    assert (row["state"], row["signals"], row["age_sessions"], row["trigger_price"], str(row["expires_date"])) == ("TRIGGER", "chip_base_launch,chip_base_ready", 0, 10.0, "2024-01-05")
    assert watchlist.watchlist_transitions(first).first()["from_state"] == "NEW"
    again = watchlist.watchlist_update(first.drop("old_state"), picked, market_rows, days, "2024-01-02", 3)
    assert watchlist.watchlist_transitions(again).count() == 0 and again.first()["age_sessions"] == 0
    none = picked.limit(0)
    fell = watchlist.watchlist_update(first.drop("old_state"), none, spark.createDataFrame([("a", 8.0)], "code string, close double"), days, "2024-01-04", 3).first()
    assert (fell["state"], fell["age_sessions"]) == ("INVALID", 2)
    late = watchlist.watchlist_update(first.drop("old_state"), none, market_rows, days, "2024-01-09", 3).first()
    assert late["state"] == "EXPIRED"
    gone = watchlist.watchlist_update(first.drop("old_state"), none, market_rows.limit(0), days, "2024-01-09", 3).first()
    assert (gone["state"], gone["data_status"]) == ("TRIGGER", "missing_today")


def test_universe_and_merge(spark):
    u = spark.createDataFrame([("1", "plain", False), ("600000", "*ST x", False), ("600001", "leaving", True), ("300001", "other board", False)], "code string, name string, is_delisting boolean")
    assert [r["code"] for r in market.filter_universe(u).collect()] == ["000001"]
    old = spark.createDataFrame([("a", DAY + timedelta(i), 10.0) for i in range(5)], "code string, date date, close double")
    new = spark.createDataFrame([("a", DAY + timedelta(i), 10.01) for i in range(2, 7)] + [("b", DAY, 1.0)], "code string, date date, close double")
    merged, rebuild = market.merge_incremental(old, new)
    assert merged.count() == 7 and [r["code"] for r in rebuild.collect()] == ["b"]
    assert [r["x"] for r in spark.createDataFrame([("1,234.5",), ("7%",), ("-",)], "s string").select(market.parse_number(F.col("s")).alias("x")).collect()] == [1234.5, 7.0, None]


@pytest.mark.parametrize("alpha", [2 / 13, 2 / 10, 1 / 14, 0.6, 0.01])
def test_exponential_mean_of_a_long_history(spark, alpha):
    """Equal to the recursion over 20,000 bars, gaps included."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(20_000) < 0.05, np.nan, 100 + rng.standard_normal(20_000).cumsum())
    rows = [("a", DAY + timedelta(i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("b", DAY + timedelta(i), 7.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "code string, date date, x double").repartition(3)
    got = {(r["code"], r["date"]): r["m"] for r in frames.with_ewm(df, "m", "x", alpha).collect()}
    mean = None
    for code, date, v in rows[:20_000]:
        mean = v if mean is None else mean if v is None else mean + alpha * (v - mean)
        assert got[code, date] is None if mean is None else v is None or got[code, date] == pytest.approx(mean, rel=1e-9)
    assert all(got["b", DAY + timedelta(i)] == pytest.approx(7.0, rel=1e-9) for i in range(4000))


def test_codes_sessions_and_merges_at_their_edges(spark):
    codes = spark.createDataFrame([("1",), ("600000",), ("1234567",)], "code string")
    assert [r["c"] for r in codes.select(market.normalize_code(F.col("code")).alias("c")).collect()] == ["000001", "600000", "1234567"]
    days = spark.createDataFrame([(DAY + timedelta(i), n + 1) for n, i in enumerate((0, 1, 4, 5))], "date date, session_no int")
    pairs = [(0, 5), (2, 5), (0, 3), (2, 3), (5, 0), (4, 4), (-9, 9)]
    frame = spark.createDataFrame([(DAY + timedelta(a), DAY + timedelta(b)) for a, b in pairs], "start date, end date")
    got = {((r["start"] - DAY).days, (r["end"] - DAY).days): r["n"] for r in market.sessions_between(frame, days).collect()}
    assert got == {(0, 5): 3, (2, 5): 1, (0, 3): 1, (2, 3): 0, (5, 0): 0, (4, 4): 0, (-9, 9): 3}
    old = spark.createDataFrame([("a", DAY + timedelta(i), 10.0) for i in range(5)], "code string, date date, close double")
    new = spark.createDataFrame([("a", DAY + timedelta(i), 10.0 if i < 2 else None) for i in range(5)], "code string, date date, close double")
    assert [r["code"] for r in market.merge_incremental(old, new)[1].collect()] == ["a"]


def test_frames_with_the_fixed_base_alone(spark):
    df = spark.createDataFrame([("a", 11.0, 10.0, 12.0, 1), ("b", 9.0, None, None, 0)], "code string, close double, base_high_20_pre3 double, base_width_20_pre3_pct double, early_launch_price_action int")
    got = {r["code"]: r for r in signals.column_fallbacks(df).collect()}
    assert (got["a"]["adaptive_base_high"], got["a"]["adaptive_trend_votes"], got["a"]["adaptive_ready_price_action"], got["a"]["adaptive_base_offset"]) == (10.0, 3, 0, 3)
    assert got["a"]["distance_from_adaptive_base_high_pct"] == pytest.approx(10) and got["b"]["adaptive_base_width_pct"] is None and got["b"]["adaptive_ready_price_action"] == 1


def test_flags_of_signals(spark):
    flags = signals.signal_flags(signals.scores(scored(spark).unionByName(scored(spark, code="000002", bars=10))), Params())
    assert {(r["code"], r["any_signal"], r["signal_names"]) for r in flags.collect()} == {("000001", True, "chip_base_ready"), ("000002", False, "")}
