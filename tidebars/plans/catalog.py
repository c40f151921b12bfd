"""Every query over the bars and their companions, with the SQL that each is held against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import ago, pct
from ..operators import backtest as bt
from ..operators import carried, cost, features, flow, market, publish, replay, signals, watchlist
from ..sources import commits, fixture, history, landed
from ..streaming import transitions
from ..streaming import watchlist as stream
from . import ingest, runs
from . import reference_sql as ref
from .params import Params

C = F.col
AS_OF = "2001-12-31"
FIXTURE = Params(min_amount_ma20=2e4)

#: Columns of the panel by operator.
FAMILIES: dict[str, tuple[str, ...]] = {
    "fill_change_cols": ("pct_chg", "amplitude"),
    "sma": ("ma5", "ma10", "ma20", "ma30", "ma60", "ma120"),
    "ewm": ("dif", "dea"),
    "macd": ("dif", "dea", "macd_hist", "macd_rising", "dif_slope_3_pct"),
    "rsi": ("rsi14",),
    "returns": ("return_5d_pct", "return_10d_pct", "return_20d_pct", "return_60d_pct", "return_120d_pct"),
    "extension": ("extension_ma20_pct", "extension_ma60_pct"),
    "ma_slopes": ("ma5_slope_3_pct", "ma20_slope_5_pct", "ma30_slope_5_pct", "ma60_slope_5_pct"),
    "bull_alignment": ("bull_alignment_5_20_30",),
    "cross_ma5_up": ("cross_ma5_up",),
    "trend_votes": ("adaptive_trend_votes",),
    "prior_extremes": ("prior_high_5", "prior_high_20", "prior_high_60", "prior_low_20"),
    "dist_prior_high": ("dist_to_prior_high20_pct", "dist_to_prior_high60_pct"),
    "breakout_20": ("breakout_20", "close_above_prior_high5"),
    "recent_breakout": ("recent_breakout_level", "bars_since_breakout", "breakout_event_low", "breakout_event_close"),
    "retest": ("retest_distance_pct", "retest_touch"),
    "breakout_failed_fast": ("breakout_failed_fast",),
    "breakout_stall": ("breakout_stall_distribution",),
    "atr": ("atr14", "atr_pct", "atr_contraction_ratio"),
    "bollinger": ("bb_width_pct", "bb_contraction_ratio"),
    "contraction_expansion": ("contraction_then_expansion",),
    "range_width": ("range_width_10_pct", "range_width_20_pct", "range_width_60_pct", "range_width_120_pct", "range_convergence_ratio_20_60"),
    "range_position": ("position_120", "position_250", "range_position_10"),
    "wicks": ("upper_wick_ratio", "lower_wick_ratio"),
    "bar_patterns": ("upper_probe", "false_break_recovery", "support_acceptance", "resistance_test"),
    "pattern_counts": ("upper_probe_count_60", "false_break_recovery_count_60", "support_acceptance_count_60", "resistance_test_count_60"),
    "one_price_limit": ("one_price_limit",),
    "volume_baseline": ("vma20_prev", "amount_ma20_prev", "vol_ratio_20"),
    "volume_contraction": ("volume_contraction_5_20",),
    "turnover_ratio": ("turnover_ma20_prev", "turnover_ratio_20"),
    "updown_volume": ("up_down_volume_ratio_10",),
    "obv_slope": ("obv_slope_10_pct",),
    "pullback_volume": ("pullback_volume_ratio_5",),
    "turnover_peak": ("low_position_turnover_peak", "low_position_turnover_peak_count_60"),
    "distribution_day": ("distribution_day", "distribution_day_count_5"),
    "cost_moments": ("cost_center_60", "cost_concentration_60_pct", "distance_to_cost_center_pct"),
    "fixed_platform": ("base_high_20_pre3", "base_low_20_pre3", "base_mid_20_pre3", "base_width_20_pre3_pct", "base_close_cv_20_pre3_pct", "base_return_20_pre3_pct", "base_turnover_sum_20_pre3_pct", "base_drawdown_from_120_high_pct", "base_position_120_pre3", "pre_base_decline_60_pct", "distance_from_base_high_pct", "distance_from_base_mid_pct"),
    "rebound_platform": ("rebound_base_offset", "rebound_base_high", "rebound_base_low", "rebound_base_mid", "rebound_base_width_pct", "rebound_base_return_pct", "rebound_base_turnover_sum_pct", "rebound_base_drawdown_120_pct", "rebound_base_position_120", "rebound_pre_base_decline_60_pct", "rebound_base_quality", "distance_from_rebound_base_high_pct"),
    "adaptive_platform": ("adaptive_base_window", "adaptive_base_offset", "adaptive_base_high", "adaptive_base_low", "adaptive_base_mid", "adaptive_base_width_pct", "adaptive_base_return_pct", "adaptive_base_turnover_sum_pct", "adaptive_base_drawdown_120_pct", "adaptive_base_position_120", "adaptive_pre_base_decline_60_pct", "adaptive_base_quality", "distance_from_adaptive_base_high_pct"),
    "launch_action": ("early_launch_price_action",),
    "rebound_action": ("rebound_price_action",),
    "adaptive_actions": ("adaptive_ready_price_action", "adaptive_launch_price_action", "adaptive_rebound_price_action"),
}
#: Columns of a cost profile.
PROFILE = (
    "chip_model_coverage_pct", "chip_peak_price", "chip_secondary_peak_price", "chip_peak_dominance", "chip_significant_peak_count", "chip_peak_band_share_pct", "chip_70_low", "chip_70_high", "chip_70_width_pct", "chip_90_low",
    "chip_90_high", "chip_90_width_pct", "chip_profit_ratio_pct", "chip_overhead_ratio_pct", "chip_low_zone_share_pct", "chip_peak_position", "chip_peak_distance_pct",
)
#: Whole numbers, the same type in both engines.
INTEGERS = {c for f in ("bull_alignment", "cross_ma5_up", "trend_votes", "breakout_20", "breakout_failed_fast", "breakout_stall", "contraction_expansion", "bar_patterns", "pattern_counts", "one_price_limit", "turnover_peak", "distribution_day", "launch_action", "rebound_action", "adaptive_actions") for c in FAMILIES[f]} | {"macd_rising", "retest_touch", "bars_since_breakout", "rebound_base_offset", "adaptive_base_offset", "adaptive_base_window"}


#: What an operator's columns need of the panel; the others need all of it.
_TREND = {"sma", "ewm", "macd", "rsi", "returns", "extension", "ma_slopes", "bull_alignment", "cross_ma5_up"}
_VOLUME = {"volume_baseline", "volume_contraction", "turnover_ratio", "updown_volume", "obv_slope", "pullback_volume", "cost_moments"}
_ALONE: dict[str, Callable[[DataFrame], DataFrame]] = {"fill_change_cols": lambda df: df, "fixed_platform": features.fixed_platform, "rebound_platform": features.rebound_platform, "adaptive_platform": features.adaptive_platform}
_WHOLE = {"trend_votes", "launch_action", "rebound_action", "adaptive_actions"}


def _needed(name: str, bars: DataFrame) -> DataFrame:
    df = features.fill_change_cols(features.clean_bars(bars))
    if name in _ALONE:
        return _ALONE[name](df)
    if name in _TREND:
        return features.trend(df)
    if name in _VOLUME:
        return features.volumes(df)
    return features.feature_panel(bars) if name in _WHOLE else features.ranges(features.volumes(features.trend(df)))


#: Columns that are shown to more than 6 digits. Coverage: a history's first days are short decimals, whose halves at the 7th digit
#: would round by the last bit. The base's position: a share of some hundred cents, often a whole number of 640ths, likewise.
_DIGITS = {"chip_model_coverage_pct": 7, "adaptive_base_position_120": 11}


def near(x: Column | str, digits: int = 6) -> Column:
    """x to so many digits by its product, as the SQL does too; an infinity is shown as null."""
    x, by = (C(x) if isinstance(x, str) else x), 10.0**digits
    return F.floor(F.when(F.abs(x) < float("inf"), x) * by + 0.5) / by


def _shown(c: str) -> Column:
    return (C(c).cast("int") if c in INTEGERS else near(c, _DIGITS.get(c, 6))).alias(c)


def _shown_sql(c: str) -> str:
    return f"CAST({c} AS INTEGER) AS {c}" if c in INTEGERS else f"{ref.near(c, _DIGITS.get(c, 6))} AS {c}"


def _family(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _needed(name, fixture.load_bars(spark, sf_dir)).select("code", "date", *map(_shown, FAMILIES[name]))


def scan_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, last date and freshness of each instrument up to a session on which a fifth of them have no bar."""
    bars = _with_gaps(spark, sf_dir).where(C("date") <= F.lit(AS_OF).cast("date"))
    return bars.groupBy("code").agg(F.count("*").alias("bars"), F.max("date").alias("last_date")).withColumn("state", F.when(C("last_date") == F.lit(AS_OF).cast("date"), "fresh").otherwise("stale_date"))


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars without the last day of every fourth instrument."""
    return fixture.load_bars(spark, sf_dir).where((C("code").cast("int") % 4 != 0) | (C("date") < F.lit(AS_OF).cast("date")))


def dedupe_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixture.load_bars(spark, sf_dir)
    twice = bars.withColumn("ingest_seq", F.lit(1)).unionByName(bars.withColumn("close", C("close") + 1).withColumn("ingest_seq", F.lit(2)).where(F.day("date") % 2 == 0))
    return features.dedupe_bars(features.clean_bars(twice)).select("code", "date", "close", "ingest_seq")


def filter_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.filter_universe(fixture.load_universe(spark, sf_dir), mainboard=False).select("code", "name", "market", F.round("float_market_cap", 2).alias("float_market_cap"))


def market_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = market.normalize_code((C("s_suppkey") * 6007 % 999_983).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", code.alias("code"))
    return rows.select("s_suppkey", "code", market.is_mainboard(C("code")).alias("mainboard"), *(c.alias(k) for k, c in market.market_symbol(C("code")).items()))


def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.fetch_status(fixture.load_universe(spark, sf_dir), _with_gaps(spark, sf_dir), AS_OF, 520)


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.coverage_gate(fetch_status(spark, sf_dir), FIXTURE.min_coverage_pct)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def session_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.session_offset(fixture.load_sessions(fixture.load_bars(spark, sf_dir)), 12)


def sessions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixture.load_bars(spark, sf_dir)
    pairs = bars.select(C("date").alias("start"), F.date_add("date", F.day("date") - 10).alias("end")).distinct()
    return market.sessions_between(pairs, fixture.load_sessions(bars))


def merge_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories after a refresh of the last 30 days in which every fifth instrument's closes are off by a tenth, and of every seventh
    all but two are missing."""
    bars = fixture.load_bars(spark, sf_dir).select("code", "date", "close")
    late = C("date") > F.date_sub(F.lit(AS_OF).cast("date"), 30)
    new = bars.where(late).withColumn("close", F.when(C("code").cast("int") % 5 == 0, C("close") * 1.1).otherwise(C("close") + 0.01))
    new = new.withColumn("close", F.when((C("code").cast("int") % 7 != 0) | (C("date") > F.date_sub(F.lit(AS_OF).cast("date"), 2)), C("close")))
    merged, rebuild = market.merge_incremental(bars, new)
    return merged.groupBy("code").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 2).alias("closes")).join(rebuild.withColumn("rebuild", F.lit(1)), "code", "left").select("code", "bars", "closes", F.coalesce("rebuild", F.lit(0)).alias("rebuild"))


def join_evidence_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixture.load_bars(spark, sf_dir)
    evidence = bars.where((F.day("date") + C("code").cast("int")) % 11 == 0).select("code", "date", C("volume").alias("flow"), F.when(C("volume") > 30, C("close")).alias("note"))
    snapshot = features.latest_snapshot(bars).select("code", C("close").alias("note"))
    return market.join_evidence_asof(snapshot, evidence, "2001-12-15", ("flow", "note")).select("code", "evidence_date", "flow", "note")


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_snapshot(fixture.load_bars(spark, sf_dir)).select("code", "date", "close", "bars")


def join_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = market.benchmark_context(fixture.load_benchmark(spark, sf_dir))
    out = signals.join_benchmark(fixture.load_bars(spark, sf_dir).select("code", "date", "close"), bench)
    return out.select("code", "date", "close", *(near(f"benchmark_return_{n}d_pct").alias(f"benchmark_return_{n}d_pct") for n in (20, 60)), "benchmark_risk_ok")


def _strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixture.load_bars(spark, sf_dir)
    df = bars.select("code", "date", *(pct(C("close"), ago("close", n)).alias(f"return_{n}d_pct") for n in (20, 60)))
    bench = bt.latest_return(bt.latest_return(fixture.load_benchmark(spark, sf_dir), 20), 60).select("date", "benchmark_return_20d_pct", "benchmark_return_60d_pct")
    return df.join(bench, "date", "left").join(fixture.load_universe(spark, sf_dir).select("code", "float_market_cap"), "code", "left")


def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.relative_strength(_strength(spark, sf_dir))
    return out.select("code", "date", *(near(c).alias(c) for c in ("rs20_excess_pct", "rs60_excess_pct", "rs20_percentile", "rs60_percentile", "float_cap_percentile")))


def cost_distribution_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cost_distribution_asof(fixture.load_bars(spark, sf_dir)).select("code", "bin", near("mass", 9).alias("mass"))


def _profile_columns() -> list[Column]:
    return [C(c) if c == "chip_significant_peak_count" else near(c, _DIGITS.get(c, 6)).alias(c) for c in PROFILE]


def cost_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cost_profile(fixture.load_bars(spark, sf_dir)).select("code", *_profile_columns())


def cost_distribution_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cost_distribution_panel(fixture.load_bars(spark, sf_dir)).select("code", "date", *_profile_columns())


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar's features with the cost profile, benchmark flag and scores."""
    bars = fixture.load_bars(spark, sf_dir)
    profile = cost.cost_profile(bars).drop("date")
    last = features.latest_snapshot(features.feature_panel(bars))
    return signals.scores(last.join(profile, "code", "left").withColumn("benchmark_risk_ok", F.lit(1)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).select("code", *(C(c).cast("int").alias(c) for c in ("chip_score_base", "chip_score_profile", "chip_score_context", "chip_score_launch", "chip_score_risk", "chip_structure_score", "chip_base_ready_score", "chip_base_launch_score", "chip_base_rebound_score", "score_total")))


def select_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.select_signals(snapshot(spark, sf_dir), FIXTURE).select("code", "signal", "model_score", "rank")


def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.funnel_counts(snapshot(spark, sf_dir), FIXTURE)


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.near_misses(snapshot(spark, sf_dir), FIXTURE).select("code", "closest_signal", "failed_at", "passed_steps", "total_steps", near("completion_ratio").alias("completion_ratio"), "near_miss_rank")


def flow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_summary(fixture.load_flow(spark, sf_dir), AS_OF)


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping signal lists by the last bar's close and volume."""
    last = features.latest_snapshot(fixture.load_bars(spark, sf_dir))
    a = last.where("code % 3 <> 0").select("code", F.lit("chip_base_ready").alias("signal"), C("close").alias("model_score"))
    return a.unionByName(last.where("code % 2 = 0").select("code", F.lit("chip_base_launch").alias("signal"), C("volume").alias("model_score")))


def flow_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_candidates(_picked(spark, sf_dir), ("chip_base_ready", "chip_base_launch"), 40)


def flow_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_rank(_picked(spark, sf_dir), flow_summary(spark, sf_dir)).select("code", "signal", "rank")


def forward_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.forward_outcomes(fixture.load_bars(spark, sf_dir))
    return out.select("code", "date", "outcome_success", *(near(c).alias(c) for c in ("forward_max_return_pct", "drawdown_before_target_pct")))


PERIOD = ("2000-09-01", AS_OF)


def backtest_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("code", "date", "bars", "name", "any_signal", "signal_names", C("score_total").cast("int").alias("score_total"), "outcome_success", *(near(c).alias(c) for c in ("rs20_percentile", "rs60_percentile", "chip_peak_price", "forward_max_return_pct")))


def signal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).select("code", "date", *signals.SIGNALS, "any_signal", "signal_names")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.backtest_panel(fixture.load_bars(spark, sf_dir), fixture.load_benchmark(spark, sf_dir), fixture.load_universe(spark, sf_dir), *PERIOD, FIXTURE)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.eligible_rows(_panel(spark, sf_dir), FIXTURE)


def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = runs.eligibility_panel(fixture.load_bars(spark, sf_dir), fixture.load_benchmark(spark, sf_dir), *PERIOD, FIXTURE)
    return bt.eligible_rows(panel, FIXTURE).select("code", "date", "bars", "outcome_success")


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.precision_recall(_judged(spark, sf_dir), "any_signal")


def precision_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.precision_by_signal(_judged(spark, sf_dir), signals.SIGNALS)


def topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.topk_recall(_judged(spark, sf_dir), "any_signal", "score_total", (1, 2, *FIXTURE.top_k))


def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.daily_summary(_judged(spark, sf_dir), "any_signal")


def signals_with_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ("rs20_percentile", "forward_max_return_pct", "drawdown_before_target_pct")
    return bt.signals_with_outcomes(_judged(spark, sf_dir)).select("date", "code", "name", "signal_names", C("score_total").cast("int").alias("score_total"), "daily_rank", "close", "outcome_success", *(near(c).alias(c) for c in numbers))


def _scan(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A scan as of the last session of histories of which a fourth are a day short."""
    args = fixture.load_universe(spark, sf_dir), fixture.load_benchmark(spark, sf_dir), fixture.load_flow(spark, sf_dir)
    bars = _with_gaps(spark, sf_dir)
    evidence = fixture.load_bars(spark, sf_dir).where((F.day("date") + C("code").cast("int")) % 11 == 0).select("code", "date", C("volume").alias("flow"))
    return runs.scan(bars, *args, AS_OF, replace(FIXTURE, min_coverage_pct=50.0), evidence, ("flow",), mainboard=False)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)["selected"].select("code", "name", "signal", "model_score", "rank", "fund_flow_rank_reason", "evidence_date", "flow", near("rs20_percentile").alias("rs20_percentile"))


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)["report"].select("universe", "snapshots", "provisional", "coverage_pct", "valid", "candidates", "candidate_rate_pct", "assessment")


def scan_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)["funnel"]


def publish_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a valid run and then one without enough coverage leave behind."""
    path, rows = _folder(spark), _picked(spark, sf_dir)
    artefacts = {"selected": rows, "scored": features.latest_snapshot(fixture.load_bars(spark, sf_dir)).select("code", "close")}
    found = []
    for valid, session in ((True, "2001-12-28"), (False, AS_OF)):
        publish.publish_run(artefacts, valid, path, session)
        for name in ("selected", "scored", *(() if valid else ("provisional_selected",))):
            found.append(publish.latest_run(spark, path, name).groupBy(F.lit(session).alias("session"), F.lit(name).alias("artefact")).agg(F.count("*").alias("n"), F.min("code").alias("first_code")))
    return reduce(DataFrame.unionByName, found)


def publish_shape_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    publish.publish_shape_checkpoint(_picked(spark, sf_dir), path, AS_OF, signals.SIGNALS)
    return reduce(DataFrame.unionByName, (spark.read.parquet(f"{path}/shape_only_{s}/session={AS_OF}").select(F.lit(s).alias("artefact"), "code", "model_score") for s in signals.SIGNALS))


def publish_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histories of two sessions, of which the second has the last year alone: the years before stay."""
    path, bars = _folder(spark), fixture.load_bars(spark, sf_dir)
    publish.publish_history(bars, path, "2001-12-15", "first", buckets=8)
    publish.publish_history(bars.where(F.year("date") == 2001), path, AS_OF, "second")
    return history.read_history(spark, path).groupBy("code", F.year("date").alias("year"), "source", "as_of").agg(F.count("*").alias("bars"), F.sum("close").alias("closes"))


def publish_history_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all histories up to the middle of December; then, twice over, every third code's last sixty days with closes one higher; then every fifth code anew, as its
    last year alone. All other rows stay, as do the third codes' older ones."""
    path, bars, no = _folder(spark), fixture.load_bars(spark, sf_dir), C("code").cast("int")
    history.upsert_history(bars, path, "2001-12-15", "first", buckets=8)
    late = bars.where((no % 3 == 0) & (C("date") > F.date_sub(F.lit(AS_OF).cast("date"), 60))).withColumn("close", C("close") + 1)
    for _ in range(2):
        history.upsert_history(late, path, AS_OF, "second")
    history.upsert_history(bars.where((no % 5 == 0) & (F.year("date") == 2001)), path, AS_OF, "third", whole=True)
    return history.read_history(spark, path).select("code", "date", "close", "source", "as_of")


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as of the 20th of a store in which, by the code's remainder by 7, 0 has nothing, 1 was stored as an index, 2 has later bars alone, 3 has rows that no writer of
    the store wrote, 4 ends on the 18th, and the others are fresh. Only the last year's parts are read."""
    path, bars, no, day = _folder(spark), fixture.load_bars(spark, sf_dir), C("code").cast("int") % 7, F.lit("2001-12-20").cast("date")
    history.upsert_history(bars.where((no > 2) & ((no != 4) | (C("date") <= F.date_sub(day, 2)))), path, AS_OF, "provider:a", buckets=8)
    history.upsert_history(bars.where(no == 1), path, AS_OF, "provider:a", kind="index")
    history.upsert_history(bars.where((no == 2) & (C("date") > day)), path, AS_OF, "provider:b")
    stray = history.read_history(spark, path, "2001-01-01").where((no == 3) & (F.month("date") == 5)).withColumns({"bucket": history.bucket_of(8), "year": F.year("date")})
    named = [(*(int(x.split("=")[1]) for x in part.split("/")), commit) for part, commit in commits.manifest(spark, path)[1]["parts"].items()]
    folders = spark.createDataFrame(named, "bucket int, year int, commit string")  # one row a part
    stray.join(F.broadcast(folders), ["bucket", "year"]).write.mode("append").partitionBy("commit", "bucket", "year").parquet(f"{path}/bars")
    return history.scan_history(fixture.load_universe(spark, sf_dir), path, "2001-12-20", sources=("provider:",), since="2001-01-01").select("code", "state", "bars", "last_date")


REFRESHED = "2001-11-05"  # thirty days before the last bar of the state that the second refresh goes on from


def refresh_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the bars of a refresh, from the state that another refresh left, whose own state is that of the histories up to the 20th of November."""
    path, bars = _folder(spark), fixture.load_bars(spark, sf_dir)
    upto = lambda day: C("date") <= F.lit(day).cast("date")

    def kept(name: str, state: DataFrame) -> DataFrame:
        state.write.parquet(f"{path}/{name}")
        return spark.read.schema(state.schema).parquet(f"{path}/{name}")

    first = kept("first", carried.carry(bars.where(upto("2001-11-20"))))
    second = kept("second", carried.refresh(first, bars.where(upto("2001-12-05") & ~upto("2001-10-20")))[1])
    found, _, _ = carried.refresh(second, bars.where(~upto("2001-11-04")))
    return found.select("code", "date", "bars", *map(_shown, dict.fromkeys(c for f in FAMILIES.values() for c in f)))


def feature_panel_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of bars that came two or three times: first with other closes, last with a close that is no number."""
    bars = fixture.load_bars(spark, sf_dir)
    twice = bars.withColumn("ingest_seq", F.lit(2)).unionByName(bars.withColumns({"close": C("close") + 3, "ingest_seq": F.lit(1)})).unionByName(bars.where(F.day("date") % 9 == 0).withColumns({"close": F.lit(float("inf")), "ingest_seq": F.lit(3)}))
    columns = ("ma20", "dif", "rsi14", "position_250", "vol_ratio_20", "atr14", "adaptive_base_quality", "rebound_base_quality")
    return features.feature_panel(twice).select("code", "date", *map(_shown, columns))


def cost_profile_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost profiles of bars that repeat days and of which those of the 7th have no number as turnover."""
    bars = fixture.load_bars(spark, sf_dir).withColumn("turnover", F.when(F.day("date") == 7, float("nan")).otherwise(C("turnover")))
    twice = bars.withColumn("ingest_seq", F.lit(2)).unionByName(bars.withColumns({"low": C("low") * 0.5, "ingest_seq": F.lit(1)}))
    return cost.cost_profile(twice).select("code", *_profile_columns())


def filter_universe_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote lines as they come, names with signs or without a name among them, filtered."""
    return market.filter_universe(_quoted(spark, sf_dir), mainboard=False).select("code", "name", "market", "latest")


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe of quote lines: every 17th under special treatment, every 23rd leaving, every line once more in another market."""
    k = C("s_suppkey")
    name = F.when(k % 17 == 0, F.concat(F.lit("*st "), "s_name")).when(k % 23 == 0, F.concat("s_name", F.lit(market.LEAVING))).otherwise(C("s_name"))
    line = lambda prefix: F.concat(F.lit(f'var hq_str_{prefix}'), F.lpad(k.cast("string"), 6, "0"), F.lit('="'), name, F.lit(",1,2,"), (k % 50).cast("string"), F.lit(',5";')).alias("value")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.explode(F.array(line("sz"), line("sh"))).alias("value"))
    universe = landed.ingest_quote_text(rows)
    return universe.withColumn("name", F.when(C("code").cast("int") % 13 != 0, C("name")))


def scan_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan over an ingested universe, published: each listed instrument's status and, where it was scored, its last close."""
    path = _folder(spark)
    p = replace(FIXTURE, min_coverage_pct=50.0, min_universe=5)
    version = runs.publish_scan(_with_gaps(spark, sf_dir), _quoted(spark, sf_dir), fixture.load_benchmark(spark, sf_dir), fixture.load_flow(spark, sf_dir), AS_OF, p, path, mainboard=False)
    status, scored = (publish.latest_run(spark, path, name, version) for name in ("status", "scored"))
    return status.join(scored.select("code", "name", "close"), "code", "left")


def join_evidence_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the newest evidence of its code up to the day; every tenth code has none."""
    bars, no = fixture.load_bars(spark, sf_dir), C("code").cast("int")
    evidence = bars.where(((F.day("date") + no) % 11 == 0) & (no % 10 != 0)).select("code", F.date_sub("date", 1).alias("date"), C("volume").alias("flow"), F.when(C("volume") > 30, C("high")).alias("close"))
    return market.join_evidence_panel(bars.select("code", "date", "close"), evidence, ("flow", "close")).select("code", "date", "close", "evidence_date", "flow")


def publish_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    runs.publish_backtest(_panel(spark, sf_dir), FIXTURE, path)
    back = spark.read.parquet(f"{path}/signals").agg(F.count("*").alias("signals")), spark.read.parquet(f"{path}/daily").agg(F.count("*").alias("days")), spark.read.json(f"{path}/metrics").select("eligible_rows", "signal_rows")
    return reduce(DataFrame.crossJoin, back)  # one row each


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/published/{uuid.uuid4().hex}"


def column_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of frames that know the fixed base alone."""
    df = snapshot(spark, sf_dir)
    df = df.drop(*(c for c in df.columns if "adaptive" in c or c.startswith("chip_score") or c.endswith("_score") or c in ("score_total", "benchmark_risk_ok")))
    return signals.scores(df).select("code", *(C(c).cast("int").alias(c) for c in ("chip_score_base", "chip_score_context", "chip_score_launch", "adaptive_base_offset", "adaptive_base_window", "adaptive_trend_votes", "adaptive_ready_price_action", "score_total")), near("distance_from_adaptive_base_high_pct").alias("distance_from_adaptive_base_high_pct"))


def join_universe_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = features.latest_snapshot(fixture.load_bars(spark, sf_dir))
    return market.join_universe_context(last, fixture.load_universe(spark, sf_dir).where(C("code").cast("int") % 3 != 0)).select("code", "close", F.round("float_market_cap", 2).alias("float_market_cap"))


def names_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.names_lookup(fixture.load_bars(spark, sf_dir), fixture.load_universe(spark, sf_dir).where(C("code").cast("int") % 3 != 0)).select("code", "date", "name")


def union_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.union_signals(market.names_lookup(_picked(spark, sf_dir), fixture.load_universe(spark, sf_dir)))


def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.top_n(flow_rank(spark, sf_dir), 7)


def evidence_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixture.load_bars(spark, sf_dir)
    evidence = bars.where((F.day("date") + C("code").cast("int")) % 11 == 0).select("code", "date", C("volume").alias("flow"))
    return publish.evidence_metadata(market.join_evidence_asof(features.latest_snapshot(bars), evidence, "2001-12-15", ("flow",)), evidence.count())


def require_fresh_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as of two sessions, the second beyond its last bar: whether it is let through."""
    index, found = fixture.load_benchmark(spark, sf_dir), []
    for session in (AS_OF, "2002-01-01"):
        try:
            publish.require_fresh_benchmark(index, session)
            found.append((session, True))
        except ValueError:
            found.append((session, False))
    last = index.agg(F.max("date").alias("last_date"))
    return last.select("last_date", F.explode(F.array(*(F.struct(F.lit(s).alias("session"), F.lit(ok).alias("fresh")) for s, ok in found))).alias("x")).select("last_date", "x.*")


def label_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _picked(spark, sf_dir).withColumn("ratio", C("model_score") / 8)
    return publish.label_view(rows, {"signal": {"chip_base_ready": "Ready"}}).select("code", "signal", "model_score", "ratio")


def join_reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth supplier is on the list, with an invented name where the universe has none."""
    universe, bars = fixture.load_universe(spark, sf_dir), _with_gaps(spark, sf_dir)
    listed = universe.where(C("code").cast("int") % 4 < 2).select("code", F.concat(F.lit("listed "), "code").alias("reference_name"), (C("code").cast("int") % 4).alias("acceptance_example"))
    last = features.latest_snapshot(bars)
    missed = last.select("code", F.lit("chip_base_ready").alias("closest_signal"), F.lit("liquidity").alias("failed_at")).where("code % 5 = 0")
    return publish.join_reference_audit(listed, universe.where(C("code").cast("int") % 6 != 0), fetch_status(spark, sf_dir), last, _picked(spark, sf_dir), missed, signals.SIGNALS)


def flow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow of the first 40 candidates, when every third instrument has no flow and every fifth none of the last day."""
    rows = fixture.load_flow(spark, sf_dir).where((C("code").cast("int") % 3 != 0) & ((C("code").cast("int") % 5 != 0) | (C("date") < F.lit(AS_OF).cast("date"))))
    return publish.flow_status(_picked(spark, sf_dir).select("code").distinct(), flow.flow_summary(rows, AS_OF))


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = fetch_status(spark, sf_dir)
    out = publish.run_report(status, status.where(C("status") == "ok"), _picked(spark, sf_dir), 50.0)
    return out.select("universe", "snapshots", "provisional", "coverage_pct", "valid", "candidates", "candidate_rate_pct", "assessment")


def _chosen(bars: DataFrame) -> DataFrame:
    """Plain signals of every session: a close above the last five (ready), or also twice the usual volume (launch)."""
    w = features.W().rowsBetween(-5, -1)
    rows = bars.withColumns({"_top": F.max("close").over(w), "_usual": F.avg("volume").over(w), "_low": F.min("low").over(w)}).where(C("close") > C("_top"))
    row = lambda s: rows.select("date", "code", F.lit(s).alias("signal"), C("volume").alias("score_total"), "close", C("_top").alias("resistance_price"), C("_low").alias("support_price"), "_usual")
    return row("chip_base_ready").unionByName(row("chip_base_launch").where(C("score_total") > 2 * C("_usual"))).drop("_usual")


def _table(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, for steps that read it many times over."""
    path = f"{_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, signals and sessions of the watchlist's queries."""
    bars = _table(fixture.load_bars(spark, sf_dir).select("code", "date", "low", "close", "volume"), "bars")
    return bars, _table(_chosen(bars), "chosen"), _table(fixture.load_sessions(bars), "sessions")


def _replay(bars: DataFrame, chosen: DataFrame, sessions: DataFrame) -> DataFrame:
    return replay.watchlist_replay(replay.watchlist_events(chosen, bars, sessions, FIXTURE.watchlist_ttl_sessions))


def watchlist_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list after every session."""
    return _replay(*_listed(spark, sf_dir))


def _updated(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """The last session's update of the list as it was before, done some times over."""
    bars, chosen, sessions = _listed(spark, sf_dir)
    day = F.lit(AS_OF).cast("date")
    state = _table(_replay(bars, chosen, sessions).where(C("last_evaluated_date") == F.date_sub(day, 1)).drop("old_state"), "state")
    for _ in range(times):
        out = watchlist.watchlist_update(state, chosen.where(C("date") == day), bars.where(C("date") == day), sessions, AS_OF, FIXTURE.watchlist_ttl_sessions)
        state = out.drop("old_state")
    return out


def watchlist_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir)


def watchlist_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist.watchlist_active(_updated(spark, sf_dir)).select("code", "state", "signals", "age_sessions")


def watchlist_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same update twice: states, ages and dates as after the first, and no transition."""
    twice = _updated(spark, sf_dir, 2)
    return twice.join(watchlist.watchlist_transitions(twice).select("code", F.lit(1).alias("moved")), "code", "left").select("code", "state", "age_sessions", "first_seen_date", "last_signal_date", F.coalesce("moved", F.lit(0)).alias("moved"))


def state_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side of the last session's update each code comes from: the list, the session's signals, or both."""
    out = _updated(spark, sf_dir)
    return out.select("code", C("old_state").isNotNull().cast("int").alias("was_listed"), (C("last_signal_date") == F.lit(AS_OF).cast("date")).cast("int").alias("has_signal"), "data_status")


def watchlist_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist.watchlist_transitions(watchlist_replay(spark, sf_dir))


def append_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history up to the 28th with the transitions from the 25th on put over it, their closes one higher."""
    rows = watchlist_transitions(spark, sf_dir)
    late = rows.where(C("date") >= F.lit("2001-12-25").cast("date")).withColumn("close", C("close") + 1)
    return replay.append_transitions(rows.where(C("date") <= F.lit("2001-12-28").cast("date")), late)


def watchlist_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list after every session, as a stream makes it that is stopped and started again twice: only sessions with a bar or a signal come, and no bar of the code comes on
    days that its number and the day's are a multiple of six apart."""
    path, (bars, chosen, sessions) = _folder(spark), _listed(spark, sf_dir)
    traded = bars.where((F.day("date") + C("code").cast("int")) % 6 != 0)
    chosen = chosen.join(traded.select("code", "date"), ["code", "date"], "left_semi")
    events = replay.watchlist_events(chosen, traded, sessions, FIXTURE.watchlist_ttl_sessions).where(C("close").isNotNull() | C("new_state").isNotNull())
    events.write.parquet(f"{path}/events")
    events = spark.read.schema(replay.EVENT).parquet(f"{path}/events")
    for low, high in (("0001-01-01", "2001-03-31"), ("2001-04-01", "2001-12-24"), ("2001-12-25", "9999-12-31")):
        events.where(C("date").between(F.lit(low).cast("date"), F.lit(high).cast("date"))).write.mode("append").parquet(f"{path}/in")
        stream.run_to(spark.readStream.schema(replay.EVENT).parquet(f"{path}/in"), sessions, f"{path}/out", f"{path}/state")
    return spark.read.schema(replay.OUT).parquet(f"{path}/out")


def append_transitions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of transitions to which a stream's batches are added, two of them twice and one late, with closes that would show it."""
    path, rows = _folder(spark), watchlist_transitions(spark, sf_dir)
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.schema(transitions.ROW).parquet(f"{path}/rows")
    add = transitions.transitions_sink(f"{path}/history", "list")
    parts = [rows.where(C("date") < F.lit("2001-06-01").cast("date")), rows.where(C("date") >= F.lit("2001-05-01").cast("date"))]
    for batch, part, more in ((0, parts[0], 0), (0, parts[0], 1), (1, parts[1], 2), (1, parts[1], 3), (0, parts[0], 4)):
        add(part.withColumn("close", C("close") + more), batch)
    return transitions.read_transitions(spark, f"{path}/history")


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist.current_state(_chosen(fixture.load_bars(spark, sf_dir)), "code", "date").select("code", "date", "new_state", "new_signals", "new_score_total", "new_close", "new_resistance_price", "new_support_price")


def scan_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows is of an old version, another third was saved too long ago."""
    no = C("code").cast("int") % 3
    rows = fixture.load_universe(spark, sf_dir).select("code", F.when(no == 0, 1).otherwise(2).alias("version"), F.lit(AS_OF).cast("date").alias("as_of"), F.when(no == 1, "2001-12-30 08:00:00").otherwise("2001-12-31 09:00:00").cast("timestamp").alias("saved_at"))
    return landed.scan_universe(rows, 2, AS_OF, "2001-12-31 12:00:00", 20).select("code", "version", "state")


def scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as CSV with thousands separators, dates that can't be read, and a column that the reader doesn't find."""
    path, bars = _folder(spark), fixture.load_bars(spark, sf_dir).where(F.day("date") == 7)
    text = F.when(C("code").cast("int") % 5 == 0, "-").otherwise(F.format_number(C("volume") * 1000, 0))
    bars.select(C("code").cast("int").cast("string").alias("code"), F.when(F.month("date") == 3, "soon").otherwise(C("date").cast("string")).alias("date"), text.alias("flow")).write.option("header", True).csv(path)
    return landed.scan_evidence(spark, path, ("flow", "ratio"))


def clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of which those of the 5th have no close, those of the 6th a NaN as high and those of the 7th a NaN as turnover."""
    day, nan = F.day("date"), F.lit(float("nan"))
    bars = fixture.load_bars(spark, sf_dir).withColumns({"close": F.when(day != 5, C("close")), "high": F.when(day == 6, nan).otherwise(C("high")), "turnover": F.when(day == 7, nan).otherwise(C("turnover"))})
    return features.clean_bars(bars).select("code", "date", "high", "close", "turnover")


def pct_rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixture.load_bars(spark, sf_dir).withColumn("volume", F.when(C("volume") > 5, C("volume")))
    return signals.pct_rank_average(bars, "volume", "share").select("code", "date", near("share").alias("share"))


def daily_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.daily_rank(fixture.load_bars(spark, sf_dir), "volume").select("code", "date", "daily_rank")


def normalize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of one to seven and more characters."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (C("o_orderkey") * 37).cast("string").alias("raw"))
    return rows.select("o_orderkey", market.normalize_code(C("raw")).alias("code"))


_PLAIN = (scan_bars, dedupe_bars, filter_universe, market_codes, fetch_status, coverage_gate, status_counts, session_offset, sessions_between, merge_incremental, join_evidence_asof, latest_snapshot, join_benchmark, relative_strength, cost_distribution_asof, cost_profile, cost_distribution_panel, scores, select_signals, funnel_counts, near_misses, flow_summary, flow_candidates, flow_rank, forward_outcomes, precision_recall, precision_by_signal, topk_recall, daily_summary, flow_status, run_report, watchlist_replay, backtest_panel, signal_flags, eligible_rows, signals_with_outcomes, scan, scan_report, scan_funnel, publish_run, publish_shape_checkpoint, publish_history, publish_backtest, column_fallbacks, join_universe_context, names_lookup, union_signals, top_n, evidence_metadata, require_fresh_benchmark, label_view, join_reference_audit, watchlist_update, watchlist_active, watchlist_idempotent, state_full_join, watchlist_transitions, append_transitions, current_state, scan_universe, scan_evidence, clean_bars, pct_rank_average, daily_rank, normalize_code, publish_history_refresh, scan_history, refresh_features, feature_panel_repeats, cost_profile_repeats, filter_universe_ingested, scan_ingested, join_evidence_panel, watchlist_stream, append_transitions_stream)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _family(name) for name in FAMILIES} | {f.__name__: f for f in _PLAIN} | ingest.QUERIES


def oracles() -> dict[str, str]:
    chain = ref.features()
    whole = "WITH " + ",\n".join(chain.parts)
    out = {name: f"{whole}\nSELECT code, date, {', '.join(map(_shown_sql, columns))} FROM {chain.name}" for name, columns in FAMILIES.items()}
    bars, day = f"WITH {ref.BARS}", f"DATE '{AS_OF}'"
    gaps = f"{bars}, gaps AS (SELECT * FROM bars WHERE CAST(code AS INTEGER) % 4 <> 0 OR date < {day})"
    status = f"""{gaps}, have AS (SELECT code, count(*) AS bars, max(date) AS last_date FROM gaps GROUP BY 1),
      status AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, coalesce(bars, 0) AS bars, last_date,
      CASE WHEN bars IS NULL THEN 'failed' WHEN last_date < {day} THEN 'stale_hist' WHEN bars < 520 THEN 'insufficient_bars' ELSE 'ok' END AS status
      FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN have ON code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0'))"""
    sessions = f"{bars}, sessions AS (SELECT date, row_number() OVER (ORDER BY date) AS session_no FROM (SELECT DISTINCT date FROM bars))"
    bench = ref.BENCH
    last = f"{bars}, last AS (SELECT code, max(date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume, count(*) AS bars FROM bars GROUP BY 1)"
    picked = f"""{last}, picked AS (SELECT code, 'chip_base_ready' AS signal, close AS model_score, 0 AS no FROM last WHERE CAST(code AS INTEGER) % 3 <> 0
      UNION ALL SELECT code, 'chip_base_launch', volume, 1 FROM last WHERE CAST(code AS INTEGER) % 2 = 0)"""
    sums = ", ".join(f"CASE WHEN count(*) >= {n} THEN sum(CASE WHEN nth <= {n} THEN inflow END) END AS main_net_inflow_{n}d_amount" for n in flow.SPANS)
    plus = " + ".join(f"CASE WHEN main_net_inflow_{n}d_amount > 0 THEN 1 ELSE 0 END" for n in flow.SPANS)
    summary = f"""ranked AS (SELECT code, date, inflow, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS nth FROM bars WHERE date <= {day}),
      sums AS (SELECT code, max(date) AS fund_flow_latest_date, CASE WHEN count(*) >= 20 THEN 1 ELSE 0 END AS fund_flow_available, {sums} FROM ranked WHERE nth <= 20 GROUP BY 1),
      counted AS (SELECT *, CASE WHEN fund_flow_latest_date = {day} THEN 1 ELSE 0 END AS fund_flow_is_current, {plus} AS fund_flow_positive_window_count FROM sums),
      summary AS (SELECT *, CASE WHEN fund_flow_available = 1 AND fund_flow_positive_window_count = 4 THEN 1 ELSE 0 END AS fund_flow_all_windows_positive,
      CASE WHEN fund_flow_is_current = 0 THEN 'stale since ' || CAST(fund_flow_latest_date AS VARCHAR) WHEN fund_flow_available = 1 AND fund_flow_positive_window_count = 4 THEN 'net inflow in all windows'
      WHEN fund_flow_available = 1 THEN CAST(fund_flow_positive_window_count AS VARCHAR) || '/4 windows with net inflow' ELSE 'fewer than 20 days' END AS fund_flow_rank_reason FROM counted)"""
    rank = lambda x: f"CASE WHEN {x} IS NOT NULL THEN floor((rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY date) * 1e6 + 0.5) / 1e6 END"
    keys = ", ".join(f"coalesce({k}, 0) DESC" for k in ("fund_flow_is_current", "fund_flow_all_windows_positive", "fund_flow_positive_window_count", *(f"main_net_inflow_{n}d_amount" for n in flow.SPANS)))
    out |= {
        "scan_bars": f"{gaps} SELECT code, count(*) AS bars, max(date) AS last_date, CASE WHEN max(date) = {day} THEN 'fresh' ELSE 'stale_date' END AS state FROM gaps GROUP BY 1",
        "dedupe_bars": f"{bars} SELECT code, date, CASE WHEN day(date) % 2 = 0 THEN close + 1 ELSE close END AS close, CASE WHEN day(date) % 2 = 0 THEN 2 ELSE 1 END AS ingest_seq FROM bars",
        "filter_universe": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, n_name AS market, round(abs(s_acctbal) * 1e6, 2) AS float_market_cap FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 17 <> 0 AND s_suppkey % 23 <> 0 AND NOT contains(upper(s_name), 'ST')",
        "market_codes": """WITH c AS (SELECT s_suppkey, lpad(CAST(s_suppkey * 6007 % 999983 AS VARCHAR), 6, '0') AS code FROM supplier) SELECT s_suppkey, code, left(code, 3) IN ('600', '601', '603', '605', '000', '001', '002', '003') AS mainboard,
          CASE WHEN left(code, 3) IN ('600', '601', '603', '605') THEN '1.' ELSE '0.' END || code AS secid, CASE WHEN left(code, 3) IN ('600', '601', '603', '605') THEN 'sh' ELSE 'sz' END || code AS prefixed, CASE WHEN left(code, 3) IN ('600', '601', '603', '605') THEN 'sh.' ELSE 'sz.' END || code AS dotted FROM c""",
        "fetch_status": f"{status} SELECT * FROM status",
        "coverage_gate": f"{status}, n AS (SELECT count(*) AS universe, count(*) FILTER (status = 'ok') AS ok FROM status) SELECT universe, ok, round(ok / universe * 100, 2) AS coverage_pct, round(ok / universe * 100, 2) >= 90 AS valid FROM n",
        "status_counts": f"{status} SELECT status, count(*) AS n FROM status GROUP BY 1",
        "session_offset": f"{sessions} SELECT date, lead(date, 12) OVER (ORDER BY date) AS target FROM sessions",
        "sessions_between": f'{sessions}, pairs AS (SELECT DISTINCT date AS "start", date + CAST(day(date) - 10 AS INTEGER) AS "end" FROM bars) SELECT p."start", p."end", greatest((SELECT count(*) FROM sessions s WHERE s.date BETWEEN p."start" AND p."end") - 1, 0) AS n FROM pairs p',
        "merge_incremental": f"""{bars} SELECT code, count(*) AS bars, round(sum(CASE WHEN CAST(code AS INTEGER) % 5 <> 0 AND CAST(code AS INTEGER) % 7 <> 0 AND date > {day} - 30 THEN close + 0.01 ELSE close END), 2) AS closes,
          CASE WHEN CAST(code AS INTEGER) % 5 = 0 OR CAST(code AS INTEGER) % 7 = 0 THEN 1 ELSE 0 END AS rebuild FROM bars GROUP BY code""",
        "join_evidence_asof": f"""{last}, ev AS (SELECT code, date, volume AS flow, CASE WHEN volume > 30 THEN close END AS note, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS nth FROM bars WHERE (day(date) + CAST(code AS INTEGER)) % 11 = 0 AND date <= DATE '2001-12-15')
          SELECT l.code, e.date AS evidence_date, e.flow, coalesce(e.note, l.close) AS note FROM last l LEFT JOIN ev e ON e.code = l.code AND e.nth = 1""",
        "latest_snapshot": f"{last} SELECT code, date, close, bars FROM last",
        "join_benchmark": f"{bars}, {bench} SELECT b.code, b.date, b.close, {ref.near('b20')} AS benchmark_return_20d_pct, {ref.near('b60')} AS benchmark_return_60d_pct, CASE WHEN i.close >= m20 * 0.97 AND b20 > -8 THEN 1 ELSE 0 END AS benchmark_risk_ok FROM bars b LEFT JOIN index i USING (date)",
        "relative_strength": f"""{bars}, {bench}, x AS (SELECT code, date, (close / lag(close, 20) OVER w - 1) * 100 AS r20, (close / lag(close, 60) OVER w - 1) * 100 AS r60 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
          y AS (SELECT x.code, x.date, r20 - coalesce(b20, 0) AS e20, r60 - coalesce(b60, 0) AS e60, u.cap FROM x LEFT JOIN index USING (date) LEFT JOIN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, abs(s_acctbal) * 1e6 AS cap FROM supplier) u ON u.code = x.code)
          SELECT code, date, {ref.near('e20')} AS rs20_excess_pct, {ref.near('e60')} AS rs60_excess_pct, {rank('e20')} AS rs20_percentile, {rank('e60')} AS rs60_percentile, {rank('cap')} AS float_cap_percentile FROM y""",
        "cost_distribution_asof": f"{bars}, {ref.MASS} SELECT code, bin, {ref.near('mass', 9)} AS mass FROM mass WHERE mass > 0",
        "flow_summary": f"{bars}, {summary} SELECT * FROM summary",
        "flow_candidates": f"""{picked}, turns AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY model_score DESC, code) AS turn FROM picked), firsts AS (SELECT code, min(turn * 10 + no) AS k FROM turns GROUP BY 1)
          SELECT code, CAST(k // 10 AS INTEGER) AS turn, CAST(k % 10 AS INTEGER) AS signal_no, (SELECT count(*) FROM firsts) AS total FROM firsts ORDER BY k LIMIT 40""",
        "flow_rank": f"{picked}, {summary} SELECT p.code, signal, row_number() OVER (PARTITION BY signal ORDER BY {keys}, model_score DESC, p.code) AS rank FROM picked p LEFT JOIN summary s USING (code)",
        "forward_outcomes": f"{bars}, {ref.OUTCOMES} SELECT code, date, outcome_success, {ref.near('forward_max_return_pct')} AS forward_max_return_pct, {ref.near('drawdown_before_target_pct')} AS drawdown_before_target_pct FROM judged",
        "flow_status": f"""{picked}, kept AS (SELECT code, max(date) AS d FROM bars WHERE CAST(code AS INTEGER) % 3 <> 0 AND (CAST(code AS INTEGER) % 5 <> 0 OR date < {day}) GROUP BY 1)
          SELECT p.code, d AS fund_flow_latest_date, CASE WHEN d IS NULL THEN 'failed' WHEN d = {day} THEN 'ok' ELSE 'stale' END AS status FROM (SELECT DISTINCT code FROM picked) p LEFT JOIN kept USING (code)""",
        "run_report": f"""{status}, n AS (SELECT count(*) AS universe, count(*) FILTER (status = 'ok') AS snapshots FROM status), c AS (SELECT count(DISTINCT code) AS provisional FROM bars WHERE CAST(code AS INTEGER) % 3 <> 0 OR CAST(code AS INTEGER) % 2 = 0),
          r AS (SELECT *, round(snapshots / universe * 100, 2) AS coverage_pct FROM n, c), v AS (SELECT *, coverage_pct >= 50 AS valid, CASE WHEN coverage_pct >= 50 THEN provisional ELSE 0 END AS candidates FROM r)
          SELECT *, CASE WHEN snapshots > 0 THEN round(candidates / snapshots * 100, 3) ELSE 0 END AS candidate_rate_pct,
          CASE WHEN NOT valid THEN 'coverage too low' WHEN snapshots = 0 OR candidates / snapshots < 0.002 THEN 'very few' WHEN candidates / snapshots < 0.01 THEN 'selective' ELSE 'many' END AS assessment FROM v""",
    }
    columns = [c for c in PROFILE if c != "chip_significant_peak_count"]
    shown = ", ".join(["code", "chip_significant_peak_count", *(f"{ref.near(c, _DIGITS.get(c, 6))} AS {c}" for c in columns)])
    out |= {"cost_profile": f"{bars}, {ref.MASS}, {ref.LAST}, {ref.PROFILE} SELECT {shown} FROM profile", "cost_distribution_panel": f"{bars}, {ref.EVERY}, {ref.PROFILE} SELECT date, {shown} FROM profile"}
    state = "FROM picked p LEFT JOIN"
    audit = "coalesce(max(CASE WHEN p.signal = '{0}' THEN 1 END), 0) AS {0}".format
    out |= {
        "ewm": ref.ewm_recursion(),
        "join_universe_context": f"{last} SELECT code, close, CASE WHEN s_suppkey % 3 <> 0 THEN round(abs(s_acctbal) * 1e6, 2) END AS float_market_cap FROM last LEFT JOIN supplier ON code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0')",
        "names_lookup": f"{bars}, {ref.NAMES} SELECT code, date, CASE WHEN CAST(code AS INTEGER) % 3 <> 0 THEN coalesce(name, '') ELSE '' END AS name FROM bars LEFT JOIN names USING (code)",
        "union_signals": f"{picked}, {ref.NAMES} SELECT code, coalesce(any_value(name), '') AS name, count(DISTINCT signal) AS signals {state} names USING (code) GROUP BY 1",
        "top_n": f"{picked}, {summary}, r AS (SELECT p.code, signal, row_number() OVER (PARTITION BY signal ORDER BY {keys}, model_score DESC, p.code) AS rank {state} summary s USING (code)) SELECT * FROM r WHERE rank <= 7",
        "evidence_metadata": f"{bars}, ev AS (SELECT code, max(date) AS d FROM bars WHERE (day(date) + CAST(code AS INTEGER)) % 11 = 0 AND date <= DATE '2001-12-15' GROUP BY 1) SELECT true AS loaded, count(*) AS matched_codes, max(d) AS newest_date, '' AS note FROM ev",
        "require_fresh_benchmark": f"{bars} SELECT max(date) AS last_date, session, CAST(max(date) AS VARCHAR) = session AS fresh FROM bars, (VALUES ('{AS_OF}'), ('2002-01-01')) v(session) GROUP BY session",
        "label_view": f"{picked} SELECT code, CASE signal WHEN 'chip_base_ready' THEN 'Ready' ELSE signal END AS signal, round(model_score, 2) AS model_score, round(model_score / 8, 2) AS ratio FROM picked",
        "join_reference_audit": f"""{status}, {picked.removeprefix('WITH ' + ref.BARS + ', ')}, {ref.NAMES}, listed AS (SELECT code, CAST(code AS INTEGER) AS k FROM names WHERE CAST(code AS INTEGER) % 4 < 2)
          SELECT l.code, CASE WHEN k % 6 <> 0 THEN any_value(n.name) ELSE 'listed ' || l.code END AS name, k % 4 AS acceptance_example, CASE WHEN count(p.code) > 0 THEN 1 ELSE 0 END AS selected_any, any_value(s.status) AS fetch_status, any_value(s.last_date) AS last_date, any_value(s.bars) AS bars,
          CASE WHEN k % 6 <> 0 THEN 1 ELSE 0 END AS in_universe, CASE WHEN any_value(s.bars) > 0 THEN 1 ELSE 0 END AS indicators_ready, {', '.join(map(audit, signals.SIGNALS))}, CASE WHEN k % 5 = 0 THEN 'chip_base_ready' END AS closest_signal, CASE WHEN k % 5 = 0 THEN 'liquidity' END AS failed_at
          FROM listed l LEFT JOIN names n USING (code) LEFT JOIN status s USING (code) LEFT JOIN picked p USING (code) GROUP BY l.code, k""",
        "publish_run": f"""{picked} SELECT '2001-12-28' AS session, 'selected' AS artefact, count(*) AS n, min(code) AS first_code FROM picked UNION ALL SELECT s, 'scored', count(*), min(code) FROM last, (VALUES ('2001-12-28'), ('{AS_OF}')) v(s) GROUP BY s
          UNION ALL SELECT '{AS_OF}', 'provisional_selected', count(*), min(code) FROM picked""",
        "publish_shape_checkpoint": f"{picked} SELECT 'shape_only' AS artefact, code, model_score FROM picked".replace("'shape_only' AS artefact", "signal AS artefact"),
        "publish_history": f"""{bars} SELECT code, CAST(year(date) AS INTEGER) AS year, CASE WHEN year(date) = 2001 THEN 'second' ELSE 'first' END AS source, CASE WHEN year(date) = 2001 THEN {day} ELSE DATE '2001-12-15' END AS as_of, count(*) AS bars, sum(close) AS closes FROM bars GROUP BY 1, 2, 3, 4""",
    }
    low = "CASE WHEN volume > 5 THEN volume END"
    out |= {
        "scan_universe": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CAST(CASE s_suppkey % 3 WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS version, CASE s_suppkey % 3 WHEN 2 THEN 'fresh' ELSE 'stale' END AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "scan_evidence": f"{bars} SELECT code, date, CASE WHEN CAST(code AS INTEGER) % 5 <> 0 THEN volume * 1000 END AS flow, CAST(NULL AS DOUBLE) AS ratio FROM bars WHERE day(date) = 7 AND month(date) <> 3",
        "clean_bars": f"{bars} SELECT code, date, high, close, CASE WHEN day(date) <> 7 THEN turnover END AS turnover FROM bars WHERE day(date) NOT IN (5, 6)",
        "pct_rank_average": f"{bars}, v AS (SELECT code, date, {low} AS x FROM bars) SELECT code, date, floor(CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2) / count(x) OVER (PARTITION BY date) END * 1e6 + 0.5) / 1e6 AS share FROM v",
        "daily_rank": f"{bars} SELECT code, date, CAST(row_number() OVER (PARTITION BY date ORDER BY volume DESC, code) AS INTEGER) AS daily_rank FROM bars",
        "normalize_code": "SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 37 AS VARCHAR)) >= 6 THEN CAST(o_orderkey * 37 AS VARCHAR) ELSE lpad(CAST(o_orderkey * 37 AS VARCHAR), 6, '0') END AS code FROM orders",
    }
    no = "CAST(code AS INTEGER)"
    kept = f"SELECT code, date, close, date <= DATE '2001-12-15' AS early, {no} % 3 = 0 AND date > {day} - 60 AS again, {no} % 5 = 0 AS anew FROM bars"
    quoted = """q AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_suppkey AS k, CASE WHEN s_suppkey % 13 <> 0 THEN s_name END AS name FROM supplier WHERE s_suppkey % 13 = 0 OR (s_suppkey % 17 <> 0 AND s_suppkey % 23 <> 0 AND NOT contains(upper(s_name), 'ST')))"""
    holes = "(SELECT * FROM bars WHERE (day(date) + CAST(code AS INTEGER)) % 6 <> 0)"
    lists = ref.watchlist_queries(sessions, FIXTURE.watchlist_ttl_sessions, day)
    out |= {
        "publish_history_refresh": f"""{bars}, k AS ({kept}), last AS (SELECT code, date, CASE WHEN again AND NOT anew THEN close + 1 ELSE close END AS close, CASE WHEN anew THEN 'third' WHEN again THEN 'second' ELSE 'first' END AS source,
          CASE WHEN anew OR again THEN {day} ELSE DATE '2001-12-15' END AS as_of FROM k WHERE CASE WHEN anew THEN year(date) = 2001 ELSE early OR again END) SELECT * FROM last""",
        "scan_history": f"""{bars}, u AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_suppkey % 7 AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey), h AS (SELECT code, count(*) AS n FROM bars WHERE year(date) = 2001 AND date <= CASE WHEN {no} % 7 = 4 THEN DATE '2001-12-18' ELSE DATE '2001-12-20' END GROUP BY 1)
          SELECT code, CASE r WHEN 0 THEN 'missing' WHEN 1 THEN 'incompatible' WHEN 2 THEN 'empty' WHEN 3 THEN 'corrupt' WHEN 4 THEN 'stale_date' ELSE 'fresh' END AS state, CASE WHEN r >= 4 THEN n ELSE 0 END AS bars,
          CASE WHEN r = 4 THEN DATE '2001-12-18' WHEN r > 4 THEN DATE '2001-12-20' END AS last_date FROM u LEFT JOIN h USING (code)""",
        "refresh_features": f"{whole}, numbered AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS number_of_bar FROM {chain.name}) SELECT code, date, number_of_bar AS bars, {', '.join(map(_shown_sql, dict.fromkeys(c for f in FAMILIES.values() for c in f)))} FROM numbered WHERE date >= DATE '{REFRESHED}'",
        "feature_panel_repeats": f"{whole} SELECT code, date, {', '.join(map(_shown_sql, ('ma20', 'dif', 'rsi14', 'position_250', 'vol_ratio_20', 'atr14', 'adaptive_base_quality', 'rebound_base_quality')))} FROM {chain.name}",
        "cost_profile_repeats": f"{bars.replace('bars AS', 'every_bar AS', 1)}, bars AS (SELECT * REPLACE (CASE WHEN day(date) <> 7 THEN turnover END AS turnover) FROM every_bar), {ref.MASS}, {ref.LAST}, {ref.PROFILE} SELECT {shown} FROM profile",
        "filter_universe_ingested": f"WITH {quoted} SELECT code, name, 'sh' AS market, CAST(k % 50 AS DOUBLE) AS latest FROM q",
        "scan_ingested": f"""{gaps}, {quoted}, have AS (SELECT code, count(*) AS bars, max(date) AS last_date, arg_max(close, date) AS close FROM gaps GROUP BY 1),
          s AS (SELECT q.code, coalesce(bars, 0) AS bars, last_date, CASE WHEN bars IS NULL THEN 'failed' WHEN last_date < {day} THEN 'stale_hist' WHEN bars < {FIXTURE.min_history_bars} THEN 'insufficient_bars' ELSE 'ok' END AS status, coalesce(q.name, '') AS n, close AS c FROM q LEFT JOIN have USING (code))
          SELECT code, bars, last_date, status, CASE WHEN status = 'ok' THEN n END AS name, CASE WHEN status = 'ok' THEN c END AS close FROM s""",
        "join_evidence_panel": f"""{bars}, ev AS (SELECT code, date - 1 AS at, volume AS flow, CASE WHEN volume > 30 THEN high END AS price FROM bars WHERE (day(date) + {no}) % 11 = 0 AND {no} % 10 <> 0)
          SELECT b.code, b.date, coalesce(e.price, b.close) AS close, CAST(e.at AS DATE) AS evidence_date, e.flow FROM bars b ASOF LEFT JOIN ev e ON b.code = e.code AND b.date >= e.at""",
        "watchlist_stream": lists["watchlist_replay"].replace("LEFT JOIN bars b", f"LEFT JOIN {holes} b").replace("QUALIFY close > top", f"QUALIFY close > top AND (day(date) + {no}) % 6 <> 0"),
        "append_transitions_stream": lists["watchlist_transitions"].replace("signals, close ", "signals, CASE WHEN last_evaluated_date >= DATE '2001-05-01' THEN close + 2 ELSE close END AS close "),
    }
    whole = ref.features()
    out |= ref.backtest_queries(whole, FIXTURE, PERIOD, (1, 2, *FIXTURE.top_k)) | ref.scan_queries(whole, FIXTURE, day, summary, keys) | lists
    return out | ref.signal_queries(whole, FIXTURE) | ingest.ORACLES
