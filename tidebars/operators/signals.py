"""Ranks, scores, gates, staged signals, and what they tell of rows that fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import flag, pct, yes
from ..plans.params import Params

C = F.col
SIGNALS = ("chip_base_ready", "chip_base_launch", "chip_base_rebound")


def pct_rank_average(df: DataFrame, col: str, out: str, by: str = "date") -> DataFrame:
    """Ascending rank over values as a share, ties by their mean, null for null. The three counts are frames of one order, so rows are sorted once."""
    day, known = Window.partitionBy(by).orderBy(C(col).asc_nulls_first()), C(col).isNotNull()
    rank = F.count(col).over(day.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.count(col).over(day.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(col).over(day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.when(known, (rank - (ties - 1) / 2) / n))


def relative_strength(df: DataFrame) -> DataFrame:
    """Excess over the benchmark's returns (missing: 0), and ranks of it and of float_market_cap within the day."""
    df = df.withColumns({f"rs{n}_excess_pct": C(f"return_{n}d_pct") - F.coalesce(f"benchmark_return_{n}d_pct", F.lit(0.0)) for n in (20, 60)})
    if "float_market_cap" not in df.columns:
        df = df.withColumn("float_market_cap", F.lit(None).cast("double"))
    for col, out in (("rs20_excess_pct", "rs20_percentile"), ("rs60_excess_pct", "rs60_percentile"), ("float_market_cap", "float_cap_percentile")):
        df = pct_rank_average(df, col, out)
    return df


def join_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark's returns and risk flag of the day (a day without: flag 1). benchmark has date, the two returns and
    benchmark_risk_ok; one row a day, so Spark broadcasts it by its size."""
    return df.join(benchmark, "date", "left").withColumn("benchmark_risk_ok", F.coalesce("benchmark_risk_ok", F.lit(1)))


def _ladder(*steps: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, (flag(c) * n for c, n in steps))


# The column that stands in for one that a frame doesn't have.
FALLBACKS = {
    "adaptive_base_high": "base_high_20_pre3",
    "adaptive_base_width_pct": "base_width_20_pre3_pct",
    "adaptive_base_return_pct": "base_return_20_pre3_pct",
    "adaptive_base_turnover_sum_pct": "base_turnover_sum_20_pre3_pct",
    "adaptive_base_drawdown_120_pct": "base_drawdown_from_120_high_pct",
    "adaptive_base_position_120": "base_position_120_pre3",
    "adaptive_pre_base_decline_60_pct": "pre_base_decline_60_pct",
    "adaptive_launch_price_action": "early_launch_price_action",
    "adaptive_rebound_price_action": "rebound_price_action",
}
FALLBACK_WINDOW, FALLBACK_OFFSET, FALLBACK_VOTES = 20, 3, 3


def column_fallbacks(df: DataFrame) -> DataFrame:
    """df with every column of the adaptive base that scores and gates read: one that is missing is that of the fixed base, or null if
    that is missing too. Columns that are there stay as they are, nulls included."""
    have = set(df.columns)
    launch = F.coalesce(C("early_launch_price_action").cast("int"), F.lit(0)) if "early_launch_price_action" in have else F.lit(0)
    other = {
        **{new: C(old).cast("double") if old in have else F.lit(None).cast("double") for new, old in FALLBACKS.items()},
        "adaptive_ready_price_action": (launch == 0).cast("int"), "adaptive_trend_votes": launch * FALLBACK_VOTES, "adaptive_base_window": F.lit(FALLBACK_WINDOW), "adaptive_base_offset": F.lit(FALLBACK_OFFSET),
    }
    df = df.withColumns({c: x for c, x in other.items() if c not in have})
    return df if "distance_from_adaptive_base_high_pct" in have else df.withColumn("distance_from_adaptive_base_high_pct", pct(C("close"), C("adaptive_base_high")))


# The limits and points of the ladders in scores, and the limits of the gates that Params doesn't name.
def scores(df: DataFrame) -> DataFrame:
    """Partial scores, the three models' scores and score_total. Missing columns as in column_fallbacks."""
    df = column_fallbacks(df)
    if "benchmark_risk_ok" not in df.columns:
        df = df.withColumn("benchmark_risk_ok", F.lit(1))
    width, ret, window = C("adaptive_base_width_pct"), F.abs("adaptive_base_return_pct"), C("adaptive_base_window")
    share, spread, dominance, peaks, low = C("chip_peak_band_share_pct"), C("chip_70_width_pct"), C("chip_peak_dominance"), C("chip_significant_peak_count"), C("chip_low_zone_share_pct")
    fall, place, before = C("adaptive_base_drawdown_120_pct"), C("adaptive_base_position_120"), C("adaptive_pre_base_decline_60_pct")
    within = lambda x, a, b: (x > a) & (x <= b)
    from_ = lambda x, a, b: (x >= a) & (x < b)
    df = df.withColumns(
        {
            "chip_score_base": F.least(F.lit(35), _ladder((width <= 16, 12), (within(width, 16, 28), 8), (within(width, 28, 42), 4), (ret <= 6, 8), (within(ret, 6, 14), 5), (within(ret, 14, 22), 2), (window >= 40, 4), (window.between(20, 39), 2), (C("adaptive_base_turnover_sum_pct") >= 15, 3))),
            "chip_score_profile": F.least(F.lit(35), _ladder((share >= 25, 12), (from_(share, 18, 25), 9), (from_(share, 12, 18), 6), (from_(share, 10, 12), 4), (spread <= 18, 10), (within(spread, 18, 30), 7), (within(spread, 30, 45), 4), (dominance >= 1.5, 5), (from_(dominance, 1.15, 1.5), 3), (peaks <= 2, 4), (peaks.between(3, 4), 2), (low >= 35, 4), (from_(low, 20, 35), 2))),
            # -20 and -12 count on both steps
            "chip_score_context": F.least(F.lit(15), _ladder((fall <= -20, 6), (from_(fall, -20, -8), 4), (place <= 0.40, 5), (within(place, 0.40, 0.75), 3), (within(place, 0.75, 0.88), 1), (before <= -12, 4), (from_(before, -12, -5), 2))),
            "chip_score_launch": F.least(F.lit(15), F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce("adaptive_trend_votes", F.lit(0)))) * 2 + _ladder((C("vol_ratio_20") >= 1.05, 2), (C("up_down_volume_ratio_10") >= 1.15, 2), (C("macd_rising") == 1, 1))),
            "chip_score_risk": F.least(F.lit(5), _ladder((C("distribution_day_count_5") <= 2, 2), (C("breakout_failed_fast") == 0, 1), (C("breakout_stall_distribution") == 0, 1), (F.coalesce("benchmark_risk_ok", F.lit(1)) >= 1, 1))),
        }
    )
    structure = C("chip_score_base") + C("chip_score_profile") + C("chip_score_context") + C("chip_score_risk")
    df = df.withColumns(
        {
            "chip_structure_score": F.least(F.lit(90), structure),
            "chip_base_ready_score": F.least(F.lit(100), structure + flag(C("adaptive_ready_price_action") == 1) * 10),
            **{f"chip_base_{k}_score": F.least(F.lit(100), structure + C("chip_score_launch") + flag(C(f"adaptive_{k}_price_action") == 1) * 5) for k in ("launch", "rebound")},
        }
    )
    return df.withColumn("score_total", F.greatest("chip_base_ready_score", "chip_base_launch_score", "chip_base_rebound_score"))


def gates(p: Params) -> dict[str, list[tuple[str, Column]]]:
    """Each signal's steps in order. A missing value fails its comparison, also where the comparison is then negated."""
    away, offset, votes, peak = C("distance_from_adaptive_base_high_pct"), C("adaptive_base_offset"), C("adaptive_trend_votes"), C("chip_peak_distance_pct")
    width, share, spread = C("adaptive_base_width_pct"), C("chip_peak_band_share_pct"), C("chip_70_width_pct")
    common = [
        ("history_bars", C("bars") >= p.min_history_bars),
        ("liquidity", C("amount_ma20_prev") >= p.min_amount_ma20),
        ("chip_features_ready", (C("one_price_limit") == 0) & C("base_high_20_pre3").isNotNull() & C("chip_peak_price").isNotNull() & yes(C("chip_model_coverage_pct") >= 70)),
    ]

    def low(most: float, place: float, fall: float, decline: float) -> Column:
        return yes(C("position_250") <= most) & (yes(C("adaptive_base_position_120") <= place) | yes(C("adaptive_base_drawdown_120_pct") <= fall) | yes(C("adaptive_pre_base_decline_60_pct") <= decline))

    def calm(below: float) -> Column:
        return yes(C("distribution_day_count_5") <= p.max_distribution_days_5 + 1) & ~(yes(C("breakout_failed_fast") == 1) & yes(away < below))

    def peaked(widest: Column, place: float, least: float) -> Column:
        return widest & yes(C("chip_peak_position") <= place) & yes(share >= least)

    platform = C("adaptive_base_high").isNotNull() & yes(width <= p.max_base_width_pct) & yes(F.abs("adaptive_base_return_pct") <= p.max_base_abs_return_pct)
    strong = yes(share >= p.strong_peak_band_share_pct) & yes(spread <= p.strong_peak_max_70_width_pct)
    recent = yes(offset <= 8)
    early = yes(C("adaptive_launch_price_action") == 1) | (recent & yes(C("return_5d_pct") >= 3) & yes(votes >= 2))
    structure = [
        ("bottom_location", low(p.max_position_250, 0.88, -8, -5)),
        ("sideways_platform", platform),
        ("concentrated_low_chip_peak", peaked(yes(spread <= p.max_70_width_pct) | strong, p.max_peak_position, p.min_peak_band_share_pct)),
        ("risk_control", calm(-8)),
    ]
    back = yes(C("adaptive_rebound_price_action") == 1) | (yes(offset >= 8) & yes(C("return_5d_pct") >= p.rebound_min_return_5d_pct) & yes(votes >= 2))
    rebound = [
        ("rebound_location", low(p.rebound_max_position_250, 0.92, -5, -3)),
        ("recent_historical_platform", C("adaptive_base_high").isNotNull() & yes(offset >= 8) & yes(width <= p.rebound_max_base_width_pct) & yes(F.abs("adaptive_base_return_pct") <= 25)),
        ("rebound_chip_peak", peaked(yes(spread <= p.rebound_max_70_width_pct), p.rebound_max_peak_position, p.rebound_min_peak_band_share_pct)),
        ("rebound_risk_control", calm(-10)),
        ("post_platform_rebound", back & yes(peak.between(-10, p.rebound_max_peak_distance_pct)) & yes(C("return_20d_pct") <= p.rebound_max_return_20d_pct)),
        ("chip_base_rebound_score", C("chip_base_rebound_score") >= p.rebound_score),
    ]
    ready = recent & ~early & yes(peak.between(-12, p.ready_max_peak_distance_pct))
    launch = early & yes(peak.between(-8, p.launch_max_peak_distance_pct)) & yes(C("return_10d_pct") <= p.launch_max_return_10d_pct)
    steps = {
        "chip_base_ready": [*common, *structure, ("waiting_near_peak", ready), ("chip_base_ready_score", C("chip_base_ready_score") >= p.ready_score)],
        "chip_base_launch": [*common, *structure, ("early_launch", launch), ("chip_base_launch_score", C("chip_base_launch_score") >= p.launch_score)],
        "chip_base_rebound": [*common, *rebound],
    }
    return {signal: [(name, yes(ok)) for name, ok in some] for signal, some in steps.items()}


def signal_masks(df: DataFrame, p: Params) -> DataFrame:
    """A boolean column for each signal: all its steps hold."""
    return df.withColumns({s: reduce(lambda a, b: a & b, (ok for _, ok in steps)) for s, steps in gates(p).items()})


def signal_flags(df: DataFrame, p: Params) -> DataFrame:
    """The masks, any_signal, and signal_names: those that hold, in order, with commas."""
    df = signal_masks(df, p)
    return df.withColumns({"any_signal": reduce(lambda a, b: a | b, map(C, SIGNALS)), "signal_names": F.concat_ws(",", *(F.when(C(s), F.lit(s)) for s in SIGNALS))})


def union_signals(selected: DataFrame) -> DataFrame:
    """Each code that has a signal, once, with its name and how many signals it has."""
    return selected.groupBy("code").agg(F.min("name").alias("name"), F.count_distinct("signal").alias("signals"))


def select_signals(df: DataFrame, p: Params) -> DataFrame:
    """A row for each code and signal that it has, ranked within the signal by model score, peak share, amount and code."""
    df = signal_masks(df, p)
    picked = F.filter(F.array(*(F.when(C(s), F.struct(F.lit(s).alias("signal"), C(f"{s}_score").cast("int").alias("model_score"))) for s in SIGNALS)), lambda x: x.isNotNull())
    long = df.withColumn("_s", F.explode(picked)).withColumns({"signal": C("_s.signal"), "model_score": C("_s.model_score")}).drop("_s", *SIGNALS)
    best = Window.partitionBy("signal", *(["date"] if "date" in df.columns else [])).orderBy(C("model_score").desc(), C("chip_peak_band_share_pct").desc_nulls_last(), C("amount_ma20_prev").desc_nulls_last(), "code")
    return long.withColumn("rank", F.row_number().over(best))


def top_n(selected: DataFrame, n: int) -> DataFrame:
    return selected.where(C("rank") <= n)


def funnel_counts(df: DataFrame, p: Params) -> DataFrame:
    """signal, step_number, step, remaining_count and its shares of the step before and of all rows, in per cent."""
    sums, names = [], []
    for s, steps in gates(p).items():
        for i in range(len(steps)):
            names.append((s, i + 1, steps[i][0]))
            sums.append(F.sum(reduce(lambda a, b: a & b, (ok for _, ok in steps[: i + 1])).cast("long")).alias(f"c{len(names) - 1}"))
    one = df.agg(F.count("*").alias("n"), *sums)
    rows = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(i).alias("step_number"), F.lit(step).alias("step"), F.coalesce(C(f"c{k}"), F.lit(0)).alias("remaining_count")) for k, (s, i, step) in enumerate(names)))
    long = one.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    before = F.coalesce(F.lag("remaining_count").over(Window.partitionBy("signal").orderBy("step_number")), C("n"))
    share = lambda of: F.when(of > 0, F.round(C("remaining_count") / F.when(of > 0, of) * 100, 2)).otherwise(0.0)
    return long.withColumn("_b", before).select("signal", "step_number", "step", "remaining_count", share(C("_b")).alias("retention_from_previous_pct"), share(C("n")).alias("retention_from_all_pct"))


def near_misses(df: DataFrame, p: Params, n: int = 100) -> DataFrame:
    """Rows without a signal, by how far they came in the signal that they came furthest in; earlier signals win ties."""
    options = []
    for i, (s, steps) in enumerate(gates(p).items()):
        oks = F.array(*(ok for _, ok in steps))
        first = F.array_position(oks, F.lit(False)).cast("int")
        passed = F.when(first > 0, first - 1).otherwise(len(steps))
        failed = F.when(first > 0, F.get(F.array(*(F.lit(name) for name, _ in steps)), first - 1)).otherwise(F.lit(""))
        options.append(F.struct((passed / len(steps)).alias("ratio"), F.lit(-i).alias("order"), F.lit(s).alias("signal"), failed.alias("failed"), passed.alias("passed"), F.lit(len(steps)).alias("total")))
    best = F.array_max(F.array(*options))
    missed = signal_masks(df, p).where(~reduce(lambda a, b: a | b, (C(s) for s in SIGNALS))).withColumn("_b", best)
    out = missed.select("*", C("_b.signal").alias("closest_signal"), C("_b.failed").alias("failed_at"), C("_b.passed").alias("passed_steps"), C("_b.total").alias("total_steps"), C("_b.ratio").alias("completion_ratio"))
    order = (C("completion_ratio").desc(), C("score_total").desc_nulls_last(), C("chip_peak_band_share_pct").desc_nulls_last(), C("code"))
    return out.orderBy(*order).limit(n).withColumn("near_miss_rank", F.row_number().over(Window.orderBy(*order))).drop("_b", *SIGNALS)
