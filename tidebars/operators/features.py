"""Rolling features of daily bars. Each function adds columns; all share one partitioning by code and order by date."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import frames
from ..functions.frames import W, ago, back, exponential_means, flag, over, pct, pdiv, rolling, yes

C = F.col
NUMBERS = ("open", "high", "low", "close", "volume", "amount", "turnover", "amplitude", "pct_chg", "chg")


def clean_bars(bars: DataFrame) -> DataFrame:
    """Numbers as doubles with NaN and infinities as null; rows without date, prices or volume are left out."""
    number = lambda c: C(c).cast("double")
    have = {c: F.when(F.abs(number(c)) < float("inf"), number(c)) if c in bars.columns else F.lit(None).cast("double") for c in NUMBERS}
    return bars.withColumns(have).na.drop(subset=["date", "open", "high", "low", "close", "volume"])


def dedupe_bars(bars: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row for each code and date, the last ingested; without such a column any of them, but of the same rows always the same one.

    It is a look at the next row of the code's bars, so it shares exchange and order with all other frames."""
    last = C(order) if order in bars.columns else F.xxhash64(*(c for c in NUMBERS if c in bars.columns))
    line = Window.partitionBy("code").orderBy("date", "_order")
    df = bars.withColumn("_order", last)
    return df.withColumn("_next", F.lead("date").over(line)).where(~C("_next").eqNullSafe(C("date"))).drop("_next", "_order")


def prepared(bars: DataFrame) -> DataFrame:
    """Bars as every feature and cost function takes them: cleaned, then one row a day."""
    return dedupe_bars(clean_bars(bars))


def fill_change_cols(bars: DataFrame) -> DataFrame:
    """pct_chg and amplitude, where missing, from the close before."""
    last = ago("close")
    return bars.withColumns({"pct_chg": F.coalesce("pct_chg", pct(C("close"), last)), "amplitude": F.coalesce("amplitude", over(C("high") - C("low"), last) * 100)})


#: The exponential means by what each is of: its weight, and the number of values before which it is null.
MEANS = {"_fast": ("close", 2 / 13, 1), "_slow": ("close", 2 / 27, 1), "dea": ("dif", 2 / 10, 1), "_up": ("gain", 1 / 14, 14), "_down": ("loss", 1 / 14, 14)}


WINDOWS, QUANTILES = (20, 30, 40, 60), (0.9, 0.1)


def _name(func: str, x: str, n: int, m: int | None, k: int) -> str:
    return f"_{func}_{x}_{n}_{n if m is None else m}_{k}"


#: The frames that features read: func of x over the n bars that end k bars ago, null unless m of them (None: all) have a value.
FRAMES: dict[str, tuple[str, str, int, int | None, int]] = {
    _name(*frame): frame
    for frame in (
        *(("avg", "close", n, None, 0) for n in (5, 10, 20, 30, 60, 120)),
        *(("avg", "volume", n, None, k) for n, k in ((20, 1), (5, 0), (20, 5))), ("avg", "amount", 20, None, 1), ("avg", "turnover", 20, 10, 1), ("avg", "amplitude", 20, 10, 1), ("avg", "fall", 5, 1, 0),
        ("sum", "volume", 20, None, 0), ("sum", "up", 10, None, 0), ("sum", "down", 10, None, 0), *(("sum", f"mass{p}", 60, 30, 0) for p in (0, 1, 2)),
        *(("max", "high", n, None, 1) for n in (5, 20, 60)), ("min", "low", 20, None, 1),
        *((f, x, n, None, 0) for n in (10, 20, 60, 120) for f, x in (("max", "high"), ("min", "low"))), *((f, x, n, m, 0) for n, m in ((120, 80), (250, 120)) for f, x in (("max", "high"), ("min", "low"))),
        *((f, x, n, m, 3) for n, m in ((20, None), (120, 80)) for f, x in (("max", "high"), ("min", "low"))),
        ("std", "close", 20, None, 0), ("std", "close", 20, None, 3), ("avg", "close", 20, None, 3), ("sum", "turnover", 20, 15, 3), *(("sum", "turnover", w, max(15, int(w * 0.7)), 0) for w in WINDOWS), ("sum", "turnover", 20, 15, 0),
        ("avg", "range", 14, None, 0), ("avg", "atr_pct", 20, None, 1), ("avg", "bb_width_pct", 20, None, 1),
    )
}
FRAME_BARS = ("open", "high", "low", "close", "volume", "amount", "turnover", "amplitude")
TAIL = 250  # bars that a frame, a frame of frames or a base looks back at most
LOOK = 128  # bars that a feature looks back at most beside those, by windows

#: The candidates for the best base by prefix: short prefix, weight of the return in a base's quality, and for each candidate its kind (a window of WINDOWS by quantiles, or 20 bars by
#: extremes), offset, window and penalty.
CANDIDATES: dict[str, tuple[str, float, list[tuple[int, int, int, float]]]] = {
    "adaptive_base": ("adaptive", 0.55, [(k, o, w, o * 0.08 + (max(WINDOWS) - w) * 0.035) for k, w in enumerate(WINDOWS) for o in (0, 3, 5, 8, 12, 16, 20, 25, 30)]),
    "rebound_base": ("rebound", 0.60, [(len(WINDOWS), o, 20, o * 0.15) for o in range(4, 21)]),
}
AGO = max(offset for _, _, some in CANDIDATES.values() for _, offset, _, _ in some)


def _base_columns(prefix: str) -> tuple[str, ...]:
    names = ("window", "offset", "high", "low", "mid", "width_pct", "return_pct", "turnover_sum_pct", "drawdown_120_pct", "position_120")
    return (*(f"{prefix}_{x}" for x in names), f"{CANDIDATES[prefix][0]}_pre_base_decline_60_pct", f"{prefix}_quality", f"distance_from_{prefix}_high_pct")


ROWS = 1 << 13  # of a batch that the pass gives back, where it leaves rows out
FOUND = tuple(f"_{c}" for prefix in CANDIDATES for c in _base_columns(prefix))


#: What the features below read of the pass: all but what only the bases read.
READ = (*(c for c, (_, x, _, _, k) in FRAMES.items() if (x, k) != ("turnover", 0)), *MEANS, "dif", *FOUND)


def roll(func: str, x: str, n: int, m: int | None = None, k: int = 0) -> Column:
    """One of FRAMES, which in_order adds; any other frame by a window."""
    windows = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_pop}
    name = _name(func, x, n, m, k)
    return C(name) if name in FRAMES else frames.roll(windows[func], x, n, m, k)


def _frames(bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """FRAMES of one code's bars in order; NaN is a missing value. Values derived from bars are those of the functions below, in the same order of operations."""
    x, nan = dict(bars), np.nan
    close, high, low, volume = x["close"], x["high"], x["low"], x["volume"]
    last = np.append(nan, close[:-1])
    share = lambda a, b: a / np.where(b != 0, b, nan)
    with np.errstate(all="ignore"):
        change, third = close - last, high + low + close
        x["amplitude"] = np.where(np.isnan(x["amplitude"]), share(high - low, last) * 100, x["amplitude"])
        x |= {"up": np.where(change > 0, volume, 0.0), "down": np.where(change < 0, volume, 0.0), "fall": np.where(change < 0, volume, nan)}
        x |= {"mass0": volume, "mass1": third * volume, "mass2": third**2 * volume, "range": np.fmax(np.fmax(high - low, np.abs(high - last)), np.abs(low - last))}
        x["atr_pct"] = share(rolling("avg", x["range"], 14), close) * 100
        x["bb_width_pct"] = share(4 * rolling("std", close, 20), rolling("avg", close, 20)) * 100
        return {name: rolling(func, x[of], n, m, k) for name, (func, of, n, m, k) in FRAMES.items()}


def _return(n: int) -> Column:
    return pct(C("close"), ago("close", n))


def _one_price_limit() -> Column:
    return flag((F.abs(C("high") - C("low")) <= 0.001) & (C("pct_chg") >= 9.5))


def trend(bars: DataFrame) -> DataFrame:
    """Means, MACD, RSI, returns, slopes and alignment."""
    df = in_order(bars).withColumns({f"ma{n}": roll("avg", "close", n) for n in (5, 10, 20, 30, 60, 120)})
    df = df.withColumn("macd_hist", 2 * (C("dif") - C("dea")))
    df = df.withColumn("rsi14", F.when((C("_down") == 0) & (C("_up") == 0), 50.0).when(C("_down") == 0, 100.0).otherwise(100 - 100 / (1 + over(C("_up"), C("_down")))))
    return df.withColumns(
        {
            "macd_rising": flag(C("macd_hist") > ago("macd_hist")),
            "dif_slope_3_pct": over(C("dif") - ago("dif", 3), C("close")) * 100,
            **{f"return_{n}d_pct": _return(n) for n in (5, 10, 20, 60, 120)},
            **{f"extension_ma{n}_pct": pct(C("close"), C(f"ma{n}")) for n in (20, 60)},
            "ma5_slope_3_pct": pct(C("ma5"), ago("ma5", 3)),
            **{f"ma{n}_slope_5_pct": pct(C(f"ma{n}"), ago(f"ma{n}", 5)) for n in (20, 30, 60)},
            "bull_alignment_5_20_30": flag((C("close") > C("ma5")) & (C("ma5") > C("ma20")) & (C("ma20") > C("ma30")) & (C("close") > C("ma60"))),
            "cross_ma5_up": flag((C("close") > C("ma5")) & (ago("close") <= ago("ma5")) & (C("close") > C("open"))),
        }
    ).drop("_fast", "_slow", "_up", "_down")


def volumes(df: DataFrame) -> DataFrame:
    """Volume baselines and ratios, balance, turnover ratio and volume-weighted cost moments."""
    change = C("close") - ago("close")
    df = in_order(df).withColumn("_obv", F.coalesce(F.signum(change), F.lit(0.0)) * C("volume"))
    df = df.withColumns({"vma20_prev": roll("avg", "volume", 20, k=1), "amount_ma20_prev": roll("avg", "amount", 20, k=1), "turnover_ma20_prev": roll("avg", "turnover", 20, 10, 1), "_sum": F.sum("_obv").over(W())})
    up, down = roll("sum", "up", 10), roll("sum", "down", 10)
    mass = lambda p: roll("sum", f"mass{p}", 60, 30)  # noqa: E731  # of thrice the typical price, whole in whole cents
    df = df.withColumns(
        {
            "vol_ratio_20": over(C("volume"), C("vma20_prev")),
            "volume_contraction_5_20": over(roll("avg", "volume", 5), roll("avg", "volume", 20, k=5)),
            "turnover_ratio_20": over(C("turnover"), C("turnover_ma20_prev")),
            "up_down_volume_ratio_10": pdiv(up, down),
            "obv_slope_10_pct": over(C("_sum") - ago("_sum", 10), roll("sum", "volume", 20)) * 100,
            "pullback_volume_ratio_5": over(roll("avg", "fall", 5, 1), C("vma20_prev")),
            "cost_center_60": over(mass(1), mass(0)) / 3,
            "_square": over(mass(2), mass(0)) / 9,
        }
    )
    spread = F.sqrt(F.greatest(C("_square") - C("cost_center_60") ** 2, F.lit(0.0)))
    return df.withColumns({"cost_concentration_60_pct": over(spread, C("cost_center_60")) * 100, "distance_to_cost_center_pct": pct(C("close"), C("cost_center_60"))}).drop("_obv", "_sum", "_square")


def _count(mark: str, n: int, m: int) -> Column:
    """How many of the last n bars have the mark (0 or 1, never null), null before m bars: the running count less that of n bars ago."""
    so_far = F.sum(mark).over(W().rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum(mark).over(W().rowsBetween(Window.unboundedPreceding, -n))
    return F.when(C("_no") >= m, so_far - F.coalesce(before, F.lit(0)))


def ranges(df: DataFrame) -> DataFrame:
    """Extremes, breakouts, true range, bands, positions, wicks and bar patterns. Needs trend, volumes and fill_change_cols."""
    size = C("high") - C("low")
    df = in_order(df).withColumns(
        {
            **{f"prior_high_{n}": roll("max", "high", n, k=1) for n in (5, 20, 60)},
            "prior_low_20": roll("min", "low", 20, k=1),
            **{f"range_width_{n}_pct": pct(roll("max", "high", n), roll("min", "low", n)) for n in (10, 20, 60, 120)},
            "position_120": over(C("close") - roll("min", "low", 120, 80), roll("max", "high", 120, 80) - roll("min", "low", 120, 80)),
            "position_250": over(C("close") - roll("min", "low", 250, 120), roll("max", "high", 250, 120) - roll("min", "low", 250, 120)),
            "range_position_10": over(C("close") - roll("min", "low", 10), roll("max", "high", 10) - roll("min", "low", 10)),
            "upper_wick_ratio": over(C("high") - F.greatest("open", "close"), size),
            "lower_wick_ratio": over(F.least("open", "close") - C("low"), size),
            "amplitude_ma20_prev": roll("avg", "amplitude", 20, 10, 1),
            "one_price_limit": _one_price_limit(),
        }
    )
    df = df.withColumns({"atr14": roll("avg", "range", 14), "bb_width_pct": over(4 * roll("std", "close", 20), C("ma20")) * 100, "range_convergence_ratio_20_60": over(C("range_width_20_pct"), C("range_width_60_pct"))})
    df = df.withColumn("atr_pct", over(C("atr14"), C("close")) * 100)
    near_high, wick = C("high") >= C("prior_high_20") * 0.985, C("lower_wick_ratio") >= 0.30
    df = df.withColumns(
        {
            "dist_to_prior_high20_pct": pct(C("close"), C("prior_high_20")),
            "dist_to_prior_high60_pct": pct(C("close"), C("prior_high_60")),
            "breakout_20": flag((C("close") > C("prior_high_20")) & (ago("close") <= ago("prior_high_20"))),
            "close_above_prior_high5": flag(C("close") > C("prior_high_5")),
            "atr_contraction_ratio": over(C("atr_pct"), roll("avg", "atr_pct", 20, k=1)),
            "bb_contraction_ratio": over(C("bb_width_pct"), roll("avg", "bb_width_pct", 20, k=1)),
            "upper_probe": flag((C("upper_wick_ratio") >= 0.40) & near_high & (C("vol_ratio_20") >= 0.80)),
            "false_break_recovery": flag((C("low") < C("prior_low_20") * 0.995) & (C("close") > C("prior_low_20")) & wick),
            "support_acceptance": flag((C("low") <= C("prior_low_20") * 1.03) & wick & (C("close") >= C("open")) & (C("vol_ratio_20") >= 0.75)),
            "resistance_test": flag(near_high & (C("high") <= C("prior_high_20") * 1.03)),
            "low_position_turnover_peak": flag((C("position_120") <= 0.60) & (C("turnover_ratio_20") >= 1.5) & (C("close") >= C("open"))),
            "distribution_day": flag((C("turnover_ratio_20") >= 1.8) & (C("amplitude") >= C("amplitude_ma20_prev") * 1.4) & (C("pct_chg") <= 1.0) & (C("upper_wick_ratio") >= 0.25)),
            "_no": F.row_number().over(W()),
        }
    )
    counted = ("upper_probe", "false_break_recovery", "support_acceptance", "resistance_test", "low_position_turnover_peak")
    event = F.when(C("breakout_20") == 1, F.struct(C("_no").alias("no"), C("prior_high_20").alias("level"), C("low").alias("low"), C("close").alias("close")))
    df = df.withColumns(
        {
            "contraction_then_expansion": flag((ago("atr_contraction_ratio") <= 0.90) & (C("atr_pct") >= ago("atr_pct") * 1.10)),
            **{f"{c}_count_60": _count(c, 60, 20) for c in counted},
            "distribution_day_count_5": _count("distribution_day", 5, 1),
            "_event": F.last(event, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    live = C("_no") - C("_event.no") <= 10
    df = df.withColumns({"bars_since_breakout": F.when(live, C("_no") - C("_event.no")), **{a: F.when(live, C(f"_event.{b}")) for a, b in (("recent_breakout_level", "level"), ("breakout_event_low", "low"), ("breakout_event_close", "close"))}})
    soon = C("bars_since_breakout").between(1, 3)
    return df.withColumns(
        {
            "retest_distance_pct": pct(C("close"), C("recent_breakout_level")),
            "retest_touch": flag((C("low") <= C("recent_breakout_level") * 1.02) & (C("close") >= C("recent_breakout_level") * 0.985)),
            "breakout_failed_fast": flag(soon & (yes(C("close") < C("recent_breakout_level") * 0.98) | yes(C("close") < C("breakout_event_low")))),
            "breakout_stall_distribution": flag(soon & (C("turnover_ratio_20") >= 1.5) & (C("amplitude") >= C("amplitude_ma20_prev") * 1.3) & (C("close") <= C("breakout_event_close") * 1.01)),
        }
    ).drop("_no", "_event")


def fixed_platform(df: DataFrame) -> DataFrame:
    """The 20 bars that ended 3 bars ago as a base."""
    high, low = roll("max", "high", 20, k=3), roll("min", "low", 20, k=3)
    df = in_order(df).withColumns({"base_high_20_pre3": high, "base_low_20_pre3": low, "_top": roll("max", "high", 120, 80, 3), "_floor": roll("min", "low", 120, 80, 3)})
    mid = (C("base_high_20_pre3") + C("base_low_20_pre3")) / 2
    return df.withColumns(
        {
            "base_mid_20_pre3": mid,
            "base_width_20_pre3_pct": pct(C("base_high_20_pre3"), C("base_low_20_pre3")),
            "base_close_cv_20_pre3_pct": over(roll("std", "close", 20, k=3), roll("avg", "close", 20, k=3)) * 100,
            "base_return_20_pre3_pct": pct(ago("close", 3), ago("close", 22)),
            "base_turnover_sum_20_pre3_pct": roll("sum", "turnover", 20, 15, 3),
            "base_drawdown_from_120_high_pct": pct(ago("close", 3), C("_top")),
            "base_position_120_pre3": over(mid - C("_floor"), C("_top") - C("_floor")),
            "pre_base_decline_60_pct": pct(ago("close", 22), ago("close", 82)),
            "distance_from_base_high_pct": pct(C("close"), C("base_high_20_pre3")),
            "distance_from_base_mid_pct": pct(C("close"), mid),
        }
    ).drop("_top", "_floor")


def _base(close: np.ndarray, found: dict[str, np.ndarray], high: np.ndarray, low: np.ndarray, window: int, end: bool) -> dict[str, np.ndarray]:
    """The base that each bar ends, of one code's bars in order; its drawdown is that of its end or of its middle."""
    top, floor = found[_name("max", "high", 120, 80, 0)], found[_name("min", "low", 120, 80, 0)]
    share = lambda a, b: a / np.where(b != 0, b, np.nan)
    gain = lambda a, b: (share(a, b) - 1) * 100
    first, mid = back(close, window - 1), (high + low) / 2
    return {
        "high": high, "low": low, "mid": mid, "width": gain(high, low), "ret": gain(close, first), "turnover": found[_name("sum", "turnover", window, max(15, int(window * 0.7)), 0)],
        "drawdown": gain(close if end else mid, top), "position": share(mid - floor, top - floor), "decline": gain(first, back(close, window + 59)),
    }


def _best_bases(close: np.ndarray, found: dict[str, np.ndarray], quantiles: np.ndarray) -> dict[str, np.ndarray]:
    """FOUND of one code's bars in order: of each prefix the candidate of least quality, the first on ties. A base that ended some bars ago is that of the bar then."""
    out: dict[str, np.ndarray] = {}
    with np.errstate(all="ignore"):
        bases = [_base(close, found, quantiles[:, 2 * k], quantiles[:, 2 * k + 1], w, False) for k, w in enumerate(WINDOWS)]
        bases.append(_base(close, found, found[_name("max", "high", 20, None, 0)], found[_name("min", "low", 20, None, 0)], 20, True))
        for prefix, (_, weight, candidates) in CANDIDATES.items():
            own = [b["width"] + np.abs(b["ret"]) * weight for b in bases]
            best, chosen = np.full(len(close), np.nan), np.full(len(close), -1)
            for i, (k, offset, _, penalty) in enumerate(candidates):
                quality = back(own[k], offset) + penalty
                better = (quality < best) | (np.isnan(best) & ~np.isnan(quality))
                best, chosen = np.where(better, quality, best), np.where(better, i, chosen)
            some = np.flatnonzero(chosen >= 0)
            k, offset, window = (np.array([c[i] for c in candidates])[chosen[some]] for i in range(3))

            def of(values: np.ndarray, some: np.ndarray = some) -> np.ndarray:
                whole = np.full(len(close), np.nan)
                whole[some] = values
                return whole

            one = {x: of(np.stack([b[x] for b in bases])[k, some - offset]) for x in bases[0]}
            shown = (of(window), of(offset), *(one[x] for x in ("high", "low", "mid", "width", "ret", "turnover", "drawdown", "position", "decline")), best, (close / np.where(one["high"] != 0, one["high"], np.nan) - 1) * 100)
            out |= dict(zip((f"_{c}" for c in _base_columns(prefix)), shown, strict=True))
    return out


def _with_base(df: DataFrame, prefix: str) -> DataFrame:
    shown = {c: C(f"_{c}").cast("int") if c.endswith(("_window", "_offset")) else C(f"_{c}") for c in _base_columns(prefix)}
    return df.withColumns(shown).drop(*(f"_{c}" for c in shown))


def rebound_platform(df: DataFrame) -> DataFrame:
    """The tightest base of 20 bars that ended 4 to 20 bars ago, by extremes of high and low."""
    return _with_base(in_order(df), "rebound_base").drop("rebound_base_window")


def _between(ordered: np.ndarray, at: float) -> np.ndarray:
    """The value at a place of each ordered row, between two of them in proportion. The lower one's part isn't rounded before the sum is, as in a fused
    product and sum: two roundings put a tenth of the values a last bit beside the quantile, and what is then compared with a limit on its wrong side."""
    low = int(at)
    a, b = ordered[:, low], ordered[:, min(low + 1, ordered.shape[1] - 1)]
    return (a.astype(np.longdouble) * (low + 1 - at) + b * (at - low)).astype(np.float64)


def rolling_quantiles(closes: np.ndarray, window: int, quantiles: tuple[float, ...] = QUANTILES, rows: int = 1 << 12) -> np.ndarray:
    """The quantiles of each full window of closes, a row a window: of some thousand windows at once only the places that count are put in order."""
    windows = np.lib.stride_tricks.sliding_window_view(closes, window)
    places = sorted({min(int((window - 1) * q) + i, window - 1) for q in quantiles for i in (0, 1)})
    parts = []
    for low in range(0, len(windows), rows):
        ordered = np.partition(windows[low : low + rows], places, axis=1)
        parts.append(np.stack([_between(ordered, (window - 1) * q) for q in quantiles], 1))
    return np.concatenate(parts)


class _Line:
    """What a task carries of one code: its last close and bars, and each mean with the number of its values."""

    def __init__(self, seeds: dict | None):
        self.tail, self.known = np.zeros(0), seeds is not None
        self.bars = dict.fromkeys(FRAME_BARS, np.zeros(0))
        self.means = {name: (seeds[name]["value"], seeds[name]["n"]) if seeds else (0.0, 0) for name in MEANS}

    def go_on(self, closes: np.ndarray) -> dict[str, np.ndarray]:
        """Means of the next closes. The first row of a code whose state is known is that state's last bar."""
        change = np.diff(closes, prepend=self.tail if len(self.tail) else np.nan)
        of = {"close": closes, "gain": np.maximum(change, 0.0), "loss": np.maximum(-change, 0.0)}
        out = {}
        for name, (x, alpha, least) in MEANS.items():
            values, skip = of[x], int(self.known) + int(x in ("gain", "loss") and not self.known and not len(self.tail))
            mean, n = self.means[name]
            found = np.concatenate([np.full(min(skip, len(values)), mean if self.known else np.nan), exponential_means(values[skip:], alpha, mean, n)])
            counts = n + np.maximum(np.arange(1 - skip, len(values) + 1 - skip), 0)
            self.means[name] = (float(found[-1]) if counts[-1] else mean, int(counts[-1]))
            out[name] = np.where(counts >= least, found, np.nan)
            if name == "_slow":
                of["dif"] = out["dif"] = out["_fast"] - out["_slow"]
        self.tail, self.known = closes[-1:], False
        return out

    def frames(self, bars: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """FRAMES and FOUND of the next bars, and the quantiles of closes."""
        line = {c: np.concatenate([self.bars[c], x]) for c, x in bars.items()}
        old, new = len(self.bars["close"]), len(bars["close"])
        close, quantiles = line["close"], np.full((old + new, 2 * len(WINDOWS)), np.nan)
        for k, w in enumerate(WINDOWS):
            some = min(len(close) - w + 1, new + AGO)  # windows that end in these rows, or in those that a base may have ended with
            if some > 0:
                quantiles[-some:, 2 * k : 2 * k + 2] = rolling_quantiles(close[-(some + w - 1) :], w)
        found = _frames(line)
        found |= _best_bases(close, found, quantiles)
        self.bars = {c: x[-TAIL:] for c, x in line.items()}
        return {name: x[old:] for name, x in found.items()}, quantiles[old:]


def in_order(bars: DataFrame, added: tuple[str, ...] | None = None, last: int | None = None) -> DataFrame:
    """bars with what a bar has from all bars before it: the means of MEANS, dif, FRAMES, the bases of FOUND, and _quantiles, for each window the 90 % and 10 % quantiles of
    its closes; null until there are values enough; of these only those that are `added`, if given. One pass over the narrow bars in order, in which a task keeps the last bars
    and the means of one code, so histories may have any length. Closes may not be null. Bars that have been through it stay as they are.

    With last only the last rows of each code come back, with _number, their number in the history, and _left, how many rows come after them: the means have seen
    all rows, and what looks back on some bars is worked out for these alone.

    Bars may have a column seeds, a struct of a struct (value, n) for each mean: then a code's first row is a bar that they hold already, and
    the means go on from it."""
    if FOUND[0] in bars.columns:
        return bars
    added = tuple(x for x in (*MEANS, "dif", *FRAMES, *FOUND, "_quantiles") if added is None or x in added)
    kinds = {"_quantiles": T.ArrayType(T.DoubleType())}
    places = () if last is None else ("_number", "_left")
    schema = T.StructType([*bars.schema, *(T.StructField(c, kinds.get(c, T.DoubleType())) for c in added), *(T.StructField(c, T.LongType()) for c in places)])
    seeded, framed = "seeds" in bars.columns, not {*added} <= {*MEANS, "dif"}

    def segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        codes = batch.column("code").dictionary_encode()
        edges = np.append(np.flatnonzero(np.diff(codes.indices.fill_null(-1).to_numpy(), prepend=-2)), batch.num_rows)
        return zip(edges[:-1], edges[1:], strict=True)

    def column(batch: pa.RecordBatch, c: str) -> np.ndarray:
        return batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) if c in batch.schema.names else np.full(batch.num_rows, np.nan)

    def joined(columns: list[pa.Array], names: list[str], parts: list[tuple[dict[str, np.ndarray], np.ndarray]], more: dict[str, np.ndarray]) -> pa.RecordBatch:
        some = lambda c: pa.array(np.concatenate([m[c] for m, _ in parts]), pa.float64(), from_pandas=True)
        lists = lambda: pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([q for _, q in parts]).ravel(), from_pandas=True), 2 * len(WINDOWS)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*columns, *(lists() if c == "_quantiles" else some(c) for c in added), *map(pa.array, more.values())], [*names, *added, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, code = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = {c: column(batch, c) for c in FRAME_BARS}
            parts: list[tuple[dict[str, np.ndarray], np.ndarray]] = []
            for low, high in segments(batch):
                own = batch.column("code")[low].as_py()
                if line is None or low or own != code:
                    line, code = _Line(batch.column("seeds")[low].as_py() if seeded else None), own
                found, quantiles = line.frames({c: x[low:high] for c, x in of.items()}) if framed else ({}, np.zeros(0))
                parts.append((line.go_on(of["close"][low:high]) | found, quantiles))
            yield joined(batch.columns, batch.schema.names, parts, {})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.RecordBatch, dict[str, np.ndarray], int]]]:
        """Each code's last rows with their means and the number of the first of them, in as many pieces as they came in."""
        line, code, held, seen = None, None, [], 0
        for batch in batches:
            for low, high in segments(batch) if batch.num_rows else ():
                own = batch.column("code")[low].as_py()
                if line is None or low or own != code:
                    if held:
                        yield held
                    line, code, held, seen = _Line(batch.column("seeds")[low].as_py() if seeded else None), own, [], 0
                rows = batch.slice(low, high - low)
                held.append((rows, line.go_on(column(rows, "close")), seen))
                seen += rows.num_rows
                while seen - held[0][2] - held[0][0].num_rows >= last + TAIL:
                    held.pop(0)
        if held:
            yield held

    def run_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(some: list) -> pa.RecordBatch:
            columns = [pa.concat_arrays([rows.column(i) for rows, *_ in some]) for i in range(some[0][0].num_columns)]
            return joined(columns, some[0][0].schema.names, [x[1] for x in some], {c: np.concatenate([x[2][c] for x in some]) for c in places})

        done, rows = [], 0
        for held in ends(batches):
            mine = pa.Table.from_batches([x[0] for x in held]).combine_chunks().to_batches()[0]
            mine, total = mine.slice(max(0, mine.num_rows - last - TAIL)), held[-1][2] + held[-1][0].num_rows
            n = min(last, mine.num_rows)
            found, quantiles = _Line(None).frames({c: column(mine, c) for c in FRAME_BARS})
            means = {c: np.concatenate([x[1][c] for x in held])[-n:] for c in held[0][1]}
            number = np.arange(total - n, total)
            done.append((mine.slice(mine.num_rows - n), (means | {c: x[-n:] for c, x in found.items()}, quantiles[-n:]), {"_number": number + 1, "_left": total - 1 - number}))
            rows += n
            if rows >= ROWS:
                yield whole(done)
                done, rows = [], 0
        if done:
            yield whole(done)

    return bars.repartition("code").sortWithinPartitions("code", "date").mapInArrow(run if last is None else run_last, schema)


def adaptive_platform(df: DataFrame) -> DataFrame:
    """The best base over windows and offsets, by the 10 % and 90 % quantiles of the closes."""
    return _with_base(in_order(df), "adaptive_base").drop("_quantiles", *FRAMES)


def price_actions(df: DataFrame) -> DataFrame:
    """Votes of the trend, and flags of launch, rebound and readiness."""
    votes = (C("close") >= C("ma5"), C("close") >= C("ma10"), C("ma5_slope_3_pct") > 0, C("macd_rising") == 1, C("return_5d_pct") > 0)
    df = df.withColumn("adaptive_trend_votes", reduce(lambda a, b: a + b, map(flag, votes)))
    away, n = C("distance_from_adaptive_base_high_pct"), C("adaptive_trend_votes")
    return df.withColumns(
        {
            "early_launch_price_action": flag(C("return_5d_pct").between(3, 35) & (C("close") > C("ma5")) & (C("ma5_slope_3_pct") > 0) & (C("distance_from_base_mid_pct") >= 4) & C("distance_from_base_high_pct").between(-4, 35)),
            "rebound_price_action": flag(C("distance_from_rebound_base_high_pct").between(-2, 55) & C("return_20d_pct").between(3, 60) & (C("close") >= C("ma20") * 0.95)),
            "adaptive_ready_price_action": flag((C("adaptive_base_offset") <= 8) & away.between(-12, 22) & (C("return_20d_pct") <= 35)),
            "adaptive_launch_price_action": flag((C("adaptive_base_offset") <= 10) & away.between(-6, 55) & C("return_20d_pct").between(-2, 60) & (n >= 3)),
            "adaptive_rebound_price_action": flag(C("adaptive_base_offset").between(8, 30) & away.between(-12, 85) & C("return_20d_pct").between(-5, 75) & (n >= 2)),
        }
    )


def all_features(bars: DataFrame) -> DataFrame:
    """All features of prepared bars but the modelled cost distribution. What needs the bars in order comes first, while rows are narrow."""
    df = ranges(volumes(trend(fill_change_cols(in_order(bars, READ)))))
    return price_actions(adaptive_platform(rebound_platform(fixed_platform(df))))


def feature_panel(bars: DataFrame) -> DataFrame:
    """All features of every bar but the modelled cost distribution: bars are cleaned, and rows that repeat a day go."""
    return all_features(prepared(bars))


def tradable(bars: DataFrame) -> DataFrame:
    """Prepared bars with those features alone that say whether a bar may be judged, and its returns: frames of few bars, so windows do without the pass over the bars."""
    df = fill_change_cols(bars)
    return df.withColumns({"amount_ma20_prev": frames.roll(F.avg, "amount", 20, k=1), "one_price_limit": _one_price_limit(), **{f"return_{n}d_pct": _return(n) for n in (20, 60)}})


def latest_features(bars: DataFrame) -> DataFrame:
    """latest_snapshot of feature_panel, where no more than LOOK rows of each code go through what comes after the pass over its bars."""
    df = all_features(in_order(prepared(bars), READ, LOOK))
    return df.where("_left = 0").withColumnRenamed("_number", "bars").drop("_left")


def latest_snapshot(panel: DataFrame) -> DataFrame:
    """Each instrument's last row, with its number of bars."""
    back = Window.partitionBy("code").orderBy(C("date").desc())
    return panel.withColumns({"_at": F.row_number().over(back), "bars": F.count("*").over(Window.partitionBy("code"))}).where("_at = 1").drop("_at")
