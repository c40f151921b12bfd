"""DuckDB SQL, written on its own, that the queries' results are held against."""

from __future__ import annotations

BARS = """days AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, CAST(sum(round(l_discount * 100) - 5) AS BIGINT) AS r, CAST(max(round(l_tax * 100)) AS BIGINT) AS hi,
  CAST(min(round(l_tax * 100)) AS BIGINT) AS lo, sum(l_quantity) AS volume,
  CAST(sum((CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) * CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS inflow FROM lineitem GROUP BY 1, 2),
dated AS (SELECT *, DATE '2001-12-31' - CAST(row_number() OVER (PARTITION BY k ORDER BY d DESC) - 1 AS INTEGER) AS date, lpad(CAST(k AS VARCHAR), 6, '0') AS code FROM days),
closed AS (SELECT *, CAST(floor(2000 * exp(CAST(sum(r) OVER (PARTITION BY k ORDER BY d) AS DOUBLE) / 200)) AS BIGINT) AS c FROM dated),
opened AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY k ORDER BY d), c) AS o FROM closed),
bars AS (SELECT code, date, CAST(o AS DOUBLE) AS open, CAST((greatest(o, c) * (400 + hi)) // 400 AS DOUBLE) AS high, CAST((least(o, c) * (400 - lo)) // 400 AS DOUBLE) AS low,
  CAST(c AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume, CAST(volume * c AS DOUBLE) AS amount, volume / 10 AS turnover, inflow FROM opened)"""
OVER = "PARTITION BY code ORDER BY date"


def roll(f: str, x: str, n: int, m: int | None = None, k: int = 0) -> str:
    frame = f"OVER ({OVER} ROWS BETWEEN {k + n - 1} PRECEDING AND {f'{k} PRECEDING' if k else 'CURRENT ROW'})"
    call = f if "(" in f else f"{f}({x})"
    return f"CASE WHEN count({x}) {frame} >= {n if m is None else m} THEN {call} {frame} END"


def ago(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({OVER})"


def pct(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0) - 1) * 100"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def ladder(*steps: tuple[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in steps) + ")"


class Chain:
    """Common table expressions, each with all columns of the one before and some more."""

    def __init__(self, first: str, name: str):
        self.parts, self.name, self.n = [first], name, 0

    def add(self, **columns: str) -> Chain:
        self.n += 1
        self.parts.append(f"s{self.n} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {self.name})")
        self.name = f"s{self.n}"
        return self

    def ewm(self, out: str, x: str, alpha: float, least: int = 1) -> Chain:
        run = f"OVER ({OVER} ROWS UNBOUNDED PRECEDING)"
        self.add(**{f"n_{out}": f"count({x}) {run}"})
        self.add(**{f"f_{out}": f"first_value({x} IGNORE NULLS) {run}"})  # distances from the first value: a mean of values that don't change is that value, exactly
        self.add(**{f"w_{out}": f"CASE WHEN {x} IS NOT NULL THEN ({x} - f_{out}) * pow({1 - alpha!r}, 1 - n_{out}) * {alpha!r} END"})
        return self.add(**{out: f"CASE WHEN n_{out} >= {least} THEN f_{out} + sum(w_{out}) {run} * pow({1 - alpha!r}, n_{out} - 1) END"})


def _base_struct(high: str, low: str, window: int, least: int, end: bool) -> str:
    top, floor, first = roll("max", "high", 120, 80), roll("min", "low", 120, 80), ago("close", window - 1)
    mid = f"(({high}) + ({low})) / 2"
    return (
        f"struct_pack(high := {high}, low := {low}, width := {pct(high, low)}, ret := {pct('close', first)}, turnover := {roll('sum', 'turnover', window, least)}, "
        f"drawdown := {pct('close' if end else mid, top)}, position := ({mid} - ({floor})) / nullif(({top}) - ({floor}), 0), decline := {pct(first, ago('close', window + 59))})"
    )


def _best(chain: Chain, prefix: str, short: str, options: list[tuple[str, int, int, float, float]]) -> Chain:
    chain.add(**{f"o{i}": (c if o == 0 else ago(c, o)) for i, (c, o, _, _, _) in enumerate(options)})
    listed = ", ".join(f"struct_pack(quality := o{i}.width + abs(o{i}.ret) * {w!r} + {p!r}, i := {i}, off := {o}, win := {n}, s := o{i})" for i, (_, o, n, w, p) in enumerate(options))
    chain.add(best=f"list_sort(list_filter([{listed}], lambda x: x.quality IS NOT NULL))[1]")
    chain.add(
        **{
            f"{prefix}_window": "best.win", f"{prefix}_offset": "best.off", f"{prefix}_high": "best.s.high", f"{prefix}_low": "best.s.low", f"{prefix}_mid": "(best.s.high + best.s.low) / 2",
            f"{prefix}_width_pct": "best.s.width", f"{prefix}_return_pct": "best.s.ret", f"{prefix}_turnover_sum_pct": "best.s.turnover", f"{prefix}_drawdown_120_pct": "best.s.drawdown", f"{prefix}_position_120": "best.s.position",
            f"{short}_pre_base_decline_60_pct": "best.s.decline", f"{prefix}_quality": "best.quality", f"distance_from_{prefix}_high_pct": pct("close", "best.s.high"),
        }
    )
    chain.n += 1
    chain.parts.append(f"s{chain.n} AS (SELECT * EXCLUDE (best, {', '.join(f'o{i}' for i in range(len(options)))}) FROM {chain.name})")
    chain.name = f"s{chain.n}"
    return chain


def features() -> Chain:
    c = Chain(BARS, "bars").add(last=ago("close"))
    c.add(pct_chg=pct("close", "last"), amplitude="(high - low) / nullif(last, 0) * 100", change="close - last")
    c.add(gain="greatest(change, 0) + 0 * change", loss="greatest(-change, 0) + 0 * change", third="high + low + close", obv_part="coalesce(sign(change), 0) * volume", fall="CASE WHEN change < 0 THEN volume END", upv="CASE WHEN change > 0 THEN volume ELSE 0.0 END", downv="CASE WHEN change < 0 THEN volume ELSE 0.0 END")
    c.add(**{f"ma{n}": roll("avg", "close", n) for n in (5, 10, 20, 30, 60, 120)})
    c.ewm("fast", "close", 2 / 13).ewm("slow", "close", 2 / 27).add(dif="fast - slow").ewm("dea", "dif", 2 / 10).ewm("up", "gain", 1 / 14, 14).ewm("down", "loss", 1 / 14, 14)
    c.add(macd_hist="2 * (dif - dea)", rsi14="CASE WHEN down = 0 AND up = 0 THEN 50.0 WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END")
    c.add(
        macd_rising=flag(f"macd_hist > {ago('macd_hist')}"), dif_slope_3_pct=f"(dif - {ago('dif', 3)}) / close * 100", ma5_slope_3_pct=pct("ma5", ago("ma5", 3)),
        **{f"return_{n}d_pct": pct("close", ago("close", n)) for n in (5, 10, 20, 60, 120)}, **{f"extension_ma{n}_pct": pct("close", f"ma{n}") for n in (20, 60)},
        **{f"ma{n}_slope_5_pct": pct(f"ma{n}", ago(f"ma{n}", 5)) for n in (20, 30, 60)}, bull_alignment_5_20_30=flag("close > ma5 AND ma5 > ma20 AND ma20 > ma30 AND close > ma60"),
        cross_ma5_up=flag(f"close > ma5 AND last <= {ago('ma5')} AND close > open"),
        vma20_prev=roll("avg", "volume", 20, k=1), amount_ma20_prev=roll("avg", "amount", 20, k=1), turnover_ma20_prev=roll("avg", "turnover", 20, 10, 1), obv=f"sum(obv_part) OVER ({OVER} ROWS UNBOUNDED PRECEDING)",
        m0=roll("sum", "volume", 60, 30), m1=roll("sum", "third * volume", 60, 30), m2=roll("sum", "third * third * volume", 60, 30), v10u=roll("sum", "upv", 10), v10d=roll("sum", "downv", 10),
    )
    c.add(
        vol_ratio_20="volume / nullif(vma20_prev, 0)", volume_contraction_5_20=f"({roll('avg', 'volume', 5)}) / nullif({roll('avg', 'volume', 20, k=5)}, 0)", turnover_ratio_20="turnover / nullif(turnover_ma20_prev, 0)",
        up_down_volume_ratio_10="CASE WHEN v10d > 0 THEN v10u / v10d WHEN v10u > 0 THEN CAST('inf' AS DOUBLE) END", obv_slope_10_pct=f"(obv - {ago('obv', 10)}) / nullif({roll('sum', 'volume', 20)}, 0) * 100",
        pullback_volume_ratio_5=f"({roll('avg', 'fall', 5, 1)}) / nullif(vma20_prev, 0)", cost_center_60="m1 / m0 / 3",
    ).add(cost_concentration_60_pct="sqrt(greatest(m2 / m0 / 9 - cost_center_60 * cost_center_60, 0)) / cost_center_60 * 100", distance_to_cost_center_pct=pct("close", "cost_center_60"))
    c.add(
        **{f"prior_high_{n}": roll("max", "high", n, k=1) for n in (5, 20, 60)}, prior_low_20=roll("min", "low", 20, k=1), tr="greatest(high - low, abs(high - last), abs(low - last))", std20=roll("stddev_pop", "close", 20),
        **{f"range_width_{n}_pct": pct(roll("max", "high", n), roll("min", "low", n)) for n in (10, 20, 60, 120)},
        **{f"{name}": f"(close - ({roll('min', 'low', n, m)})) / nullif(({roll('max', 'high', n, m)}) - ({roll('min', 'low', n, m)}), 0)" for name, n, m in (("position_120", 120, 80), ("position_250", 250, 120), ("range_position_10", 10, 10))},
        upper_wick_ratio="(high - greatest(open, close)) / nullif(high - low, 0)", lower_wick_ratio="(least(open, close) - low) / nullif(high - low, 0)", amplitude_ma20_prev=roll("avg", "amplitude", 20, 10, 1),
        one_price_limit=flag("abs(high - low) <= 0.001 AND pct_chg >= 9.5"),
    )
    c.add(atr14=roll("avg", "tr", 14), bb_width_pct="std20 * 4 / ma20 * 100", range_convergence_ratio_20_60="range_width_20_pct / nullif(range_width_60_pct, 0)").add(atr_pct="atr14 / close * 100")
    near, wick = "high >= prior_high_20 * 0.985", "lower_wick_ratio >= 0.30"
    c.add(
        dist_to_prior_high20_pct=pct("close", "prior_high_20"), dist_to_prior_high60_pct=pct("close", "prior_high_60"), breakout_20=flag(f"close > prior_high_20 AND last <= {ago('prior_high_20')}"),
        close_above_prior_high5=flag("close > prior_high_5"), atr_contraction_ratio=f"atr_pct / ({roll('avg', 'atr_pct', 20, k=1)})", bb_contraction_ratio=f"bb_width_pct / nullif({roll('avg', 'bb_width_pct', 20, k=1)}, 0)",
        upper_probe=flag(f"upper_wick_ratio >= 0.40 AND {near} AND vol_ratio_20 >= 0.80"), false_break_recovery=flag(f"low < prior_low_20 * 0.995 AND close > prior_low_20 AND {wick}"),
        support_acceptance=flag(f"low <= prior_low_20 * 1.03 AND {wick} AND close >= open AND vol_ratio_20 >= 0.75"), resistance_test=flag(f"{near} AND high <= prior_high_20 * 1.03"),
        low_position_turnover_peak=flag("position_120 <= 0.60 AND turnover_ratio_20 >= 1.5 AND close >= open"),
        distribution_day=flag("turnover_ratio_20 >= 1.8 AND amplitude >= amplitude_ma20_prev * 1.4 AND pct_chg <= 1.0 AND upper_wick_ratio >= 0.25"), no=f"row_number() OVER ({OVER})",
    )
    c.add(
        contraction_then_expansion=flag(f"{ago('atr_contraction_ratio')} <= 0.90 AND atr_pct >= {ago('atr_pct')} * 1.10"),
        **{f"{x}_count_60": roll("sum", x, 60, 20) for x in ("upper_probe", "false_break_recovery", "support_acceptance", "resistance_test", "low_position_turnover_peak")},
        distribution_day_count_5=roll("sum", "distribution_day", 5, 1), event=f"max(CASE WHEN breakout_20 = 1 THEN no END) OVER ({OVER} ROWS UNBOUNDED PRECEDING)",
    ).add(bars_since_breakout="CASE WHEN no - event <= 10 THEN no - event END")
    first = {k: "CASE " + " ".join(f"WHEN bars_since_breakout = {i} THEN {x if i == 0 else ago(x, i)}" for i in range(11)) + " END" for k, x in (("recent_breakout_level", "prior_high_20"), ("breakout_event_low", "low"), ("breakout_event_close", "close"))}
    c.add(**first)
    soon = "bars_since_breakout BETWEEN 1 AND 3"
    c.add(
        retest_distance_pct=pct("close", "recent_breakout_level"), retest_touch=flag("low <= recent_breakout_level * 1.02 AND close >= recent_breakout_level * 0.985"),
        breakout_failed_fast=flag(f"{soon} AND (close < recent_breakout_level * 0.98 OR close < breakout_event_low)"),
        breakout_stall_distribution=flag(f"{soon} AND turnover_ratio_20 >= 1.5 AND amplitude >= amplitude_ma20_prev * 1.3 AND close <= breakout_event_close * 1.01"),
        base_high_20_pre3=roll("max", "high", 20, k=3), base_low_20_pre3=roll("min", "low", 20, k=3), top3=roll("max", "high", 120, 80, 3), floor3=roll("min", "low", 120, 80, 3),
    )
    c.add(
        base_mid_20_pre3="(base_high_20_pre3 + base_low_20_pre3) / 2", base_width_20_pre3_pct=pct("base_high_20_pre3", "base_low_20_pre3"),
        base_close_cv_20_pre3_pct=f"({roll('stddev_pop', 'close', 20, k=3)}) / ({roll('avg', 'close', 20, k=3)}) * 100", base_return_20_pre3_pct=pct(ago("close", 3), ago("close", 22)),
        base_turnover_sum_20_pre3_pct=roll("sum", "turnover", 20, 15, 3), base_drawdown_from_120_high_pct=pct(ago("close", 3), "top3"), pre_base_decline_60_pct=pct(ago("close", 22), ago("close", 82)),
        distance_from_base_high_pct=pct("close", "base_high_20_pre3"),
    ).add(base_position_120_pre3="(base_mid_20_pre3 - floor3) / nullif(top3 - floor3, 0)", distance_from_base_mid_pct=pct("close", "base_mid_20_pre3"))
    c.add(b0=_base_struct(roll("max", "high", 20), roll("min", "low", 20), 20, 15, True))
    _best(c, "rebound_base", "rebound", [("b0", o, 20, 0.6, o * 0.15) for o in range(4, 21)])
    c.add(**{f"b{w}": _base_struct(roll("quantile_cont(close, 0.9)", "close", w), roll("quantile_cont(close, 0.1)", "close", w), w, max(15, w * 7 // 10), False) for w in (20, 30, 40, 60)})
    _best(c, "adaptive_base", "adaptive", [(f"b{w}", o, w, 0.55, o * 0.08 + (60 - w) * 0.035) for w in (20, 30, 40, 60) for o in (0, 3, 5, 8, 12, 16, 20, 25, 30)])
    c.add(adaptive_trend_votes=ladder(("close >= ma5", 1), ("close >= ma10", 1), ("ma5_slope_3_pct > 0", 1), ("macd_rising = 1", 1), ("return_5d_pct > 0", 1)))
    away = "distance_from_adaptive_base_high_pct"
    return c.add(
        early_launch_price_action=flag("return_5d_pct BETWEEN 3 AND 35 AND close > ma5 AND ma5_slope_3_pct > 0 AND distance_from_base_mid_pct >= 4 AND distance_from_base_high_pct BETWEEN -4 AND 35"),
        rebound_price_action=flag("distance_from_rebound_base_high_pct BETWEEN -2 AND 55 AND return_20d_pct BETWEEN 3 AND 60 AND close >= ma20 * 0.95"),
        adaptive_ready_price_action=flag(f"adaptive_base_offset <= 8 AND {away} BETWEEN -12 AND 22 AND return_20d_pct <= 35"),
        adaptive_launch_price_action=flag(f"adaptive_base_offset <= 10 AND {away} BETWEEN -6 AND 55 AND return_20d_pct BETWEEN -2 AND 60 AND adaptive_trend_votes >= 3"),
        adaptive_rebound_price_action=flag(f"adaptive_base_offset BETWEEN 8 AND 30 AND {away} BETWEEN -12 AND 85 AND return_20d_pct BETWEEN -5 AND 75 AND adaptive_trend_votes >= 2"),
    )


OUTCOMES = """ahead AS (SELECT code, date, open, high, low, close, lead(open, 1) OVER w AS entry, list(struct_pack(h := high, l := low)) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nxt
  FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
hits AS (SELECT *, list_position(list_transform(nxt, lambda x: (x.h / entry - 1) * 100 >= 12.0), true) AS hit FROM ahead),
outcomes AS (SELECT code, date, CASE WHEN len(nxt) = 10 THEN list_max(list_transform(nxt, lambda x: (x.h / entry - 1) * 100)) END AS forward_max_return_pct,
  CASE WHEN len(nxt) = 10 THEN list_min(list_transform(nxt[1:coalesce(nullif(hit, 0), 10)], lambda x: (x.l / entry - 1) * 100)) END AS drawdown_before_target_pct, hit, nxt FROM hits),
judged AS (SELECT code, date, forward_max_return_pct, drawdown_before_target_pct, CASE WHEN len(nxt) = 10 THEN CASE WHEN coalesce(hit, 0) > 0 AND drawdown_before_target_pct >= -6.0 THEN 1 ELSE 0 END END AS outcome_success FROM outcomes)"""

_SPREAD = """spread AS (SELECT *, unnest(generate_series(CAST(floor(a + 0.5) AS BIGINT), greatest(CAST(floor(a + 0.5) AS BIGINT), CAST(ceil(b + 0.5) AS BIGINT) - 1))) AS bin FROM kept),
edged AS (SELECT *, exp(ln(0.001) + (bin - 0.5) * step) AS e0, exp(ln(0.001) + (bin + 0.5) * step) AS e1 FROM spread),
parts AS (SELECT *, greatest(0.0,
  (CASE WHEN e1 >= high THEN 1.0 WHEN e1 <= low THEN 0.0 WHEN e1 <= md THEN pow(e1 - low, 2) / ((high - low) * (md - low)) ELSE 1 - pow(high - e1, 2) / ((high - low) * (high - md)) END) -
  (CASE WHEN e0 >= high THEN 1.0 WHEN e0 <= low THEN 0.0 WHEN e0 <= md THEN pow(e0 - low, 2) / ((high - low) * (md - low)) ELSE 1 - pow(high - e0, 2) / ((high - low) * (high - md)) END)) AS part FROM edged WHERE high - low > 1e-8),
flat AS (SELECT code, date, weight, CAST(floor(a) AS BIGINT) + CASE WHEN md - exp(ln(0.001) + floor(a) * step) <= exp(ln(0.001) + (floor(a) + 1) * step) - md THEN 0 ELSE 1 END AS bin, 1.0 AS part FROM kept WHERE high - low <= 1e-8),
all_parts AS (SELECT code, date, weight, bin, part FROM parts UNION ALL SELECT * FROM flat),
day_parts AS (SELECT *, part / sum(part) OVER (PARTITION BY code, date) AS share FROM all_parts)"""
_KEPT = "kept AS (SELECT *, (open + high + low + close) / 4 AS md, (ln(low) - ln(0.001)) / g.step AS a, (ln(high) - ln(0.001)) / g.step AS b, g.step FROM decayed, (SELECT ln(100000 / 0.001) / 2047 AS step) g"

MASS = f"""weighted AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS nth, least(1.0, greatest(0.0, turnover / 100)) AS rate FROM bars),
decayed AS (SELECT *, rate * exp(coalesce(sum(ln(1 - rate)) OVER (PARTITION BY code ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS weight FROM weighted),
{_KEPT} WHERE nth <= 250 AND weight > 0),
{_SPREAD},
mass AS (SELECT code, bin, sum(weight * share) AS mass FROM day_parts GROUP BY 1, 2)"""

#: What profile() reads: the mass and the price span as of the last bar, or as of every bar.
LAST = """held AS (SELECT m.code, l.date, m.bin, m.mass FROM mass m JOIN (SELECT code, max(date) AS date FROM bars GROUP BY 1) l USING (code)),
span AS (SELECT code, max(date) AS date, min(low) AS seen_low, max(high) AS seen_high, arg_max(close, date) AS close FROM weighted WHERE nth <= 250 GROUP BY 1)"""
EVERY = f"""decayed AS (SELECT *, row_number() OVER ({OVER}) AS nth, least(1.0, greatest(0.0, turnover / 100)) AS weight, sum(ln(1 - least(1.0, greatest(0.0, turnover / 100)))) OVER ({OVER}) AS run FROM bars),
{_KEPT}),
{_SPREAD},
put AS (SELECT code, bin, d.nth, s.weight * exp(-d.run) * share AS x FROM day_parts s JOIN decayed d USING (code, date)),
grid AS (SELECT n.code, n.date, n.nth, n.run, b.bin FROM decayed n JOIN (SELECT DISTINCT code, bin FROM day_parts) b USING (code)),
summing AS (SELECT code, date, bin, exp(run) * sum(x) OVER (PARTITION BY code, bin ORDER BY nth ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS mass FROM grid LEFT JOIN put USING (code, bin, nth)),
held AS (SELECT * FROM summing WHERE mass > 0),
span AS (SELECT code, date, min(low) OVER w AS seen_low, max(high) OVER w AS seen_high, close FROM bars WINDOW w AS ({OVER} ROWS BETWEEN 249 PRECEDING AND CURRENT ROW))"""


def _profile() -> str:
    price, w = "exp(ln(0.001) + {} * (ln(100000 / 0.001) / 2047))".format, "PARTITION BY code, date ORDER BY bin"
    share, at = "sum(CASE WHEN {} THEN p ELSE 0 END) * 100".format, "min(CASE WHEN cum >= {} THEN price END)".format
    return f"""whole AS (SELECT code, date, sum(mass) AS total FROM held GROUP BY 1, 2 HAVING sum(mass) > 1e-8),
part_of AS (SELECT code, date, bin, mass / total AS p, total, {price("bin")} AS price, sum(mass / total) OVER ({w} ROWS UNBOUNDED PRECEDING) AS cum FROM held JOIN whole USING (code, date)),
smooth AS (SELECT code, date, bin + k.d AS bin, sum(p * k.w) / 9 AS s FROM part_of, (VALUES (-2, 1), (-1, 2), (0, 3), (1, 2), (2, 1)) k(d, w) WHERE bin + k.d BETWEEN 0 AND 2047 GROUP BY 1, 2, 3),
sided AS (SELECT *, CASE WHEN lag(bin) OVER w = bin - 1 THEN lag(s) OVER w ELSE 0 END AS s0, CASE WHEN lead(bin) OVER w = bin + 1 THEN lead(s) OVER w ELSE 0 END AS s1, max(s) OVER (PARTITION BY code, date) AS top FROM smooth WINDOW w AS ({w})),
topped AS (SELECT code, date, list(struct_pack(s := s, bin := bin) ORDER BY s DESC, bin DESC) AS tops FROM sided WHERE s >= s0 AND s >= s1 AND s >= top * 0.20 GROUP BY 1, 2),
peaks AS (SELECT code, date, {price("tops[1].bin")} AS peak, tops[1].s AS s1, list_filter(tops, lambda t: abs(t.bin - tops[1].bin) >= 4)[1] AS second,
  len(list_reduce(list_transform(tops, lambda t: [t.bin]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: abs(o - x[1]) < 4)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS n FROM topped),
summed AS (SELECT code, date, any_value(total) * 100 AS chip_model_coverage_pct, any_value(peak) AS chip_peak_price, any_value(second) AS second, any_value(s1) AS s1, any_value(n) AS n,
  {share("price >= peak * 0.96 AND price <= peak * 1.04")} AS chip_peak_band_share_pct, {at(0.15)} AS chip_70_low, {at(0.85)} AS chip_70_high, {at(0.05)} AS chip_90_low, {at(0.95)} AS chip_90_high,
  {share("price <= close")} AS chip_profit_ratio_pct, {share("price > close")} AS chip_overhead_ratio_pct, {share("price <= seen_low + (seen_high - seen_low) * 0.35")} AS chip_low_zone_share_pct,
  any_value(seen_low) AS lo, any_value(seen_high) AS hi, any_value(close) AS close FROM part_of JOIN peaks USING (code, date) JOIN span USING (code, date) GROUP BY 1, 2),
profile AS (SELECT *, {price("second.bin")} AS chip_secondary_peak_price, coalesce(s1 / second.s, CAST('inf' AS DOUBLE)) AS chip_peak_dominance, CAST(n AS INTEGER) AS chip_significant_peak_count,
  {pct("chip_70_high", "chip_70_low")} AS chip_70_width_pct, {pct("chip_90_high", "chip_90_low")} AS chip_90_width_pct, CASE WHEN hi > lo THEN (chip_peak_price - lo) / (hi - lo) ELSE 0.5 END AS chip_peak_position,
  {pct("close", "chip_peak_price")} AS chip_peak_distance_pct FROM summed)"""


PROFILE = _profile()


BENCH = """bench AS (SELECT date, CAST(floor(2000 * exp(CAST(sum(floor(r / CAST(n AS DOUBLE))) OVER (ORDER BY date) AS DOUBLE) / 200)) AS DOUBLE) AS close FROM (SELECT date, sum(r) AS r, count(*) AS n FROM dated GROUP BY 1)),
  index AS (SELECT *, (close / lag(close, 20) OVER (ORDER BY date) - 1) * 100 AS b20, (close / lag(close, 60) OVER (ORDER BY date) - 1) * 100 AS b60, avg(close) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20 FROM bench)"""


def snapshot(chain: Chain, every: bool = False, where: str = "", risky: bool = False) -> str:
    """The chain, the last rows (or every row) with their profile as snapshot, and these with scores as scored."""
    base = ladder(("width <= 16", 12), ("width > 16 AND width <= 28", 8), ("width > 28 AND width <= 42", 4), ("ret <= 6", 8), ("ret > 6 AND ret <= 14", 5), ("ret > 14 AND ret <= 22", 2), ("win >= 40", 4), ("win BETWEEN 20 AND 39", 2), ("adaptive_base_turnover_sum_pct >= 15", 3))
    shape = ladder(
        ("share >= 25", 12), ("share >= 18 AND share < 25", 9), ("share >= 12 AND share < 18", 6), ("share >= 10 AND share < 12", 4), ("spread70 <= 18", 10), ("spread70 > 18 AND spread70 <= 30", 7), ("spread70 > 30 AND spread70 <= 45", 4),
        ("chip_peak_dominance >= 1.5", 5), ("chip_peak_dominance >= 1.15 AND chip_peak_dominance < 1.5", 3), ("chip_significant_peak_count <= 2", 4), ("chip_significant_peak_count BETWEEN 3 AND 4", 2),
        ("chip_low_zone_share_pct >= 35", 4), ("chip_low_zone_share_pct >= 20 AND chip_low_zone_share_pct < 35", 2),
    )
    context = ladder(("dropped <= -20", 6), ("dropped >= -20 AND dropped < -8", 4), ("place <= 0.40", 5), ("place > 0.40 AND place <= 0.75", 3), ("place > 0.75 AND place <= 0.88", 1), ("decline <= -12", 4), ("decline >= -12 AND decline < -5", 2))
    launch = f"coalesce(adaptive_trend_votes, 0) * 2 + {ladder(('vol_ratio_20 >= 1.05', 2), ('up_down_volume_ratio_10 >= 1.15', 2), ('macd_rising = 1', 1))}"
    risk = ladder(("distribution_day_count_5 <= 2", 2), ("breakout_failed_fast = 0", 1), ("breakout_stall_distribution = 0", 1), ("risk_ok = 1", 1))
    named = "*, adaptive_base_width_pct AS width, abs(adaptive_base_return_pct) AS ret, adaptive_base_window AS win, chip_peak_band_share_pct AS share, chip_70_width_pct AS spread70, adaptive_base_drawdown_120_pct AS dropped, adaptive_base_position_120 AS place, adaptive_pre_base_decline_60_pct AS decline"
    last = "QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1"
    risk_ok = "CASE WHEN i.date IS NULL OR (i.close >= i.m20 * 0.97 AND i.b20 > -8) THEN 1 ELSE 0 END" if risky else "1"
    chip = "p.* EXCLUDE (code, date, close, s1, second, n, lo, hi)"
    done = lambda k: f"least(100, structure + chip_score_launch + {flag(f'adaptive_{k}_price_action = 1')} * 5) AS chip_base_{k}_score"
    return "WITH " + ",\n".join(
        [
            *chain.parts, *((EVERY,) if every else (MASS, LAST)), PROFILE, BENCH,
            f"snapshot AS (SELECT f.*, {chip}, f.no AS bars_seen, i.b20 AS index20, i.b60 AS index60, {risk_ok} AS risk_ok FROM (SELECT * FROM {chain.name} {'' if every else last}) f LEFT JOIN profile p ON p.code = f.code AND p.date = f.date LEFT JOIN index i ON i.date = f.date {where})",
            f"partly AS (SELECT *, least(35, {base}) AS chip_score_base, least(35, {shape}) AS chip_score_profile, least(15, {context}) AS chip_score_context, least(15, {launch}) AS chip_score_launch, least(5, {risk}) AS chip_score_risk FROM (SELECT {named} FROM snapshot))",
            "structured AS (SELECT *, chip_score_base + chip_score_profile + chip_score_context + chip_score_risk AS structure FROM partly)",
            f"modelled AS (SELECT *, least(90, structure) AS chip_structure_score, least(100, structure + {flag('adaptive_ready_price_action = 1')} * 10) AS chip_base_ready_score, {done('launch')}, {done('rebound')} FROM structured)",
            "scored AS (SELECT *, greatest(chip_base_ready_score, chip_base_launch_score, chip_base_rebound_score) AS score_total FROM modelled)",
        ]
    )


def gate_steps(p) -> dict[str, list[tuple[str, str]]]:
    """Each signal's steps as conditions that are never null."""
    sure = lambda c: f"coalesce({c}, false)"
    any_of, all_of = (lambda *c: "(" + " OR ".join(map(sure, c)) + ")"), (lambda *c: "(" + " AND ".join(map(sure, c)) + ")")
    away, pk = "distance_from_adaptive_base_high_pct", "chip_peak_distance_pct"
    calm = lambda least: all_of(f"distribution_day_count_5 <= {p.max_distribution_days_5 + 1}", f"NOT {all_of('breakout_failed_fast = 1', f'{away} < {least}')}")
    low = lambda most, a, b, c: all_of(f"position_250 <= {most}", any_of(f"place <= {a}", f"dropped <= {b}", f"decline <= {c}"))
    peaked = lambda wide, most, least: all_of(wide, f"chip_peak_position <= {most}", f"share >= {least}")
    common = [
        ("history_bars", sure(f"bars_seen >= {p.min_history_bars}")), ("liquidity", sure(f"amount_ma20_prev >= {p.min_amount_ma20}")),
        ("chip_features_ready", all_of("one_price_limit = 0", "base_high_20_pre3 IS NOT NULL", "chip_peak_price IS NOT NULL", "chip_model_coverage_pct >= 70")),
    ]
    early = any_of("adaptive_launch_price_action = 1", all_of("adaptive_base_offset <= 8", "return_5d_pct >= 3", "adaptive_trend_votes >= 2"))
    narrow = any_of(f"spread70 <= {p.max_70_width_pct}", all_of(f"share >= {p.strong_peak_band_share_pct}", f"spread70 <= {p.strong_peak_max_70_width_pct}"))
    bottom = [
        ("bottom_location", low(p.max_position_250, 0.88, -8, -5)), ("sideways_platform", all_of("adaptive_base_high IS NOT NULL", f"width <= {p.max_base_width_pct}", f"ret <= {p.max_base_abs_return_pct}")),
        ("concentrated_low_chip_peak", peaked(narrow, p.max_peak_position, p.min_peak_band_share_pct)), ("risk_control", calm(-8)),
    ]
    moved = any_of("adaptive_rebound_price_action = 1", all_of("adaptive_base_offset >= 8", f"return_5d_pct >= {p.rebound_min_return_5d_pct}", "adaptive_trend_votes >= 2"))
    return {
        "chip_base_ready": [*common, *bottom, ("waiting_near_peak", all_of("adaptive_base_offset <= 8", f"NOT {early}", f"{pk} BETWEEN -12 AND {p.ready_max_peak_distance_pct}")), ("chip_base_ready_score", f"chip_base_ready_score >= {p.ready_score}")],
        "chip_base_launch": [*common, *bottom, ("early_launch", all_of(early, f"{pk} BETWEEN -8 AND {p.launch_max_peak_distance_pct}", f"return_10d_pct <= {p.launch_max_return_10d_pct}")), ("chip_base_launch_score", f"chip_base_launch_score >= {p.launch_score}")],
        "chip_base_rebound": [
            *common, ("rebound_location", low(p.rebound_max_position_250, 0.92, -5, -3)),
            ("recent_historical_platform", all_of("adaptive_base_high IS NOT NULL", "adaptive_base_offset >= 8", f"width <= {p.rebound_max_base_width_pct}", "ret <= 25")),
            ("rebound_chip_peak", peaked(f"spread70 <= {p.rebound_max_70_width_pct}", p.rebound_max_peak_position, p.rebound_min_peak_band_share_pct)), ("rebound_risk_control", calm(-10)),
            ("post_platform_rebound", all_of(moved, f"{pk} BETWEEN -10 AND {p.rebound_max_peak_distance_pct}", f"return_20d_pct <= {p.rebound_max_return_20d_pct}")), ("chip_base_rebound_score", f"chip_base_rebound_score >= {p.rebound_score}"),
        ],
    }


def stepped(whole: str, steps: dict[str, list[tuple[str, str]]]) -> str:
    """whole, each row's list of passed steps for each signal, and the rows that each signal chooses."""
    listed = ", ".join(f"[{', '.join(c for _, c in some)}] AS ok_{signal}" for signal, some in steps.items())
    chosen = " UNION ALL ".join(f"SELECT code, '{s}' AS signal, CAST({s}_score AS INTEGER) AS model_score, share, amount_ma20_prev FROM stepped WHERE list_bool_and(ok_{s})" for s in steps)
    return f"{whole}, stepped AS (SELECT *, {listed} FROM scored), chosen AS ({chosen})"


def funnel(steps: dict[str, list[tuple[str, str]]]) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{s}' AS signal, {i + 1} AS step_number, '{name}' AS step, count(*) FILTER (list_bool_and(ok_{s}[1:{i + 1}])) AS remaining_count, count(*) AS n FROM stepped" for s, some in steps.items() for i, (name, _) in enumerate(some)
    )
    share = lambda of: f"CASE WHEN {of} > 0 THEN round(remaining_count / {of} * 100, 2) ELSE 0.0 END"
    return f", counts AS ({counts}), b AS (SELECT *, coalesce(lag(remaining_count) OVER (PARTITION BY signal ORDER BY step_number), n) AS before FROM counts) SELECT signal, step_number, step, remaining_count, {share('before')} AS retention_from_previous_pct, {share('n')} AS retention_from_all_pct FROM b"


SCORES = "chip_score_base chip_score_profile chip_score_context chip_score_launch chip_score_risk chip_structure_score chip_base_ready_score chip_base_launch_score chip_base_rebound_score score_total".split()


def near(x: str, digits: int = 6) -> str:
    return f"floor((CASE WHEN abs({x}) < CAST('inf' AS DOUBLE) THEN {x} END) * 1e{digits} + 0.5) / 1e{digits}"


def signal_queries(chain: Chain, p) -> dict[str, str]:
    """SQL of scores, select_signals, funnel_counts, near_misses and column_fallbacks."""
    whole, steps = snapshot(chain), gate_steps(p)
    base = stepped(whole, steps)
    far = ", ".join(f"struct_pack(ratio := coalesce(nullif(list_position(ok_{s}, false), 0) - 1, {len(some)}) / {len(some)}, ord := {-i}, signal := '{s}', failed := coalesce([{', '.join(repr(n) for n, _ in some)}][nullif(list_position(ok_{s}, false), 0)], ''), passed := coalesce(nullif(list_position(ok_{s}, false), 0) - 1, {len(some)}), total := {len(some)})" for i, (s, some) in enumerate(steps.items()))
    none = " AND ".join(f"NOT list_bool_and(ok_{s})" for s in steps)
    fixed = Chain("", "fixed")
    replaced = {
        "adaptive_base_high": "base_high_20_pre3", "adaptive_base_width_pct": "base_width_20_pre3_pct", "adaptive_base_return_pct": "base_return_20_pre3_pct", "adaptive_base_turnover_sum_pct": "base_turnover_sum_20_pre3_pct",
        "adaptive_base_drawdown_120_pct": "base_drawdown_from_120_high_pct", "adaptive_base_position_120": "base_position_120_pre3", "adaptive_pre_base_decline_60_pct": "pre_base_decline_60_pct",
        "adaptive_launch_price_action": "early_launch_price_action", "adaptive_rebound_price_action": "rebound_price_action", "adaptive_ready_price_action": "1 - early_launch_price_action",
        "adaptive_trend_votes": "3 * early_launch_price_action", "adaptive_base_window": "20", "adaptive_base_offset": "3", "distance_from_adaptive_base_high_pct": pct("close", "base_high_20_pre3"),
    }
    fixed.parts = [*chain.parts, f"fixed AS (SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in replaced.items())}) FROM {chain.name})"]
    few = ("chip_score_base", "chip_score_context", "chip_score_launch", "adaptive_base_offset", "adaptive_base_window", "adaptive_trend_votes", "adaptive_ready_price_action", "score_total")
    return {
        "scores": f"{whole} SELECT code, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in SCORES)} FROM scored",
        "select_signals": f"{base} SELECT code, signal, model_score, CAST(row_number() OVER (PARTITION BY signal ORDER BY model_score DESC, share DESC NULLS LAST, amount_ma20_prev DESC NULLS LAST, code) AS INTEGER) AS rank FROM chosen",
        "funnel_counts": base + funnel(steps),
        "near_misses": f"""{base}, far AS (SELECT *, list_max([{far}]) AS best FROM stepped WHERE {none}), r AS (SELECT *, row_number() OVER (ORDER BY best.ratio DESC, score_total DESC NULLS LAST, share DESC NULLS LAST, code) AS nth FROM far)
          SELECT code, best.signal AS closest_signal, best.failed AS failed_at, CAST(best.passed AS INTEGER) AS passed_steps, CAST(best.total AS INTEGER) AS total_steps, {near('best.ratio')} AS completion_ratio, CAST(nth AS INTEGER) AS near_miss_rank FROM r WHERE nth <= {p.top_n}""",
        "column_fallbacks": f"{snapshot(fixed)} SELECT code, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in few)}, {near('distance_from_adaptive_base_high_pct')} AS distance_from_adaptive_base_high_pct FROM scored",
    }


def _share_rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY date) END"


NAMES = "names AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CASE WHEN s_suppkey % 17 = 0 THEN '*ST ' || s_name ELSE s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def backtest_queries(chain: Chain, p, period: tuple[str, str], ks: tuple[int, ...]) -> dict[str, str]:
    steps = gate_steps(p)
    flags = ", ".join(f"list_bool_and(ok_{s}) AS {s}" for s in steps)
    names = ", ".join(f"CASE WHEN {s} THEN '{s}' END" for s in steps)
    panel = f"""{stepped(snapshot(chain, every=True, where=f"WHERE f.date BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"), steps)}, {OUTCOMES}, {NAMES},
      flagged AS (SELECT s.*, o.outcome_success, o.forward_max_return_pct, o.drawdown_before_target_pct, coalesce(n.name, '') AS name, return_20d_pct - coalesce(index20, 0) AS e20, return_60d_pct - coalesce(index60, 0) AS e60, {flags} FROM stepped s JOIN judged o USING (code, date) LEFT JOIN names n USING (code)),
      panel AS (SELECT *, {_share_rank('e20')} AS rs20_percentile, {_share_rank('e60')} AS rs60_percentile, {' OR '.join(steps)} AS any_signal, concat_ws(',', {names}) AS signal_names FROM flagged),
      eligible AS (SELECT * FROM panel WHERE bars_seen >= {p.min_history_bars} AND amount_ma20_prev >= {p.min_amount_ma20} AND one_price_limit = 0 AND outcome_success IS NOT NULL AND rs20_percentile IS NOT NULL)"""
    ranked = f"{panel}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score_total DESC NULLS LAST, code) AS INTEGER) AS daily_rank FROM eligible WHERE any_signal)"
    metrics = """n AS (SELECT count(*) AS eligible_rows, count(*) FILTER (outcome_success = 1) AS positive_rows, count(*) FILTER (any_signal) AS signal_rows, count(*) FILTER (any_signal AND outcome_success = 1) AS successful_signal_rows FROM eligible)"""
    by = " UNION ALL ".join(f"SELECT '{s}' AS signal, count(*) FILTER ({s}) AS n, count(*) FILTER ({s} AND outcome_success = 1) AS successful FROM eligible" for s in steps)
    return {
        "backtest_panel": f"{panel} SELECT code, date, CAST(bars_seen AS INTEGER) AS bars, name, any_signal, signal_names, CAST(score_total AS INTEGER) AS score_total, outcome_success, {', '.join(f'{near(c)} AS {c}' for c in ('rs20_percentile', 'rs60_percentile', 'chip_peak_price', 'forward_max_return_pct'))} FROM panel",
        "signal_flags": f"{panel} SELECT code, date, {', '.join(steps)}, any_signal, signal_names FROM panel",
        "eligible_rows": f"{panel} SELECT code, date, CAST(bars_seen AS INTEGER) AS bars, outcome_success FROM eligible",
        "precision_recall": f"{panel}, {metrics} SELECT *, round(successful_signal_rows / nullif(signal_rows, 0), 4) AS precision, round(successful_signal_rows / nullif(positive_rows, 0), 4) AS recall FROM n",
        "precision_by_signal": f"{panel}, b AS ({by}) SELECT *, round(successful / nullif(n, 0), 4) AS precision FROM b",
        "topk_recall": f"{ranked} SELECT CAST(k AS INTEGER) AS k, round((SELECT count(*) FROM ranked WHERE daily_rank <= k AND outcome_success = 1) / nullif((SELECT count(*) FROM eligible WHERE outcome_success = 1), 0), 4) AS recall FROM (SELECT unnest({list(ks)}) AS k)",
        "daily_summary": f"{panel} SELECT date, count(*) AS eligible, sum(outcome_success) AS opportunities, count(*) FILTER (any_signal) AS signals, count(*) FILTER (any_signal AND outcome_success = 1) AS successful_signals FROM eligible GROUP BY 1",
        "signals_with_outcomes": f"{ranked} SELECT date, code, name, signal_names, CAST(score_total AS INTEGER) AS score_total, daily_rank, close, outcome_success, {', '.join(f'{near(c)} AS {c}' for c in ('rs20_percentile', 'forward_max_return_pct', 'drawdown_before_target_pct'))} FROM ranked",
        "publish_backtest": f"{panel}, {metrics} SELECT signal_rows AS signals, (SELECT count(DISTINCT date) FROM eligible) AS days, eligible_rows, signal_rows FROM n",
    }


def scan_queries(chain: Chain, p, day: str, summary: str, keys: str) -> dict[str, str]:
    """SQL of a scan as of a day on which every fourth instrument has no bar."""
    steps = gate_steps(p)
    ok = f"WHERE f.date = {day} AND f.no >= {p.min_history_bars} AND CAST(f.code AS INTEGER) % 4 <> 0 AND CAST(f.code AS INTEGER) % 17 <> 0 AND CAST(f.code AS INTEGER) % 23 <> 0"
    base = f"{stepped(snapshot(chain, where=ok, risky=True), steps)}, {NAMES}, {summary}"
    return {
        "scan": f"""{base}, ranks AS (SELECT code, {_share_rank('x')} AS rs20_percentile FROM (SELECT code, date, return_20d_pct - coalesce(index20, 0) AS x FROM scored)),
          ev AS (SELECT code, max(date) AS evidence_date, arg_max(volume, date) AS flow FROM bars WHERE (day(date) + CAST(code AS INTEGER)) % 11 = 0 AND date <= {day} GROUP BY 1)
          SELECT c.code, n.name, c.signal, model_score, CAST(row_number() OVER (PARTITION BY signal ORDER BY {keys}, model_score DESC, c.code) AS INTEGER) AS rank, fund_flow_rank_reason, evidence_date, flow, {near('rs20_percentile')} AS rs20_percentile
          FROM chosen c JOIN names n USING (code) JOIN ranks USING (code) LEFT JOIN summary s USING (code) LEFT JOIN ev USING (code)""",
        "scan_funnel": base + funnel(steps),
        "scan_report": f"""{base}, u AS (SELECT count(*) AS universe FROM supplier WHERE s_suppkey % 17 <> 0 AND s_suppkey % 23 <> 0 AND NOT contains(upper(s_name), 'ST')), n AS (SELECT universe, (SELECT count(*) FROM scored) AS snapshots, (SELECT count(DISTINCT code) FROM chosen) AS provisional FROM u),
          r AS (SELECT *, round(snapshots / universe * 100, 2) AS coverage_pct FROM n), v AS (SELECT *, coverage_pct >= 50 AS valid, CASE WHEN coverage_pct >= 50 THEN provisional ELSE 0 END AS candidates FROM r)
          SELECT *, CASE WHEN snapshots > 0 THEN round(candidates / snapshots * 100, 3) ELSE 0 END AS candidate_rate_pct,
          CASE WHEN NOT valid THEN 'coverage too low' WHEN snapshots = 0 OR candidates / snapshots < 0.002 THEN 'very few' WHEN candidates / snapshots < 0.01 THEN 'selective' ELSE 'many' END AS assessment FROM v""",
    }


def watchlist_queries(sessions: str, ttl: int, day: str) -> dict[str, str]:
    """SQL of the watchlist as a recursion over sessions."""
    five = f"OVER ({OVER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    sel = f"""{sessions}, sel AS (SELECT code, date, volume AS score, close, max(close) {five} AS top, min(low) {five} AS floor_, CASE WHEN volume > 2 * avg(volume) {five} THEN 'TRIGGER' ELSE 'SETUP' END AS st FROM bars QUALIFY close > top)"""
    names = "CASE WHEN st = 'TRIGGER' THEN 'chip_base_launch,chip_base_ready' ELSE 'chip_base_ready' END"
    hit, old = "e.st IS NOT NULL", "r.state IN ('SETUP', 'TRIGGER', 'RETEST')"
    listed = f"""{sel.replace('WITH ', 'WITH RECURSIVE ', 1)},
      ev AS (SELECT f.code, s.session_no AS no, s.date, e.date AS ends, b.close, sel.st, sel.score, sel.top, sel.floor_ FROM (SELECT code, min(session_no) AS first FROM sel JOIN sessions USING (date) GROUP BY 1) f JOIN sessions s ON s.session_no >= f.first
        LEFT JOIN sessions e ON e.session_no = s.session_no + {ttl} LEFT JOIN bars b ON b.code = f.code AND b.date = s.date LEFT JOIN sel ON sel.code = f.code AND sel.date = s.date),
      rec AS (SELECT code, no, st AS state, {names} AS signals, date AS first_seen_date, date AS last_signal_date, date AS last_evaluated_date, 'ok' AS data_status, 0 AS age_sessions, score AS score_total, close, top AS resistance_price, floor_ AS support_price,
          ends AS expires_date, CASE WHEN st = 'TRIGGER' THEN date END AS trigger_date, CASE WHEN st = 'TRIGGER' THEN close END AS trigger_price, CAST(NULL AS VARCHAR) AS old_state FROM ev QUALIFY row_number() OVER (PARTITION BY code ORDER BY no) = 1
        UNION ALL SELECT e.code, e.no, CASE WHEN {hit} THEN e.st WHEN e.close < r.support_price * 0.98 THEN 'INVALID' WHEN e.close IS NOT NULL AND r.expires_date < e.date THEN 'EXPIRED' ELSE r.state END, CASE WHEN {hit} THEN {names.replace('st =', 'e.st =')} ELSE '' END,
          CASE WHEN {hit} AND NOT {old} THEN e.date ELSE r.first_seen_date END, CASE WHEN {hit} THEN e.date ELSE r.last_signal_date END, e.date, CASE WHEN {hit} OR e.close IS NOT NULL THEN 'ok' ELSE 'missing_today' END,
          CASE WHEN {hit} AND NOT {old} THEN 0 WHEN {hit} THEN r.age_sessions ELSE r.age_sessions + 1 END, CASE WHEN {hit} THEN e.score ELSE r.score_total END, coalesce(e.close, r.close), CASE WHEN {hit} THEN e.top ELSE r.resistance_price END,
          CASE WHEN {hit} THEN e.floor_ ELSE r.support_price END, CASE WHEN {hit} THEN e.ends ELSE r.expires_date END, CASE WHEN e.st = 'TRIGGER' THEN e.date ELSE r.trigger_date END, CASE WHEN e.st = 'TRIGGER' THEN e.close ELSE r.trigger_price END, r.state
        FROM rec r JOIN ev e ON e.code = r.code AND e.no = r.no + 1)"""
    today, moved = f"FROM rec WHERE last_evaluated_date = {day}", "FROM rec WHERE state IS DISTINCT FROM old_state"
    shown = "last_evaluated_date AS date, code, coalesce(old_state, 'NEW') AS from_state, state AS to_state, signals"
    return {
        "current_state": f"{sel} SELECT code, date, st AS new_state, {names} AS new_signals, score AS new_score_total, close AS new_close, top AS new_resistance_price, floor_ AS new_support_price FROM sel",
        "watchlist_replay": f"{listed} SELECT * EXCLUDE (no) FROM rec",
        "watchlist_update": f"{listed} SELECT * EXCLUDE (no) {today}",
        "watchlist_active": f"{listed} SELECT code, state, signals, age_sessions {today} AND state IN ('SETUP', 'TRIGGER', 'RETEST')",
        "watchlist_idempotent": f"{listed} SELECT code, state, age_sessions, first_seen_date, last_signal_date, 0 AS moved {today}",
        "state_full_join": f"{listed} SELECT code, CASE WHEN old_state IS NULL THEN 0 ELSE 1 END AS was_listed, CASE WHEN last_signal_date = {day} THEN 1 ELSE 0 END AS has_signal, data_status {today}",
        "watchlist_transitions": f"{listed} SELECT {shown}, close {moved}",
        "append_transitions": f"{listed} SELECT {shown}, CASE WHEN last_evaluated_date >= DATE '2001-12-25' THEN close + 1 ELSE close END AS close {moved}",
    }


def ewm_recursion() -> str:
    """dif and dea bar by bar, by what the means are defined as."""
    fast, slow = "e.fast + (x.close - e.fast) * 2 / 13", "e.slow + (x.close - e.slow) * 2 / 27"
    return f"""WITH RECURSIVE {BARS}, x AS (SELECT code, date, close, row_number() OVER ({OVER}) AS n FROM bars),
      e AS (SELECT code, date, n, close AS fast, close AS slow, CAST(0 AS DOUBLE) AS dea FROM x WHERE n = 1
        UNION ALL SELECT x.code, x.date, x.n, {fast}, {slow}, e.dea + (({fast}) - ({slow}) - e.dea) * 2 / 10 FROM e JOIN x ON x.code = e.code AND x.n = e.n + 1)
      SELECT code, date, {near('fast - slow')} AS dif, {near('dea')} AS dea FROM e"""
