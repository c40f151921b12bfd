"""A daily scan and a backtest from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import W
from ..operators import backtest as bt
from ..operators import cost, features, flow, market, publish, signals
from .params import Params

C = F.col


def scan_steps(bars: DataFrame, universe: DataFrame, benchmark: DataFrame, flows: DataFrame, session: str, p: Params, evidence: DataFrame | None = None, evidence_columns: tuple[str, ...] = (), mainboard: bool = True) -> dict[str, publish.Step]:
    """A run's artefacts in order, each from those before it: status, scored, shape, flow_status, selected, funnel, near_misses and report."""
    listed = market.filter_universe(universe, mainboard)
    bars = bars.where(C("date") <= F.lit(session).cast("date"))

    def scored(done: dict[str, DataFrame]) -> DataFrame:
        ready = bars.join(done["status"].where(C("status") == "ok").select("code"), "code", "left_semi")
        last = features.latest_features(ready).join(cost.cost_profile(ready).drop("date"), "code", "left")
        last = signals.join_benchmark(last, market.benchmark_context(benchmark))
        last = market.names_lookup(market.join_universe_context(last, listed), listed)
        if evidence is not None:
            last = market.join_evidence_asof(last, evidence, session, evidence_columns)
        return signals.scores(signals.relative_strength(last))

    def selected(done: dict[str, DataFrame]) -> DataFrame:
        valid = market.coverage_gate(done["status"], p.min_coverage_pct).select("valid")
        return flow.flow_rank(done["shape"], flow.flow_summary(flows, session)).crossJoin(F.broadcast(valid)).where("valid").drop("valid")  # one row

    return {
        "status": market.fetch_status(listed, bars, session, p.min_history_bars), "scored": scored, "shape": lambda done: signals.select_signals(done["scored"], p),
        "flow_status": lambda done: publish.flow_status(flow.flow_candidates(done["shape"], signals.SIGNALS, p.flow_candidates), flow.flow_summary(flows, session)), "selected": selected,
        "funnel": lambda done: signals.funnel_counts(done["scored"], p), "near_misses": lambda done: signals.near_misses(done["scored"], p, p.top_n),
        "report": lambda done: publish.run_report(done["status"], done["scored"], done["shape"], p.min_coverage_pct),
    }


def scan(bars: DataFrame, universe: DataFrame, benchmark: DataFrame, flows: DataFrame, session: str, p: Params, evidence: DataFrame | None = None, evidence_columns: tuple[str, ...] = (), mainboard: bool = True) -> dict[str, DataFrame]:
    """A run's artefacts as of a session: status, scored, shape (signals before flow), flow_status, selected, funnel, near_misses and report.

    Instruments whose bars are fresh and many enough are scored on their last bar: features, cost profile, index, universe and
    evidence. Without enough coverage nothing is selected."""
    return publish.resolved(scan_steps(bars, universe, benchmark, flows, session, p, evidence, evidence_columns, mainboard))


def publish_scan(bars: DataFrame, universe: DataFrame, benchmark: DataFrame, flows: DataFrame, session: str, p: Params, path: str, evidence: DataFrame | None = None, evidence_columns: tuple[str, ...] = (), mainboard: bool = True) -> int:
    """scan, published: each artefact is written once and the later ones read it. The passes that write them count what the gates need: too small a
    universe or a benchmark that doesn't end on the session stops the run (GateFailed), and too little coverage leaves it without candidates."""
    benchmark, fresh = publish.fresh_gate(benchmark, session)
    steps = scan_steps(bars, universe, benchmark, flows, session, p, evidence, evidence_columns, mainboard)
    status, counts = publish.coverage_counts(steps["status"])
    few = publish.Gate("status", counts.observation, lambda seen: f"the universe is too small: {seen.get('universe', 0)} < {p.min_universe}" if seen.get("universe", 0) < p.min_universe else None)
    return publish.publish_run(steps | {"status": status}, lambda seen: "status" not in seen or publish.covered(seen, p.min_coverage_pct), path, session, (few, fresh))


def _outcomes(bars: DataFrame, p: Params) -> DataFrame:
    """Prepared bars with what followed each and their numbers, while rows are narrow."""
    return bt.forward_outcomes(features.prepared(bars), p.horizon, p.target_pct, p.max_drawdown_pct).withColumn("bars", F.row_number().over(W()))


def _within(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(C("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _with_index(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    return df.join(market.benchmark_context(benchmark).drop("benchmark_risk_ok"), "date", "left")


def backtest_panel(bars: DataFrame, benchmark: DataFrame, universe: DataFrame, start: str, end: str, p: Params) -> DataFrame:
    """Every bar from start to end with features, cost profile, outcome, name, relative strength, scores and signal flags. Outcomes and
    features see the whole history; ranks within a day see the period's rows."""
    df = features.all_features(_outcomes(bars, p)).join(cost.cost_distribution_panel(bars, start=start, end=end), ["code", "date"], "left")
    df = _with_index(market.names_lookup(_within(df, start, end), universe), benchmark)
    return signals.relative_strength(signals.signal_flags(signals.scores(df), p))  # ranks last: what is dealt by day is no wider than what is asked for


def eligibility_panel(bars: DataFrame, benchmark: DataFrame, start: str, end: str, p: Params) -> DataFrame:
    """Every row of backtest_panel with the columns that don't depend on bases, costs or signals: whether a bar is eligible is known from these."""
    return signals.relative_strength(_with_index(_within(features.tradable(_outcomes(bars, p)), start, end), benchmark))


def backtest(panel: DataFrame, p: Params) -> dict[str, DataFrame]:
    """overall, by_signal, top_k, daily and signals of a panel's eligible rows."""
    rows = bt.eligible_rows(panel, p)
    return {
        "overall": bt.precision_recall(rows, "any_signal"), "by_signal": bt.precision_by_signal(rows, signals.SIGNALS), "top_k": bt.topk_recall(rows, "any_signal", "score_total", p.top_k),
        "daily": bt.daily_summary(rows, "any_signal"), "signals": bt.signals_with_outcomes(rows),
    }


#: What a backtest's results read of the panel.
JUDGED = ("code", "date", "name", "bars", "amount_ma20_prev", "one_price_limit", "outcome_success", "rs20_percentile", "any_signal", "signal_names", "score_total", "close", "forward_max_return_pct", "drawdown_before_target_pct", *signals.SIGNALS)


def publish_backtest(panel: DataFrame, p: Params, path: str) -> dict[str, DataFrame]:
    """backtest, published: the panel is worked out once, its judged columns written below path/panel, and all five results read that table."""
    panel.select(*JUDGED).write.mode("overwrite").parquet(f"{path}/panel")
    out = backtest(panel.sparkSession.read.parquet(f"{path}/panel"), p)
    publish.publish_backtest(out["signals"], out["daily"], out["overall"], path)
    return out
