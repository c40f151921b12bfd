"""Thresholds of the gates and of the backtest."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_history_bars: int = 150
    min_amount_ma20: float = 3e7
    ready_score: float = 60.0
    launch_score: float = 65.0
    rebound_score: float = 62.0
    max_position_250: float = 0.92
    max_base_width_pct: float = 42.0
    max_base_abs_return_pct: float = 22.0
    max_70_width_pct: float = 45.0
    max_peak_position: float = 0.92
    min_peak_band_share_pct: float = 10.0
    strong_peak_band_share_pct: float = 25.0
    strong_peak_max_70_width_pct: float = 60.0
    ready_max_peak_distance_pct: float = 30.0
    launch_max_peak_distance_pct: float = 60.0
    launch_max_return_10d_pct: float = 55.0
    max_distribution_days_5: int = 3
    rebound_max_position_250: float = 0.98
    rebound_max_base_width_pct: float = 48.0
    rebound_max_70_width_pct: float = 50.0
    rebound_max_peak_position: float = 0.96
    rebound_min_peak_band_share_pct: float = 8.0
    rebound_max_peak_distance_pct: float = 90.0
    rebound_max_return_20d_pct: float = 75.0
    rebound_min_return_5d_pct: float = 3.0
    watchlist_ttl_sessions: int = 12
    horizon: int = 10
    target_pct: float = 12.0
    max_drawdown_pct: float = 6.0
    top_k: tuple[int, ...] = (20, 50, 100)
    top_n: int = 100
    flow_candidates: int = 120
    min_coverage_pct: float = 90.0
    min_universe: int = 2000
    refresh_days: int = 30

    def __post_init__(self) -> None:
        share = lambda *xs: all(0 < x <= 1 for x in xs)
        checks = {
            "min_history_bars": self.min_history_bars >= 120, "horizon": self.horizon > 0, "watchlist_ttl_sessions": self.watchlist_ttl_sessions > 0, "min_coverage_pct": 0 < self.min_coverage_pct <= 100,
            "top_k": all(k > 0 for k in self.top_k), "top_n": self.top_n > 0, "flow_candidates": self.flow_candidates > 0, "refresh_days": self.refresh_days >= 10, "min_universe": self.min_universe >= 0,
            "scores": all(0 <= x <= 100 for x in (self.ready_score, self.launch_score, self.rebound_score)),
            "positions": share(self.max_position_250, self.max_peak_position, self.rebound_max_position_250, self.rebound_max_peak_position),
            "strong peak": self.strong_peak_band_share_pct >= self.min_peak_band_share_pct and self.strong_peak_max_70_width_pct >= self.max_70_width_pct,
        }
        if wrong := [name for name, fine in checks.items() if not fine]:
            raise ValueError(f"out of range: {', '.join(wrong)}")
