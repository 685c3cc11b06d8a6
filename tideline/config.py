"""The knobs that change results, with their defaults; a YAML file may override any of them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import date


@dataclass(frozen=True)
class Config:
    # Defaults of the published set-up.
    asof_date: str | None = None
    flow_lag_days: int = 35
    figure_lag_days: int = 183
    grants_lag_days: int = 45
    disaggregation: str = "proportional"
    grants_exclude: tuple[str, ...] = ("visitor",)
    partial_quarter: str = "scale"
    share_years: int = 5
    categories: tuple[str, ...] = ("student", "skilled", "working_holiday", "family", "nz_citizen", "bridging", "other_temp", "permanent", "returning_au", "other")
    completion_quarters: int = 6
    ratio_floor: float = 0.0
    ratio_ceiling: float = 1.2
    smoother: str = "loess"
    loess_span: float = 0.5
    hp_lambda: float = 1600.0
    regime_breaks: tuple[str, ...] = ("2020-03-01", "2022-03-01")
    projection: str = "median_n"
    projection_window: int = 8
    seasonal_period: int = 4
    trend: str = "damped"
    damping: float = 0.85
    gamma_alpha: float = 2.0
    gamma_beta: float = 1.0
    gamma_lags: int = 4
    bridge_lags: int = 4
    backtest_start: str = "2010-01-01"
    horizons: tuple[int, ...] = (-2, -1, 0, 1)

    def day(self, today: date) -> date:
        """The day as of which figures are read: asof_date, or today where it is not given."""
        return date.fromisoformat(self.asof_date) if self.asof_date else today


def load(path: str | None = None, **changes) -> Config:
    """The defaults, what a YAML file changes, and then what the call does. An unknown name raises ValueError."""
    given = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
    given |= changes
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return replace(Config(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
