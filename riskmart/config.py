"""Everything that business rules leave open, in one immutable record that each operator is given."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date


@dataclass(frozen=True)
class Config:
    as_of: date | None = None  # None: today, at read time
    lookback_hours: int = 6
    duplicate_seconds: int = 60
    maturity_days: int = 90
    clock_skew_seconds: int = 5
    eligible_methods: tuple[str, ...] = ("credit_card", "debit_card")
    vamp_ratio: float = 0.015
    vamp_min_cases: int = 1500
    vamp_enumeration_ratio: float = 0.20  # declared by the programme, used by no rule here
    ecm_ratio: float = 0.015
    ecm_min_chargebacks: int = 100
    efm_bps: float = 50
    early_warning_share: float = 0.75
    dispute_window_days: int = 120
    default_payout_days: int = 30
    baseline_days: int = 28
    z_limit: float = 3
    psi_moderate: float = 0.10
    psi_severe: float = 0.25
    psi_floor: float = 0.0001
    fail_open_rate: float = 0.01
    score_bands: tuple[int, ...] = (30, 60, 80)
    velocity_seconds: tuple[int, int] = (600, 86400)
    calendar: tuple[date, date] = (date(2025, 1, 1), date(2027, 12, 31))
    maturation_days: tuple[int, ...] = field(default=(15, 30, 45, 60, 90, 120))

    def but(self, **changes) -> Config:
        return replace(self, **changes)
