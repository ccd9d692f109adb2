"""Analysis parameters, passed explicitly to the operators that need them."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from dataclasses import dataclass

# The six company features used for grouping, in report order.
CLUSTER_FEATURES = (
    "peak_offpeak_ratio",
    "weekday_weekend_ratio",
    "coefficient_of_variation",
    "load_factor",
    "summer_index",
    "winter_index",
)

# The metrics compared between peers.
PEER_METRICS = CLUSTER_FEATURES + ("monthly_trend_pct",)

# Where each field lives in a nested JSON configuration: (section, key).
_JSON_FIELDS = {
    "start_date": ("analysis", "start_date"),
    "end_date": ("analysis", "end_date"),
    "profile_start_date": ("analysis", "profile_start_date"),
    "profile_end_date": ("analysis", "profile_end_date"),
    "peak_hours": ("analysis", "peak_hours"),
    "seasonality_index": ("profile_metrics", "seasonality_index_threshold"),
    "seasonality_difference": ("profile_metrics", "seasonality_difference_threshold"),
    "similar_correlation": ("profile_metrics", "similar_profile_correlation"),
    "partly_different_correlation": ("profile_metrics", "partly_different_profile_correlation"),
    "hdd_base_c": ("external_factors", "hdd_base_c"),
    "cdd_base_c": ("external_factors", "cdd_base_c"),
    "weather_correlation": ("external_factors", "weather_correlation_threshold"),
    "minimum_weather_days": ("external_factors", "minimum_days_for_weather_analysis"),
    "cold_context_c": ("external_factors", "cold_context_threshold_c"),
    "hot_context_c": ("external_factors", "hot_context_threshold_c"),
    "unusable_missing_share": ("quality", "unusable_missing_share"),
    "zero_run_hours": ("quality", "zero_run_hours"),
    "extreme_multiple": ("quality", "extreme_multiple_of_mean"),
    "hourly_zscore": ("outliers", "hourly_zscore_threshold"),
    "peer_zscore": ("outliers", "sector_zscore_threshold"),
    "k_min": ("clustering", "k_min"),
    "k_max": ("clustering", "k_max"),
    "seed": ("clustering", "random_state"),
    "scaler": ("clustering", "scaler"),
    "n_init": ("clustering", "n_init"),
    "features": ("clustering", "features"),
    "prosumer_sheet_match": ("inputs", "prosumer_sheet_match"),
}


@dataclass(frozen=True)
class Settings:
    """Thresholds and periods. Defaults are the fixed values of the standard analysis."""

    start_date: str = "2025-06-01"
    end_date: str = "2026-06-30"
    profile_start_date: str = "2025-07-01"
    profile_end_date: str = "2026-06-30"
    peak_hours: tuple[int, int] = (7, 18)
    seasonality_index: float = 1.15
    seasonality_difference: float = 0.10
    similar_correlation: float = 0.80
    partly_different_correlation: float = 0.50
    hdd_base_c: float = 18.0
    cdd_base_c: float = 18.0
    weather_correlation: float = 0.30
    minimum_weather_days: int = 90
    cold_context_c: float = 5.0
    hot_context_c: float = 30.0
    unusable_missing_share: float = 0.10
    zero_run_hours: int = 48
    extreme_multiple: float = 50.0
    hourly_zscore: float = 3.0
    peer_zscore: float = 2.0
    k_min: int = 2
    k_max: int = 10
    seed: int = 42
    scaler: str = "minmax"
    n_init: int = 50
    features: tuple[str, ...] = CLUSTER_FEATURES
    prosumer_sheet_match: str = "prosumer"

    # Fixed values without a configuration key.
    reliable_coverage: float = 0.90
    holiday_cut: float = 0.20

    def __post_init__(self) -> None:
        for name in ("peak_hours", "features"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if dt.date.fromisoformat(self.start_date) > dt.date.fromisoformat(self.end_date):
            raise ValueError("start_date must not be after end_date")
        low, high = self.peak_hours
        if not 0 <= low <= high <= 23:
            raise ValueError("peak_hours must lie within 0..23")
        if not 0 <= self.unusable_missing_share <= 1:
            raise ValueError("unusable_missing_share must lie within 0..1")
        if self.zero_run_hours <= 0:
            raise ValueError("zero_run_hours must be positive")
        if self.k_min < 2 or self.k_max < self.k_min:
            raise ValueError("k_min/k_max is not a valid range")

    @property
    def period_days(self) -> int:
        return (dt.date.fromisoformat(self.end_date) - dt.date.fromisoformat(self.start_date)).days + 1

    @property
    def expected_hours(self) -> int:
        """Hours in the analysis period: every day has 24, there is no clock change."""
        return self.period_days * 24

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Read the nested JSON configuration; unknown keys are ignored, absent ones keep defaults."""
        document = json.loads(text)
        missing = sorted({section for section, _ in _JSON_FIELDS.values()} - set(document))
        if missing:
            raise ValueError(f"configuration sections missing: {missing}")
        found = {
            field: document[section][key]
            for field, (section, key) in _JSON_FIELDS.items()
            if key in document[section]
        }
        return cls(**found)

    def replace(self, **changes) -> Settings:
        return dataclasses.replace(self, **changes)
