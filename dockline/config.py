"""Thresholds shared by every operator.

The numbers are fixed values of the published method; callers override them by
building their own :class:`Settings` or by passing the operator's keyword.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QualitySettings:
    completeness_weight: float = 0.30
    uniqueness_weight: float = 0.20
    validity_weight: float = 0.25
    consistency_weight: float = 0.15
    accuracy_weight: float = 0.10
    outlier_method: str = "iqr"
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    grade_bands: tuple[tuple[str, float], ...] = (("A", 90.0), ("B", 80.0), ("C", 70.0), ("D", 60.0))
    missing_low_pct: float = 5.0
    missing_high_pct: float = 20.0
    missing_drop_pct: float = 50.0
    min_unique_for_outliers: int = 2
    accuracy_outlier_cap: float = 0.10
    heavy_tail_skew: float = 1.0
    material_violation_pct: float = 1.0
    material_outlier_pct: float = 5.0
    sample_rows: int = 5


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    # service scorecards
    min_shipments_for_scoring: int = 30
    on_time_target_pct: float = 90.0
    preferred_pct: float = 92.0
    approved_pct: float = 85.0
    min_shipments_for_freight: int = 20
    lateness_thresholds: tuple[int, ...] = (0, 7, 30, 90)
    # pricing
    min_shipments_for_spread: int = 20
    min_sites_for_spread: int = 3
    top_n_products: int = 15
    # comparison
    alpha: float = 0.05
    power: float = 0.80
    min_group_size: int = 30
    skew_limit: float = 2.0
    practical_lift_pct: float = 1.5
    late_shipment_penalty: float = 1850.0
    era_cutoff_year: int = 2010
    early_era: str = "2006-2010"
    late_era: str = "2011-2015"
    years_covered: int = 10
    # models
    test_size: float = 0.25
    cv_folds: int = 5
    age_edges: tuple[float, ...] = (30.0, 45.0, 60.0)
    age_labels: tuple[str, ...] = ("<30", "30-45", "45-60", "60+")
    ratio_low: float = 10.0
    ratio_high: float = 15.0
    high_risk: float = 0.35
    elevated_risk: float = 0.20
    gains_shares: tuple[float, ...] = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
    routing_thresholds: tuple[float, ...] = (0.0, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
    quality: QualitySettings = field(default_factory=QualitySettings)


DEFAULTS = Settings()
