"""All constants of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a cohort run; `parity` keeps the published tool's quirks where they change numbers."""

    max_duration_h: float = 24.0
    smoothing_window: int = 51
    smoothing_order: int = 3
    gap_fill_h: float = 0.5
    major_threshold: float = 0.8
    minor_threshold: float = 0.5
    baseline_range: int = 10
    revision_limit: float = 0.5
    revision_upper: float = 0.9
    min_active_h: float = 1.0
    max_inactive_pct: float = 30.0
    max_imputed_pct: float = 65.0
    crop_begin_adjust_h: float = -0.75
    crop_end_adjust_h: float = 0.0
    downsample_s: float = 59.0
    wear_temp_c: float = 27.0
    extreme_tac: float = 800.0
    cluster_tac: float = 600.0
    cluster_gap: float = 200.0
    curve_min_h: float = 0.5
    curve_separation_h: float = 0.1
    curve_min_peak: float = 5.0
    fall_ramp_step: float = 0.005
    fall_ramp_max: float = 5.0
    auc_dx: float = 0.1
    neighbours: int = 10
    min_rows: int = 20
    min_rows_after_crop: int = 10
    sampling_rate: float = 1.0
    split_time: str = "6:00"
    crop_by_temperature: bool = True
    parity: bool = False
