"""Thresholds of the engine, all in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """They are part of what the operators mean."""

    dop_max: float = 10.0
    moving_mps: float = 3.0
    moving_clock_mps: float = 4.0
    moving_gap_s: float = 1.0
    run_gap_s: float = 1.0
    dropout_s: float = 0.35
    degraded_fraction: float = 0.08
    clock_min_s: float = 0.02
    clock_max_s: float = 0.40
    spike_m: float = 50.0
    smooth: int = 13
    lap_samples_min: int = 20
    lap_time_min_s: float = 5.0
    lap_time_band: tuple[float, float] = (0.5, 1.6)
    lap_distance_band: tuple[float, float] = (0.9, 1.1)
    grid: int = 400
    g: float = 9.80665
    long_g_clip: float = 2.0
    brake_enter_min: float = 0.16
    brake_enter_max: float = 0.30
    brake_release: float = 0.35
    brake_quantile: float = 0.25
    brake_decel_min: float = 0.05
    brake_moving_mps: float = 4.0
    event_min_s: float = 0.25
    coast_g: float = 0.03
    envelope_quantile: float = 0.98
    envelope_floor: float = 0.3
    utilisation_max: float = 1.2
    merge_gap_m: float = 25.0
    merge_accel_g: float = 0.5
    merge_lead_m: float = 40.0
    brake_smooth_s: float = 0.10
    brake_gate_s: float = 0.30
    corner_lead_m: float = 30.0
    corner_cell_m: float = 0.75
    corner_window_m: float = 8.0
    corner_low: float = 0.8
    corner_merge_m: float = 10.0
    corner_min_m: float = 8.0
    corner_min_deg: float = 30.0
    otsu_bins: int = 128
    kappa_floor: float = 1e-4
    match_m: float = 750.0
    match_diagonal: float = 2.0
    detect_m: float = 1500.0
    earth_m: float = 6_371_000.0


CONFIG = Config()
