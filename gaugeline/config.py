"""All tunables of the engine, read once on the driver; operators get them as literals."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Schema:
    """Column names of a raw stream: aliases are renamed first, everything else is put in snake case."""

    time: str
    aliases: Mapping[str, str]


@dataclass(frozen=True)
class Settings:
    # The defaults of the reference's configuration.
    config_id: str = "default"
    filename_pattern: str = r"^(D\d+)_(T\d+)_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})_(ev3|vrmt)\.?\.csv$"
    telemetry: Schema = Schema("time", {"time_ms": "time", " EV3 state speed": "motor_speed", " EV3 state angle": "motor_angle", " Gyro(deg)": "gyro_heading"})
    tracking: Schema = Schema("timestamp", {"Time": "timestamp", "PoseX": "x", "PoseY": "y", "PoseZ": "z"})
    telemetry_time_to_s: float = 0.001
    tracking_time_to_s: float = 1.0
    wheel_radius_m: float = 0.028
    wheel_track_m: float = 0.120
    lever_arm: tuple[float, float, float] = (0.005, 0.0, 0.10)
    apply_lever_arm: bool = True
    #: direct, or fitted_plane: the same axes, with each row's distance to the trial's fitted plane.
    planar_mode: str = "direct"
    #: rigid: least squares over the calibration rows; heading: from the first heading_distance_m of both paths.
    spatial_method: str = "rigid"
    planar_x: str = "x"
    planar_y: str = "z"
    flip_y: bool = True
    heading_distance_m: float = 0.075
    min_rows: int = 50
    min_duration_s: float = 5.0
    max_gap_s: float = 2.0
    max_irregularity: float = 2.0
    extended_min_rows: int = 100
    calibration_s: float = 20.0
    min_evaluation_s: float = 5.0
    min_distance_m: float = 0.1
    min_turn_deg: float = 10.0
    lag_window_s: float = 5.0
    lag_step_s: float = 0.05
    min_overlap_s: float = 1.0
    min_correlation: float = 0.5
    min_peak_separation_s: float = 1.0
    min_peak_ratio: float = 1.2
    onset_threshold: float = 0.5
    telemetry_proxy: str = "motor_speed"
    tracking_proxy: str = "speed_magnitude"
    affine_gain: float = 0.05
    scale_min: float = 0.95
    scale_max: float = 1.05
    trimmed_percentile: float = 90.0
    huber_delta: float = 0.1
    outlier_m: float = 0.5
    rpe_interval_s: float = 1.0
    rpe_tolerance_s: float = 0.02
    tracking_gap_s: float = 0.5
    stationary_speed: float = 1.0
    turning_rate: float = 5.0
    paths: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("telemetry_time_to_s", "tracking_time_to_s"):
            unit_factor(getattr(self, name), name)
        for name, known in (("planar_mode", ("direct", "fitted_plane")), ("spatial_method", ("rigid", "heading"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, not {getattr(self, name)!r}")


def unit_factor(value: Any, name: str) -> float:
    """A unit factor that is present, finite and positive."""
    if value is None or isinstance(value, bool):
        raise ValueError(f"{name} is required")
    number = float(value)
    if not math.isfinite(number) or number <= 0:
        raise ValueError(f"{name} must be finite and positive, not {value!r}")
    return number


def load(path: str | Path | None = None, **overrides: Any) -> Settings:
    """Defaults, then a YAML file's entries, then the environment's, then explicit overrides; names are the fields of Settings.

    An environment variable is GAUGELINE_ and the field's name in capitals; its text is read like an entry of the file.
    """
    found: dict[str, Any] = {}
    known = {f.name for f in fields(Settings)}
    outside = {n: os.environ[f"GAUGELINE_{n.upper()}"] for n in sorted(known) if f"GAUGELINE_{n.upper()}" in os.environ}
    if path is not None:
        import yaml

        found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if outside:
        import yaml

        outside = {n: yaml.safe_load(text) for n, text in outside.items()}
    found = {**found, **outside, **overrides}
    if unknown := sorted(set(found) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    for stream in ("telemetry", "tracking"):
        if isinstance(found.get(stream), Mapping):
            found[stream] = Schema(**found[stream])
    if "lever_arm" in found:
        found["lever_arm"] = tuple(found["lever_arm"])
    return Settings(**found)


def check_frozen(settings: Settings) -> Settings:
    """Only paths and config_id may differ from the defaults in a frozen run."""
    default = Settings()
    changed = [f.name for f in fields(Settings) if f.name not in ("paths", "config_id") and getattr(settings, f.name) != getattr(default, f.name)]
    if changed:
        raise ValueError(f"frozen settings were changed: {', '.join(changed)}")
    return replace(settings)
