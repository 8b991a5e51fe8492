"""Settings of the accessibility analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Box:
    lon_min: float = -81.4
    lon_max: float = -68.6
    lat_min: float = -18.4
    lat_max: float = -0.04


@dataclass(frozen=True)
class Settings:
    """Fixed values that results depend on: thresholds, category sets, speeds."""

    box: Box = field(default_factory=Box)
    zero: float = 1e-6
    resolutive: tuple[str, ...] = ("II-1", "II-2", "II-E", "III-1", "III-2", "III-E")
    inconclusive: tuple[str, ...] = ("I-1", "I-2", "I-3", "I-4")
    matrix_categories: tuple[str, ...] = ("II-1", "II-2", "II-E", "III-1", "III-2", "III-E", "I-3", "I-4")
    upgradable: tuple[str, ...] = ("I-3", "I-4")
    active_states: tuple[str, ...] = ("ACTIVO",)
    bands: tuple[int, ...] = (30, 60, 120)
    golden_minutes: int = 60
    gaps: int = 20
    urban_people: int = 2000
    snap_m: float = 1500.0
    bike_kmh: float = 15.0
    foot_kmh: float = 4.5
    sample: int = 5000
    seed: int = 42
    main_profile: str = "car"


SETTINGS = Settings()
