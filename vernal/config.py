"""Settings: thresholds, seasons and the hydrological year. Distances in metres, areas in square metres."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def load_env(path: str) -> dict[str, str]:
    """NAME=value lines of a file, as os.environ has them after: names that are set keep their values; comments, empty
    lines and lines without a sign are skipped, quotes around a value go."""
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            name, sign, value = line.partition("=")
            if sign and not line.startswith("#"):
                found[name.strip()] = os.environ.setdefault(name.strip(), value.strip().strip("\"'"))
    return found


# The windows of the seasons, thresholds, precipitation classes and defaults of a run.
@dataclass(frozen=True)
class Season:
    """Month-day windows, both ends as scenes are filtered (the end is exclusive)."""

    spring: tuple[str, str] = ("04-20", "06-20")
    late: tuple[str, str] = ("07-15", "09-20")


@dataclass(frozen=True)
class Thresholds:
    mndwi_water: float = 0.0
    ndwi_water_mss: float = 0.10
    ndmi_anomaly: float = 0.12
    wetveg_window_m: float = 500.0
    ndmi_wet: float = 0.30
    ndmi_peat: float = 0.35
    ndvi_veg_min: float = 0.30
    wetveg_min_persistence: float = 0.5
    water_proximity_m: float = 100.0
    max_slope_deg: float = 5.0
    max_cloud_pct: float = 60.0
    min_years_for_extent: int = 2
    min_wetland_area_m2: float = 500.0
    fill_hole_area_m2: float = 2000.0
    permanent_late_freq: float = 0.90
    semiperm_late_freq: float = 0.50
    seasonal_spring_freq: float = 0.50
    woody_frac_swamp: float = 0.40
    open_water_frac_sow: float = 0.50
    mss_last_year: int = 1983

    def radius_px(self, metres: float, pixel: float) -> int:
        """Half-even, at least one pixel."""
        return max(1, round(metres / pixel))

    def area_px(self, area: float, pixel: float) -> int:
        return max(1, round(area / (pixel * pixel)))


@dataclass(frozen=True)
class Precip:
    normal_start: int = 1991
    normal_end: int = 2020
    water_year_start_month: int = 10
    very_dry_pct: float = 10.0
    dry_pct: float = 20.0
    wet_pct: float = 80.0
    very_wet_pct: float = 90.0


@dataclass(frozen=True)
class Config:
    season: Season = field(default_factory=Season)
    thresholds: Thresholds = field(default_factory=Thresholds)
    precip: Precip = field(default_factory=Precip)
    study_buffer_m: float = 2000.0
    scale_m: float = 20.0
    start_year: int = 1972


#: Regions with peatland.
PEAT_REGIONS = ("boreal", "foothills", "canadian_shield", "rocky_mountain")
#: Land-cover codes by group.
COVER = {"tree": [10], "shrub": [20], "grass": [30], "crop": [40], "built": [50], "bare": [60], "water": [80], "herb_wet": [90], "moss": [100]}
