"""Thresholds, names and scopes used by the operators."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, radians

# Key of a measuring point in the raw feed.
SITE_KEY = ["lat", "lon", "street", "from_street", "to_street"]
LANE_KEY = ["site_id", "detector_id", "lane"]

# Optional extra key: when a frame carries it, every whole-period rule (dead
# lanes, free flow, day/night) is judged inside one period.
PERIOD = "period"
# The period of readings that a load's period expression gives none.
UNDATED = "undated"
# Column a fact table is laid out by, where that is not its period.
FOLDER = "folder"

# Weekday numbers with Sunday = 0.
DAY_SCOPES = {
    "weekday": (1, 2, 3, 4, 5),
    "weekend": (6, 0),
    "all": (0, 1, 2, 3, 4, 5, 6),
}


@dataclass(frozen=True)
class Params:
    # Cleaning and roll-up.
    max_plausible_speed: int = 120
    bucket_minutes: int = 30
    free_flow_percentile: float = 0.85
    min_samples: int = 3
    min_reference_speed: float = 10.0
    flatline_speed: float = 3.0
    stalled_day_hours: tuple[int, int] = (7, 22)
    stalled_night_hours: tuple[int, int] = (2, 6)
    stalled_day_speed: float = 3.0
    stalled_night_ratio: float = 3.0
    max_streets_per_point: int = 2

    # Kernel surface.
    surface_step_km: float = 0.2
    surface_bandwidth_km: float = 0.5
    surface_cutoff_km: float = 1.2

    # Roads and matching.
    chunk_m: float = 60.0
    adjacency_cell_km: float = 0.1
    snap_m: float = 120.0
    name_floor: float = 0.6
    similar_token_floor: float = 0.85
    similar_token_length: int = 5
    street_bandwidth_km: float = 0.4
    street_cutoff_km: float = 1.0
    street_stub_km: float = 0.25

    # Local flat projection.
    km_per_deg_lat: float = 111.0
    reference_lat: float = -34.9

    @property
    def km_per_deg_lon(self) -> float:
        return self.km_per_deg_lat * cos(radians(self.reference_lat))

    @property
    def buckets_per_day(self) -> int:
        return 24 * 60 // self.bucket_minutes

    def bucket_range(self, hours: tuple[int, int]) -> tuple[int, int]:
        """Half-open bucket range covering the given hours."""
        return tuple(h * 60 // self.bucket_minutes for h in hours)


DEFAULTS = Params()


def period_of(df) -> list[str]:
    return [PERIOD] if PERIOD in df.columns else []
