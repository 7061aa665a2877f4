"""Settings of a run, their defaults and checks."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from typing import Any

# Fixed values of the event format and its contracts.
VERSION = "0.1.0"
EVENTIZER_VERSION = "mobility-reference-v1.2"
PROFILE_ID = "xq.mob:profile-0.1"
WIRE_VERSION = "0.1"
MODALITY = "xq:mobility"
PRODUCER = "waymark"
ANALYSIS_CONTRACT = "waymark-analysis-v0.2"
TOOLS_CONTRACT = "waymark-tools-v0.2"


@dataclass(frozen=True)
class Config:
    source: str = ""
    subject_prefix: str = "device:"
    output_profile: str = "standard"
    parquet_compression: str = "zstd"
    parquet_row_group_rows: int = 131072
    parquet_dictionary_max_bytes: int = 8 << 20
    geohash_precision: int = 8
    h3_resolution: int = 11
    move_radius_m: float = 100.0
    dwell_threshold_s: float = 900.0
    gap_threshold_s: float = 7200.0
    max_speed_mps: float = 50.0
    max_jump_m: float = 50000.0
    confirm_moves: bool = True
    confirm_window_s: float = 900.0
    walk_max_speed_mps: float = 6.0
    walk_max_jump_m: float = 8000.0
    accuracy_policy: str = "subtract_radii"
    ha_policy: str = "preserve"
    max_ha_m: float = 0.0
    partitions: int = 64
    strict: bool = False
    replace_output: bool = False
    trace_ids: tuple[str, ...] = field(default_factory=tuple)

    def validate(self) -> Config:
        """Self, or ValueError naming the first setting that is out of range."""

        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(bool(self.source.strip()), "source is required")
        need(1 <= self.geohash_precision <= 12, "geohash_precision must be 1 to 12")
        need(0 <= self.h3_resolution <= 15, "h3_resolution must be 0 to 15")
        need(1 <= self.partitions <= 512, "partitions must be 1 to 512")
        need(self.accuracy_policy == "subtract_radii", "accuracy_policy must be subtract_radii")
        need(self.ha_policy in ("preserve", "require"), "ha_policy must be preserve or require")
        need(self.output_profile in ("standard", "full"), "output_profile must be standard or full")
        need(self.parquet_compression in ("zstd", "snappy", "none"), "parquet_compression must be zstd, snappy or none")
        need(self.parquet_row_group_rows > 0, "parquet_row_group_rows must be positive")
        need(self.parquet_dictionary_max_bytes >= 0, "parquet_dictionary_max_bytes must not be negative")
        for name in ("move_radius_m", "dwell_threshold_s", "gap_threshold_s", "max_speed_mps", "max_jump_m", "confirm_window_s", "walk_max_speed_mps", "walk_max_jump_m", "max_ha_m"):
            value = getattr(self, name)
            need(math.isfinite(value) and value >= 0, f"{name} must be finite and not negative")
        return self

    def parameters(self) -> dict[str, Any]:
        """The settings stamped into each event's provenance."""
        return {
            "geohash_precision": self.geohash_precision,
            "move_radius_m": self.move_radius_m,
            "dwell_threshold_s": self.dwell_threshold_s,
            "gap_threshold_s": self.gap_threshold_s,
            "max_speed_mps": self.max_speed_mps,
            "max_jump_m": self.max_jump_m,
            "confirm_moves": self.confirm_moves,
            "confirm_window_s": self.confirm_window_s,
            "walk_max_speed_mps": self.walk_max_speed_mps,
            "walk_max_jump_m": self.walk_max_jump_m,
            "eventizer_algorithm": EVENTIZER_VERSION,
            "accuracy_policy": self.accuracy_policy,
            "ha_policy": self.ha_policy,
            "minimum_presence_observations": 2,
            "same_timestamp_policy": "known_ha_first_then_lowest_ha_then_lat_lon_then_source_row",
            "distance_model": "haversine_wgs84_mean_radius",
        }

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def plain_number(value: Any) -> Any:
    """Whole floats as ints, for JSON that shows 100 rather than 100.0."""
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value
