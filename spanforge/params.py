"""Parameters of the search, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


# The defaults of every parameter, and the clearance that each class of way asks for.
@dataclass(frozen=True)
class Params:
    frame_min: float = 0.0
    frame_max: float = 1.5
    off_level_ratio: float = 0.03
    min_clearance: float = 3.0
    water_clearance: float = 1.0
    way_clearance: dict[str, float] = field(default_factory=lambda: {"path": 0.0, "cycle": 3.0, "street": 8.0, "road": 12.0, "highway": 20.0})
    anchor_zone: float = 10.0
    min_exposure: float = 10.0
    min_length: float = 50.0
    max_length: float = 500.0
    sag_ratio: float = 0.05
    side_ratio: float = 0.04
    side_samples: int = 9
    max_blocked: float = 0.8
    anchor_step: float = 5.0
    sectors: int = 64
    min_drop: float = 10.0
    drop_radius: float = 25.0
    probe_length: float = 40.0
    fall_slope: float = 0.1
    profile_step: float = 2.0
    profile_points: int = 120
    dedup_radius: float = 25.0
    max_crossings: int = 20
    keep_best: int = 100
    refine_radius: float = 3.0
    refine_step: float = 1.0
    refine_passes: int = 8
    mask_res: float = 16.0
    mask_radius: float = 32.0
    mask_drop: float = 10.0
    mask_coverage: float = 0.01
    mask_roofs: int = 1
    roof_drop: float = 25.0
    spot_blocked: float = 0.2
    spot_score: float = 55.0
    spot_radius: float = 50.0


DEFAULTS = Params()
