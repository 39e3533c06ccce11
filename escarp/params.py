"""Parameters of the batch pipeline and of the two analytic requests, with the command line's defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineParams:
    sample_step: float = 10.0
    smooth_window: float = 100.0
    min_length: float = 100.0
    min_grade: float = 0.01
    min_gain: float = 0.0
    prominence: float = 15.0
    max_strip: float = 50.0
    strip_degree: float = 45.0
    max_combo: int = 4
    max_similarity: float = 0.9


@dataclass(frozen=True)
class SearchRequest:
    lat: float
    lng: float
    radius_m: float
    weight_kg: float
    power_w: float
    interval_s: float

    def __post_init__(self) -> None:
        if self.weight_kg <= 0 or self.power_w <= 0 or self.interval_s <= 0:
            raise ValueError("weight, power and interval must be positive")


@dataclass(frozen=True)
class ExploreRequest:
    min_lat: float
    min_lng: float
    max_lat: float
    max_lng: float
    radius_m: float
    min_distance_m: float | None = None
    max_distance_m: float | None = None
    min_grade: float | None = None
    max_grade: float | None = None
    paved: bool | None = None
    bidirectional_only: bool = False

    @classmethod
    def from_form(cls, box: tuple[float, float, float, float], radius_m: float, min_km: float = 0, max_km: float = 0, min_grade: float = 0, max_grade: float = 25, surface: str = "all", bidirectional_only: bool = False) -> ExploreRequest:
        """The request of a form: 0 km, 0 % and 25 % or more mean no limit, and so does surface `all`."""
        metres = lambda km: km * 1000 if km > 0 else None
        paved = {"all": None, "paved": True, "unpaved": False}[surface]
        return cls(box[0], box[1], box[2], box[3], radius_m, metres(min_km), metres(max_km), min_grade if min_grade != 0 else None, max_grade if max_grade < 25 else None, paved, bidirectional_only)
