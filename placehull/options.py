"""Parameters of a matching run."""

from __future__ import annotations

from dataclasses import dataclass

VAR = "VAR"
CRS_NAMES = ("wgs84", "gcj02", "bd09")


@dataclass(frozen=True)
class MatchOptions:
    """What to accept and how to rank.

    ``prim_ind`` / ``sec_ind``: '' = no constraint, ``VAR`` = take the POI's own column.
    ``radius`` in metres, areas in square kilometres.
    ``sort_by_area``: 1 = smaller first, -1 = larger first, 0 = off.
    """

    prim_ind: str = ""
    sec_ind: str = ""
    radius: float = 2000
    radius_limit: str = "true"
    crs: str = "wgs84"
    use_first_uid: bool = False
    update_interval: int = 150
    min_aoi_area: float = 0
    max_aoi_area: float = 10000
    min_similarity: float = 0
    sort_by_search_rank: int = 1
    sort_by_area: int = 0
    sort_by_distance: int = 1
    sort_by_similarity: int = 1
    utm_zone: int = 50

    def __post_init__(self):
        for name in ("prim_ind", "sec_ind"):
            if not isinstance(getattr(self, name), str):
                raise TypeError(f"{name} must be a string")
        for name in ("radius", "min_aoi_area", "max_aoi_area"):
            if isinstance(getattr(self, name), bool) or not getattr(self, name) >= 0:
                raise ValueError(f"{name} must be a number of at least 0")
        if self.radius_limit not in ("true", "false"):
            raise ValueError("radius_limit must be 'true' or 'false'")
        if self.crs not in CRS_NAMES:
            raise ValueError(f"crs must be one of {CRS_NAMES}")
        if not self.update_interval > 0:
            raise ValueError("update_interval must be positive")
        if not self.min_similarity < 1:
            raise ValueError("min_similarity must be below 1")
        if self.sort_by_area not in (-1, 0, 1):
            raise ValueError("sort_by_area must be -1, 0 or 1")
        for name in ("sort_by_search_rank", "sort_by_distance", "sort_by_similarity"):
            if getattr(self, name) not in (0, 1):
                raise ValueError(f"{name} must be 0 or 1")
        if not self.enabled_sorts:
            raise ValueError("at least one sort must be on")
        if not 1 <= self.utm_zone <= 60:
            raise ValueError("utm_zone must be 1..60")

    @property
    def enabled_sorts(self) -> tuple[str, ...]:
        names = ("search_rank", "area", "distance", "similarity")
        return tuple(n for n in names if getattr(self, f"sort_by_{n}"))

    @property
    def radius_km(self) -> float:
        return self.radius / 1000


PRESETS = {
    # one residential category for every POI, small and similarly named areas only
    "residential": MatchOptions(
        prim_ind="房地产", sec_ind="住宅区", max_aoi_area=1, min_similarity=0.1
    ),
    # category per POI, larger areas first, input in bd09
    "mixed_large": MatchOptions(
        prim_ind=VAR, sec_ind=VAR, crs="bd09", min_aoi_area=0.02, sort_by_area=-1
    ),
}
