"""Driver-side values: map projections with their domains, and regions of interest."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from loxodrome.errors import GeoError

NAN = float("nan")
EARTH_RADIUS_KM = 6371.0072

#: Families of the sixteen projections (fixed values).
FAMILIES = {
    "cylindrical": ["equirectangular", "mercator", "transversemercator"],
    "pseudocylindrical": ["robinson", "mollweide", "hammer", "winkeltripel", "sinusoidal"],
    "azimuthal": ["lambert", "stereographic", "orthographic", "azimuthalequidistant", "gnomonic", "polarstereographic"],
    "conic": ["lambertconformal", "albers"],
}
PROJECTIONS = [p for names in FAMILIES.values() for p in names]
WHOLE_WORLD = {"equirectangular", *FAMILIES["pseudocylindrical"]}
#: Degrees from the centre (transverse Mercator: from the central meridian) beyond which nothing is drawn (fixed values).
MAX_DISTANCE = {"stereographic": 154.0, "gnomonic": 84.0, "azimuthalequidistant": 178.0, "orthographic": 90.0, "lambert": 179.5, "transversemercator": 89.5}
SINGULAR_AT = {"stereographic": 180.0, "gnomonic": 90.0, "orthographic": 90.0, "lambert": 180.0, "transversemercator": 90.0, "mercator": 90.0, "polarstereographic": 90.0, "lambertconformal": 90.0}


@dataclass(frozen=True)
class Crs:
    """A projection: parameters are checked, and every limit of its domain is derived here alone."""

    name: str
    center_longitude: float = 0.0
    center_latitude: float = NAN
    hemisphere: str = "north"
    standard_parallel: float = NAN
    standard_parallel2: float = NAN
    radius: float = EARTH_RADIUS_KM
    cone_constant: float = field(init=False, default=NAN)

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("name", self.name.strip().lower())
        if self.name not in PROJECTIONS:
            raise GeoError("crs:UnknownProjection", self.name)
        if self.hemisphere not in ("north", "south"):
            raise GeoError("crs:BadHemisphere", self.hemisphere)
        for p in (self.standard_parallel, self.standard_parallel2):
            if not math.isnan(p) and abs(p) >= 90:
                raise GeoError("crs:BadStandardParallel", str(p))
        pole = 1.0 if self.hemisphere == "north" else -1.0
        if self.family == "conic":
            if math.isnan(self.standard_parallel):
                raise GeoError("crs:MissingParallel", self.name)
            put("cone_constant", self._cone())
            if abs(self.cone_constant) < 1e-12:
                raise GeoError("crs:DegenerateConic", self.name)
        if self.name == "polarstereographic":
            if math.isnan(self.standard_parallel):
                put("standard_parallel", 90 * pole)
            elif self.standard_parallel * pole < 0:
                raise GeoError("crs:PolarParallelSign", str(self.standard_parallel))
        if math.isnan(self.center_latitude):
            put("center_latitude", 90 * pole if self.name == "polarstereographic" else 0.0)

    def _cone(self) -> float:
        p1 = math.radians(self.standard_parallel)
        p2 = p1 if math.isnan(self.standard_parallel2) else math.radians(self.standard_parallel2)
        if self.name == "albers":
            return (math.sin(p1) + math.sin(p2)) / 2
        if abs(p1 - p2) < 1e-9:
            return math.sin(p1)
        t = lambda p: math.tan(math.pi / 4 + p / 2)
        return math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))

    @property
    def family(self) -> str:
        return next(k for k, names in FAMILIES.items() if self.name in names)

    @property
    def is_whole_world(self) -> bool:
        return self.name in WHOLE_WORLD

    @property
    def max_distance(self) -> float | None:
        return MAX_DISTANCE.get(self.name)

    @property
    def latitude_limit(self) -> tuple[float, float]:
        """Five degrees short of the pole where the projection diverges."""
        if self.name == "mercator":
            return -85.0, 85.0
        far_south = {"polarstereographic": self.hemisphere == "north", "lambertconformal": self.cone_constant > 0}.get(self.name)
        return (-90.0, 90.0) if far_south is None else (-85.0, 90.0) if far_south else (-90.0, 85.0)

    def domain(self) -> dict:
        d, s = self.max_distance, SINGULAR_AT.get(self.name)
        return {
            "name": self.name, "family": self.family, "is_whole_world": self.is_whole_world, "max_distance": d, "singular_at": s,
            "clip_is_cosmetic": d is not None and (s is None or d < s), "lat_min": self.latitude_limit[0], "lat_max": self.latitude_limit[1], "cone_constant": None if math.isnan(self.cone_constant) else self.cone_constant,
        }


def as_crs(x: Crs | str | None) -> Crs:
    return x if isinstance(x, Crs) else Crs(x or "equirectangular")


@dataclass(frozen=True)
class Region:
    """A box in degrees (a box over the seam goes past 180), or an outline of (lon, lat) parts."""

    name: str = ""
    lon: tuple[float, float] = (-180.0, 180.0)
    lat: tuple[float, float] = (-90.0, 90.0)
    outline: tuple[tuple[tuple[float, float], ...], ...] = ()

    def __post_init__(self) -> None:
        if not (self.lon[0] < self.lon[1] and self.lat[0] < self.lat[1] and all(map(math.isfinite, (*self.lon, *self.lat)))):
            raise GeoError("region:InvalidBoundingBox", f"{self.lon} {self.lat}")

    @property
    def is_box(self) -> bool:
        return not self.outline

    @staticmethod
    def preset(name: str) -> Region:
        key = name.strip().lower().replace(" ", "")
        if key not in PRESETS:
            raise GeoError("region:UnknownPreset", name)
        w, e, s, n = PRESETS[key]
        return Region(key, (w, e), (s, n))

    @staticmethod
    def of_outline(parts, padding: float = 0.05, name: str = "outline") -> Region:
        """The bounding box of an outline, widened by a share of its span (at least of 1e-6 degrees); latitudes stay on the globe."""
        pts = [(x, y) for part in parts for x, y in part if math.isfinite(x) and math.isfinite(y)]
        if not pts:
            raise GeoError("region:EmptyOutline")
        lo = [min(p[k] for p in pts) for k in (0, 1)]
        hi = [max(p[k] for p in pts) for k in (0, 1)]
        pad = [padding * max(hi[k] - lo[k], 1e-6) for k in (0, 1)]
        return Region(name, (lo[0] - pad[0], hi[0] + pad[0]), (max(-90.0, lo[1] - pad[1]), min(90.0, hi[1] + pad[1])), tuple(tuple(map(tuple, p)) for p in parts))


#: Named boxes as west, east, south, north (fixed values, approximate by convention).
PRESETS: dict[str, tuple[float, float, float, float]] = {
    "world": (-180, 180, -90, 90),
    "global": (-180, 180, -90, 90),
    "europe": (-25, 45, 34, 72),
    "africa": (-20, 55, -35, 38),
    "asia": (25, 180, -10, 82),
    "northamerica": (-170, -50, 5, 85),
    "southamerica": (-82, -34, -56, 13),
    "oceania": (110, 180, -50, -5),
    "australia": (110, 155, -45, -10),
    "middleeast": (25, 63, 12, 42),
    "centralamerica": (-95, -75, 5, 23),
    "arctic": (-180, 180, 60, 90),
    "antarctica": (-180, 180, -90, -60),
}
