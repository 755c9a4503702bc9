"""Maps as rows: each element of a map becomes SCENE rows, and a map is their union.

A scene is lazy: limits and medians that many rows need are one-row aggregates, and
everything else is one plan.  A second element of a kind replaces the first.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.errors import GeoError, GeoWarning
from loxodrome.functions import geo, ticks
from loxodrome.functions.sqltext import num
from loxodrome.model import Crs, Region, as_crs
from loxodrome.operators import color, fields, geometry, grid, projection, tracks
from loxodrome.operators.tracks import good

COLUMNS = {"scene_id": "string", "kind": "string", "object_id": "string", "part_id": "int", "seq": "long", "x": "double", "y": "double", "z_level": "int", "r": "double", "g": "double", "b": "double", "alpha": "double", "text": "string"}
#: Drawing order (fixed values).
Z_LEVEL = {"basemap": 0, "contours": 1, "polygons": 2, "stipple": 2, "graticule": 3, "coastline": 4, "rivers": 4, "region": 4, "inset": 4, "track": 5, "points": 5, "series": 5, "frame": 6, "colorbar": 6, "title": 6, "scalebar": 6, "northarrow": 6}


def rows(df: DataFrame, kind: str, scene_id: str = "map", **columns: Column) -> DataFrame:
    """df as SCENE rows; columns that are not given are absent values."""
    if kind not in Z_LEVEL:
        raise GeoError("scene:UnknownKind", kind)
    fixed = {"scene_id": F.lit(scene_id), "kind": F.lit(kind), "z_level": F.lit(Z_LEVEL[kind]), "object_id": F.lit("0"), "part_id": F.lit(0), "seq": F.lit(0), "alpha": F.lit(1.0), "r": F.lit(0.0), "g": F.lit(0.0), "b": F.lit(0.0)}
    return df.select(*((columns.get(c, fixed.get(c, F.lit(None)))).cast(t).alias(c) for c, t in COLUMNS.items()))


class Scene:
    """Elements by kind over one extent and projection."""

    def __init__(self, spark: SparkSession, crs: Crs | str | None = None, lon_limit=(-180.0, 180.0), lat_limit=(-90.0, 90.0), scene_id: str = "map") -> None:
        self.spark, self.crs, self.scene_id = spark, as_crs(crs), scene_id
        lo, hi = self.crs.latitude_limit
        self.lon_limit, self.lat_limit = tuple(map(float, lon_limit)), (max(float(lat_limit[0]), lo), min(float(lat_limit[1]), hi))
        self.elements: dict[str, DataFrame] = {}
        self.data: dict[str, dict] = {}

    # registry -----------------------------------------------------------------------------------------
    def put(self, kind: str, df: DataFrame, **data) -> Scene:
        self.elements[kind] = df
        self.data[kind] = data
        return self

    def remove(self, kind: str) -> Scene:
        self.elements.pop(kind, None)
        self.data.pop(kind, None)
        return self

    def kinds(self) -> list[str]:
        return sorted(self.elements, key=lambda k: (Z_LEVEL[k], k))

    def frame_rows(self) -> DataFrame:
        if not self.elements:
            raise GeoError("map:NothingToDraw")
        out = None
        for k in self.kinds():
            out = self.elements[k] if out is None else out.unionByName(self.elements[k])
        return out

    def boundary(self) -> DataFrame:
        return geometry.map_boundary(self.spark, self.crs, self.lon_limit, self.lat_limit)

    def box(self) -> tuple[float, float, float, float]:
        """West, east, south, north of the projected outline (a few dozen vertices)."""
        b = self.boundary().agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if b[0] is None:
            raise GeoError("frame:NothingToDraw")
        return b[0], b[1], b[2], b[3]

    def diagonal(self) -> float:
        w, e, s, n = self.box()
        return math.hypot(e - w, n - s) or 1.0

    def _placed(self, df: DataFrame) -> DataFrame:
        d = projection.project(df, self.crs)
        return d.where(geo.inside_extent("lon", "lat", self.lon_limit, self.lat_limit, "x", "y"))

    # elements -----------------------------------------------------------------------------------------
    def basemap(self, g: DataFrame, colormap="viridis", limits=None, limit_mode: str = "auto", percents=(2, 98), levels: int | None = None, shade: bool = False, masked: dict | None = None, compat: bool = False) -> Scene:
        d = grid.roll_to_centre(g, self.crs.center_longitude)
        if masked:
            d = grid.mask(d, **masked)
            v = grid.mask_verdict(d).first()
            if v[0] or v[1]:
                warnings.warn(GeoWarning("basemap:MaskCoversEverything" if v[0] else "basemap:MaskCoversNothing"), stacklevel=2)
        if shade and "topo" in d.columns:
            d = grid.hillshade(d)
        if limits is None:
            q = fields.percentile_limits(d, "z", percents, compat) if limit_mode == "percentile" else fields.symmetric_limits(d, "z") if limit_mode == "symmetric" else fields.value_limits(d, "z")
            limits = tuple(q.first())
        d = color.truecolor(d, colormap, limits=limits, masked="masked" if masked else None, shade="shade" if shade and "topo" in g.columns else None, levels=levels)
        flags = fields.range_flags(g, "z", *limits)
        d = self._placed(d)
        return self.put("basemap", rows(d, "basemap", self.scene_id, x=F.col("x"), y=F.col("y"), r=F.col("r"), g=F.col("g"), b=F.col("b"), part_id=F.col("i"), seq=F.col("j")), limits=limits, colormap=colormap, levels=levels, flags=flags)

    def contours(self, g: DataFrame, levels: list[float] | None = None, dash_negative: bool = True) -> Scene:
        if levels is None:
            lo, hi = fields.value_limits(g, "z").first()
            levels = geometry.contour_levels(lo, hi)
        lines = geometry.chain_segments(geometry.contour_segments(g, levels)).withColumn("path_id", F.concat_ws(":", "level", "line"))
        p = geometry.project_paths(geometry.clip_paths(lines.select("path_id", "seq", "lon", "lat"), self.crs, self.lon_limit, self.lat_limit).withColumn("path_id", F.concat_ws("/", "path_id", "part_id")), self.crs, self.diagonal() / 4)
        dashed = F.split("path_id", ":")[0].cast("double") < 0
        return self.put("contours", rows(p, "contours", self.scene_id, object_id=F.col("path_id"), part_id=F.col("part_id"), seq=F.col("seq"), x=F.col("x"), y=F.col("y"), text=F.when(dashed & F.lit(dash_negative), "--").otherwise("-")), levels=levels)

    def polygons(self, rings: DataFrame, values: DataFrame | None = None, colormap="viridis", limits=None) -> Scene:
        r = geometry.split_rings(rings, self.crs.center_longitude)
        r = geometry.visible_rings(projection.project(r, self.crs))
        col = {"r": F.lit(0.7), "g": F.lit(0.7), "b": F.lit(0.7)}
        if values is not None:
            r = geometry.rings_with_values(rings, values).select("poly_id", "value").distinct().join(r, "poly_id")
            r = color.truecolor(r, colormap, "value", limits)
            col = {k: F.col(k) for k in "rgb"}
        return self.put("polygons", rows(r, "polygons", self.scene_id, object_id=F.col("poly_id"), part_id=F.col("part_id"), seq=F.col("seq"), x=F.col("x"), y=F.col("y"), **col))

    def stipple(self, g: DataFrame, style: str = "dots", density: int = 2000, spacing: float | None = None) -> Scene:
        if style == "dots":
            d = self._placed(grid.stipple_dots(g, density))
            return self.put("stipple", rows(d, "stipple", self.scene_id, x=F.col("x"), y=F.col("y"), seq=F.monotonically_increasing_id()))
        h = grid.stipple_hatch(self._placed(g), spacing or self.diagonal() / 60)
        ends = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
        d = h.select("line", "stroke", ends.alias("e"))
        return self.put("stipple", rows(d, "stipple", self.scene_id, object_id=F.col("line"), part_id=F.col("stroke"), seq=F.col("e.k"), x=F.col("e.x"), y=F.col("e.y")))

    def _lines(self, lines: DataFrame, kind: str, densify: bool = True) -> Scene:
        c = geometry.clip_paths(lines.select("path_id", "seq", "lon", "lat"), self.crs, self.lon_limit, self.lat_limit)
        c = c.select(F.concat_ws("/", "path_id", "part_id").alias("path_id"), "seq", "lon", "lat")
        p = geometry.project_paths(c, self.crs, self.diagonal() / (200 if densify else 4), densify)
        return self.put(kind, rows(p, kind, self.scene_id, object_id=F.col("path_id"), part_id=F.col("part_id"), seq=F.col("seq"), x=F.col("x"), y=F.col("y")))

    def coastline(self, lines: DataFrame, kind: str = "coastline") -> Scene:
        return self._lines(lines, kind, densify=False)

    def region(self, r: Region) -> Scene:
        parts = r.outline or (((r.lon[0], r.lat[0]), (r.lon[1], r.lat[0]), (r.lon[1], r.lat[1]), (r.lon[0], r.lat[1]), (r.lon[0], r.lat[0])),)
        lines = self.spark.createDataFrame([(str(n), k, float(x), float(y)) for n, p in enumerate(parts) for k, (x, y) in enumerate(p)], "path_id string, seq long, lon double, lat double")
        return self._lines(lines, "region")

    def graticule_lines(self, step_lon: float | None = None, step_lat: float | None = None) -> DataFrame:
        w, e = self.lon_limit
        s, n = self.lat_limit
        for st in (step_lon, step_lat):
            if st is not None and st <= 0:
                raise GeoError("graticule:BadStep", str(st))
        multiples = lambda lo, hi, st: [k * st for k in range(math.ceil(lo / st - 1e-9), math.floor(hi / st + 1e-9) + 1)] if st else ticks.nice_ticks(lo, hi, "graticule")
        out = []
        for v in multiples(w, e, step_lon):
            out += [(f"lon:{v:g}", k, float(v), float(y)) for k, y in enumerate(np.linspace(s, n, 61))]
        for v in multiples(s, n, step_lat):
            out += [(f"lat:{v:g}", k, float(x), float(v)) for k, x in enumerate(np.linspace(w, e, 121))]
        return self.spark.createDataFrame(out, "path_id string, seq long, lon double, lat double")

    def graticule(self, step_lon: float | None = None, step_lat: float | None = None, labels: bool = True) -> Scene:
        self._lines(self.graticule_lines(step_lon, step_lat), "graticule")
        if labels:
            g = self.elements["graticule"]
            first = g.groupBy("object_id").agg(F.min_by(F.struct("x", "y"), F.struct("part_id", "seq")).alias("p"))
            value = F.regexp_extract("object_id", ":(-?[0-9.]+)", 1).cast("double")
            named = first.withColumn("v", value)
            text = F.when(F.col("object_id").startswith("lon"), F.expr(geo.format_lon("v"))).otherwise(F.expr(geo.format_lat("v")))
            self.elements["graticule"] = g.unionByName(rows(named, "graticule", self.scene_id, object_id=F.concat(F.lit("label "), F.col("object_id")), x=F.col("p.x"), y=F.col("p.y"), text=text))
        return self

    def track(self, t: DataFrame, style: str = "gradient", colormap="viridis", limits=None, fraction: float = 0.06) -> Scene:
        """t: track_id, seq, lon, lat, obs (and pass_id, if it was split)."""
        d = t.where("pass_id is not null") if "pass_id" in t.columns else t.withColumn("pass_id", F.lit(1))
        d = tracks.runs(self._placed(d), ["x", "y"])
        if style in ("ribbon", "bicolor"):
            d = tracks.ribbon(d.where(good("obs")), fraction, self.diagonal(), bicolor=style == "bicolor").withColumns({"x": F.col("rx"), "y": F.col("ry")})
        d = color.truecolor(d, colormap, "obs", limits)
        return self.put("track", rows(d, "track", self.scene_id, object_id=F.concat_ws("#", "track_id", "pass_id"), part_id=F.col("run_id"), seq=F.col("seq"), x=F.col("x"), y=F.col("y"), r=F.col("r"), g=F.col("g"), b=F.col("b")), style=style)

    def points(self, p: DataFrame, colormap="viridis", limits=None, size_range=(16, 400), scale: str = "area") -> Scene:
        """p: point_id, lon, lat, obs, size, label."""
        d = self._placed(p.where(good("lon") & good("lat")))
        if not d.limit(1).count():
            raise GeoError("overlayPoints:NothingToDraw")
        d = color.truecolor(fields.marker_areas(d, "size", size_range, scale), colormap, "obs", limits)
        return self.put("points", rows(d, "points", self.scene_id, object_id=F.col("point_id"), x=F.col("x"), y=F.col("y"), r=F.col("r"), g=F.col("g"), b=F.col("b"), alpha=F.col("area"), text=F.col("label")))

    def frame(self, segments: int = 16) -> Scene:
        return self.put("frame", rows(self.boundary(), "frame", self.scene_id, seq=F.col("seq"), x=F.col("x"), y=F.col("y"), r=(F.floor(F.col("seq") * segments / 48) % 2).cast("double"), g=(F.floor(F.col("seq") * segments / 48) % 2).cast("double"), b=(F.floor(F.col("seq") * segments / 48) % 2).cast("double")))

    def colorbar(self, label: str = "", second: tuple[float, float] | None = None) -> Scene:
        if "basemap" not in self.data:
            raise GeoError("colorbar:NoBasemap")
        lo, hi = self.data["basemap"]["limits"]
        main, minor = ticks.colorbar_ticks(lo, hi, self.data["basemap"]["levels"])
        out = [("tick", float(v), f"{v:g}") for v in main] + [("minor", float(v), None) for v in minor] + ([("label", (lo + hi) / 2, label)] if label else [])
        if second:
            out += [("second", lo + (v - second[0]) / (second[1] - second[0]) * (hi - lo), f"{v:g}") for v in ticks.nice_ticks(*second)]
        d = self.spark.createDataFrame(out, "o string, x double, text string")
        return self.put("colorbar", rows(d, "colorbar", self.scene_id, object_id=F.col("o"), x=F.col("x"), y=F.lit(0.0), text=F.col("text")))

    def title(self, text: str) -> Scene:
        w, e, _, n = self.box()
        d = self.spark.createDataFrame([((w + e) / 2, n + 0.03 * self.diagonal(), text)], "x double, y double, text string")
        return self.put("title", rows(d, "title", self.scene_id, x=F.col("x"), y=F.col("y"), text=F.col("text")))

    def _corner(self, where: str, margin: float) -> tuple[float, float]:
        w, e, s, n = self.box()
        x = w + margin if "west" in where else e - margin if "east" in where else (w + e) / 2
        return x, n - margin if "north" in where else s + margin

    def _unproject(self, pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
        d = self.spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "k int, x double, y double")
        return [(r["lon"], r["lat"]) for r in projection.unproject(d, self.crs).orderBy("k").collect()]

    def km_per_unit(self, x: float, y: float) -> float:
        w, e, _, _ = self.box()
        step = (e - w) / 1e6
        (a, b), (c, d) = self._unproject([(x - step / 2, y), (x + step / 2, y)])
        if not all(map(math.isfinite, (a, b, c, d))):
            raise GeoError("scalebar:DegenerateScale")
        km = great_circle_value(a, b, c, d, self.crs.radius)
        if not km > 0:
            raise GeoError("scalebar:DegenerateScale")
        return km / step

    def scale_variation(self) -> float:
        """Largest over smallest scale on a 7 x 7 sample, two percent in from the edges."""
        (w, e), (s, n) = self.lon_limit, self.lat_limit
        inset = lambda a, b: np.linspace(a + 0.02 * (b - a), b - 0.02 * (b - a), 7)
        d = projection.scale_factors(grid.mesh(self.spark, list(inset(w, e)), list(inset(s, n))), self.crs)
        v = d.select(F.explode(F.array("h", "k")).alias("v")).where(good("v") & (F.col("v") > 0)).agg(F.max("v"), F.min("v")).first()
        return v[0] / v[1] if v[0] else 1.0

    def scalebar(self, units: str = "km", length: float | None = None, fraction: float = 0.25, segments: int = 4, where: str = "southwest", warn_above: float = 1.05) -> Scene:
        w, e, _, _ = self.box()
        x, y = self._corner(where, 0.05 * self.diagonal())
        per = self.km_per_unit(x, y) / (1.609344 if units == "mi" else 1.0)
        total = length or ticks.nice_length(per * (e - w) * fraction)
        if (v := self.scale_variation()) > warn_above:
            warnings.warn(GeoWarning("scalebar:ScaleVaries", f"{v:.3f}"), stacklevel=2)
        out = [(k, x + total / per * k / segments, y, f"{total * k / segments:g} {units}") for k in range(segments + 1)]
        d = self.spark.createDataFrame(out, "seq long, x double, y double, text string")
        return self.put("scalebar", rows(d, "scalebar", self.scene_id, seq=F.col("seq"), x=F.col("x"), y=F.col("y"), text=F.col("text")), length=total, km_per_unit=per)

    def north_bearing(self, x: float, y: float, d: float = 0.025) -> float:
        """Direction of north on the map at a point, in degrees from up; 0 off the map."""
        ((lon, lat),) = self._unproject([(x, y)])
        if not (math.isfinite(lon) and math.isfinite(lat)):
            return 0.0
        px, py = geometry.forward([lon, lon], [lat - d, lat + d], self.crs)
        return float(np.degrees(np.arctan2(px[1] - px[0], py[1] - py[0]))) if np.isfinite([px, py]).all() else 0.0

    def northarrow(self, where: str = "northeast", size: float = 0.08, label: str = "N") -> Scene:
        h = size * self.diagonal()
        x, y = self._corner(where, h)
        a = math.radians(self.north_bearing(x, y))
        turn = lambda u, v: (x + u * math.cos(a) + v * math.sin(a), y - u * math.sin(a) + v * math.cos(a))
        glyph = [(0, *turn(0, h / 2), label), (1, *turn(h / 4, -h / 2), None), (2, *turn(0, -h / 4), None), (3, *turn(-h / 4, -h / 2), None), (4, *turn(0, h / 2), None)]
        d = self.spark.createDataFrame(glyph, "seq long, x double, y double, text string")
        return self.put("northarrow", rows(d, "northarrow", self.scene_id, seq=F.col("seq"), x=F.col("x"), y=F.col("y"), text=F.col("text")), bearing=math.degrees(a))

    def inset(self, size: float = 0.3, where: str = "southeast") -> Scene:
        """A globe seen from above the extent's centre, with the extent's ring on it."""
        (w, e), (s, n) = self.lon_limit, self.lat_limit
        c = Crs("orthographic", center_longitude=(w + e) / 2, center_latitude=max(-90.0, min(90.0, (s + n) / 2)))
        r = size * self.diagonal() / 2
        x0, y0 = self._corner(where, r)
        t = np.linspace(0, 2 * np.pi, 73)
        ring = self.spark.createDataFrame([("globe", k, float(x0 + r * np.cos(v)), float(y0 + r * np.sin(v))) for k, v in enumerate(t)], "o string, seq long, x double, y double")
        edge = projection.project(self.boundary().select("seq", "lon", "lat"), c).where("not isnan(x)")
        edge = edge.select(F.lit("extent").alias("o"), "seq", (F.col("x") * r + x0).alias("x"), (F.col("y") * r + y0).alias("y"))
        return self.put("inset", rows(ring.unionByName(edge), "inset", self.scene_id, object_id=F.col("o"), seq=F.col("seq"), x=F.col("x"), y=F.col("y")))


def great_circle_value(lon1: float, lat1: float, lon2: float, lat2: float, radius: float) -> float:
    p1, p2, dl = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2
    return 2 * radius * math.asin(min(1.0, math.sqrt(a)))


#: Elements after the basemap, in order, and the argument their data goes to (fixed values).
LADDER = ["contours", "polygons", "stipple", "graticule", "coastline", "rivers", "region", "track", "points", "frame", "colorbar", "title", "scalebar", "northarrow", "inset"]
DATA_FIELD = {"polygons": "rings", "stipple": "g", "coastline": "lines", "rivers": "lines", "region": "r", "track": "t", "points": "p", "title": "text"}
ON_BY_DEFAULT = {"graticule", "frame", "colorbar"}


def draw_map(g: DataFrame, crs: Crs | str | None = None, basemap: dict | bool = True, lon_limit=None, lat_limit=None, scene_id: str = "map", **elements) -> Scene:
    """A map of a grid. Each element is False, True, its data, or a dict of arguments."""
    unknown = set(elements) - set(LADDER)
    if unknown:
        raise GeoError("map:UnknownElement", ", ".join(sorted(unknown)))
    if lon_limit is None or lat_limit is None:
        d = grid.describe(g)
        lon_limit = lon_limit or ((-180.0, 180.0) if d["is_global_lon"] else d["lon_region"])
        lat_limit = lat_limit or d["lat_region"]
    c = as_crs(crs)
    if c.is_whole_world and lon_limit == (-180.0, 180.0):
        lon_limit = (c.center_longitude - 180, c.center_longitude + 180)
    scene = Scene(g.sparkSession, c, lon_limit, lat_limit, scene_id)
    if basemap is not False:
        scene.basemap(g, **(basemap if isinstance(basemap, dict) else {}))
    for name in LADDER:
        want = elements.get(name, name in ON_BY_DEFAULT and (name != "colorbar" or basemap is not False))
        if want is False:
            continue
        args = dict(want) if isinstance(want, dict) else {} if want is True else {DATA_FIELD.get(name, "g"): want}
        if name == "contours":
            args.setdefault("g", g)
        if name in DATA_FIELD and DATA_FIELD[name] not in args:
            raise GeoError("map:MissingField", f"{name}: {DATA_FIELD[name]}")
        if name == "rivers":
            args["kind"] = "rivers"
        getattr(scene, "coastline" if name == "rivers" else name)(**args)
    return scene


def extent_of(df: DataFrame, region: Region | None = None, lon_limit=None, lat_limit=None, pad: float = 0.05) -> tuple[tuple[float, float], tuple[float, float]]:
    """Limits given outright come first, then the region, then the data with a margin."""
    if lon_limit is None or lat_limit is None:
        if region is not None:
            own = (region.lon, region.lat)
        else:
            b = fields.bounding_box(df, pad).first()
            if b["west"] is None:
                raise GeoError("mapBackdrop:NothingFinite")
            own = ((b["west"], b["east"]), (b["south"], b["north"]))
        lon_limit, lat_limit = lon_limit or own[0], lat_limit or own[1]
    return tuple(lon_limit), tuple(lat_limit)


def _over_background(df: DataFrame, kind: str, field: str, background: DataFrame | None, crs, extent: dict, elements: dict, style: dict) -> Scene:
    lon, lat = extent_of(df, **extent)
    c = as_crs(crs) if crs is not None else Crs("equirectangular", center_longitude=(lon[0] + lon[1]) / 2)
    base = grid.background(background, lon, lat) if background is not None else grid.mesh(df.sparkSession, list(np.linspace(*lon, 8)), list(np.linspace(*lat, 8)))
    return draw_map(base, c, basemap=background is not None, lon_limit=lon, lat_limit=lat, **{kind: {field: df, **style}}, **elements)


def track_map(t: DataFrame, crs=None, background: DataFrame | None = None, region=None, lon_limit=None, lat_limit=None, pad: float = 0.05, style: dict | None = None, **elements) -> Scene:
    return _over_background(t, "track", "t", background, crs, {"region": region, "lon_limit": lon_limit, "lat_limit": lat_limit, "pad": pad}, elements, style or {})


def point_map(p: DataFrame, crs=None, background: DataFrame | None = None, region=None, lon_limit=None, lat_limit=None, pad: float = 0.05, style: dict | None = None, **elements) -> Scene:
    return _over_background(p, "points", "p", background, crs, {"region": region, "lon_limit": lon_limit, "lat_limit": lat_limit, "pad": pad}, elements, style or {})


def time_series(t: DataFrame, offset: bool = True, spacing: float | None = None, gap: float | str | None = "auto", sigma=None, references: list[float] | None = None, scene_id: str = "series") -> DataFrame:
    """Stacked series as SCENE rows: x is time, y the value with its offset; bands and reference lines if asked for."""
    d = tracks.split_tracks(t, time_gap=gap, min_points=1) if gap is not None else t.withColumn("pass_id", F.lit(1))
    d = tracks.stack_offsets(d, spacing=spacing if offset else 0.0)
    line = tracks.runs(d.withColumn("y", F.col("stacked")), ["y", "time"])
    out = rows(line, "series", scene_id, object_id=F.concat_ws("#", "track_id", "pass_id"), part_id=F.col("run_id"), seq=F.col("seq"), x=F.col("time"), y=F.col("y"))
    if sigma is not None:
        b = tracks.uncertainty_band(d, "stacked", sigma)
        for side in ("lo", "hi"):
            out = out.unionByName(rows(b, "series", scene_id, object_id=F.concat(F.lit(f"band {side} "), F.col("track_id").cast("string")), part_id=F.col("run_id"), seq=F.col("seq"), x=F.col("time"), y=F.col(side), alpha=F.lit(0.25)))
    anchor = tracks.label_anchor(d, "stacked")
    out = out.unionByName(rows(anchor, "series", scene_id, object_id=F.concat(F.lit("label "), F.col("track_id").cast("string")), x=F.col("label_time"), y=F.col("label_value"), text=F.col("track_id").cast("string")))
    if references:
        off = d.select("track_id", "offset").distinct()
        ref = tracks.reference_lines(d, references).join(off, "track_id").withColumn("y", F.col("value") + F.col("offset"))
        ends = ref.withColumn("x", F.explode(F.array("t0", "t1")))
        out = out.unionByName(rows(ends, "series", scene_id, object_id=F.concat_ws(" ", F.lit("reference"), F.col("track_id").cast("string"), F.col("value").cast("string")), x=F.col("x"), y=F.col("y"), alpha=F.lit(0.6)))
    return out


def panel(tiles: list[dict], shared: bool = True) -> DataFrame:
    """Tiles (type: map, track, points or series; data; options) on a near-square page, one scene each; maps share colour limits."""
    n_rows, n_cols = ticks.near_square(len(tiles))
    maps = [t for t in tiles if t["type"] == "map"]
    limits = tuple(fields.shared_limits([t["data"] for t in maps], "z").first()) if shared and len(maps) > 1 else None
    out = None
    for k, t in enumerate(tiles):
        opts = dict(t.get("options", {}))
        if t["type"] == "map":
            if limits:
                opts["basemap"] = {**(opts.get("basemap") or {}), "limits": limits}
            if limits and k != max(i for i, u in enumerate(tiles) if u["type"] == "map"):
                opts["colorbar"] = False
            df = draw_map(t["data"], scene_id=f"tile{k}", **opts).frame_rows()
        elif t["type"] in ("track", "points"):
            df = (track_map if t["type"] == "track" else point_map)(t["data"], **opts).frame_rows()
        elif t["type"] == "series":
            df = time_series(t["data"], **opts)
        else:
            raise GeoError("panel:UnknownType", t["type"])
        df = df.withColumns({"scene_id": F.lit(f"tile{k}"), "row": F.lit(k // n_cols), "col": F.lit(k % n_cols)})
        out = df if out is None else out.unionByName(df)
    return out


# --- label placement: a few rectangles -----------------------------------------------------------------


def avoid_collisions(rect: list[float], obstacles: list[list[float]], direction: tuple[float, float], bounds: list[float] | None = None, gap: float = 4.0) -> list[float]:
    """Pushes [x, y, w, h] along a direction until it is clear of the obstacles (at most eight rounds), then back inside the bounds."""
    n = math.hypot(*direction)
    if n == 0:
        raise GeoError("avoidRectCollisions:ZeroDirection")
    if any(len(o) != 4 for o in obstacles):
        raise GeoError("avoidRectCollisions:InvalidObstacles")
    if bounds is not None and len(bounds) != 4:
        raise GeoError("avoidRectCollisions:InvalidBounds")
    d = (direction[0] / n, direction[1] / n)
    x, y, w, h = rect
    for _ in range(8):
        moved = False
        for ox, oy, ow, oh in obstacles:
            if min(x + w, ox + ow) > max(x, ox) and min(y + h, oy + oh) > max(y, oy):
                reach = (oy + oh - y if d[1] > 0 else y + h - oy) if d[1] else (ox + ow - x if d[0] > 0 else x + w - ox)
                x, y, moved = x + d[0] * (reach + gap), y + d[1] * (reach + gap), True
        if not moved:
            break
    if bounds is not None:
        x = min(max(x, bounds[0]), bounds[0] + bounds[2] - w)
        y = min(max(y, bounds[1]), bounds[1] + bounds[3] - h)
    return [x, y, w, h]


def plotted_box(axes: list[float], aspect: float) -> list[float]:
    """The largest rectangle of width/height ``aspect`` centred in [x, y, w, h]."""
    x, y, w, h = axes
    pw, ph = (w, w / aspect) if w / h <= aspect else (h * aspect, h)
    return [x + (w - pw) / 2, y + (h - ph) / 2, pw, ph]


def north_bearing_expr(crs: Crs | str, d: float = 0.025, dialect: str = "spark") -> str:
    x0, y0 = geo.project("lon", f"(lat - {num(d)})", crs, dialect=dialect)
    x1, y1 = geo.project("lon", f"(lat + {num(d)})", crs, dialect=dialect)
    return f"(atan2({x1} - {x0}, {y1} - {y0}) * 180e0 / pi())"
