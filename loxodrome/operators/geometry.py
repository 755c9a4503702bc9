"""Lines and polygons: clipping to the map, densifying, branch cuts, rings over the seam, contours, points in polygons.

What a segment or a cell decides for itself stays native.  Clipping takes neighbours and
parts by window and halves all cut segments of a batch in step.  What depends on a whole
path (densifying, chaining) runs per path in Arrow groups, one path a task at most.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.functions import geo
from loxodrome.functions.sqltext import finite, num
from loxodrome.functions.ticks import nice_ticks
from loxodrome.model import Crs, as_crs
from loxodrome.operators.projection import winkel_inverse  # noqa: F401  (part of the public surface)
from loxodrome.operators.tracks import good


# --- numpy projections for driver geometry and per-path work ------------------------------------------


def project_points(lon: np.ndarray, lat: np.ndarray, crs: Crs | str, closed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The forward projection on arrays; the same formulas as functions.geo.project, evaluated by numpy."""
    env = {
        "pi": lambda: np.pi, "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan2": np.arctan2, "ln": np.log, "sqrt": np.sqrt,
        "pow": np.power, "abs": np.abs, "sign": np.sign, "floor": np.floor, "least": np.minimum, "greatest": np.maximum, "isnan": np.isnan, "exp": np.exp,
    }
    c = as_crs(crs)
    with np.errstate(all="ignore"):
        return tuple(np.asarray(_evaluate(e, {**env, "lon": np.asarray(lon, float), "lat": np.asarray(lat, float)}), float) + 0 * np.asarray(lon, float) for e in _numpy_text(c, closed))


def _numpy_text(c: Crs, closed: bool) -> tuple[str, str]:
    if c.name == "mollweide":
        raise GeoError("project:UseMollweide")
    return geo.project("lon", "lat", c, "closed" if closed else "halfopen")


@lru_cache(maxsize=64)
def _tokens(text: str) -> list[str]:
    return text.replace("(", " ( ").replace(")", " ) ").replace(",", " , ").split()


def _evaluate(text: str, env: dict):
    """Evaluates the CASE expressions of functions.sqltext over arrays."""
    tokens = _tokens(text)
    pos = 0

    def peek() -> str:
        return tokens[pos] if pos < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal pos
        t = tokens[pos]
        if want and t.upper() != want:
            raise ValueError(f"{want} expected, {t} found")
        pos += 1
        return t

    def either():
        v = both()
        while peek().upper() == "OR":
            take()
            v = np.logical_or(v, both())
        return v

    def both():
        v = negated()
        while peek().upper() == "AND":
            take()
            v = np.logical_and(v, negated())
        return v

    def negated():
        if peek().upper() == "NOT":
            take()
            return np.logical_not(negated())
        v = total()
        ops = {"<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal, "=": np.equal, "<>": np.not_equal}
        if peek() in ops:
            return ops[take()](v, total())
        if peek().upper() == "IS":
            take("IS"), take("NULL")
            return False
        return v

    def total():
        v = product()
        while peek() in ("+", "-"):
            v = v + product() if take() == "+" else v - product()
        return v

    def product():
        v = unary()
        while peek() in ("*", "/"):
            v = v * unary() if take() == "*" else v / unary()
        return v

    def unary():
        if peek() in ("-", "+"):
            return -unary() if take() == "-" else unary()
        t = take()
        if t.startswith("-") and len(t) > 1 and not t[1].isdigit():
            return -atom(t[1:])
        return atom(t)

    def atom(t: str):
        if t == "(":
            v = either()
            take(")")
            return v
        up = t.upper()
        if up == "CASE":
            branches = []
            while peek().upper() == "WHEN":
                take()
                test = either()
                take("THEN")
                branches.append((test, either()))
            take("ELSE")
            out = either()
            take("END")
            for test, value in reversed(branches):
                out = np.where(test, value, out)
            return out
        if up == "CAST":
            take("(")
            word = take().strip("'")
            while take() != ")":
                pass
            return float(word)
        if up == "FALSE" or up == "TRUE":
            return up == "TRUE"
        if peek() == "(":
            take("(")
            args = []
            while peek() != ")":
                args.append(either())
                if peek() == ",":
                    take()
            take(")")
            return env[t](*args)
        return env[t] if t in env else float(t)

    return either()


def forward(lon, lat, crs: Crs | str, closed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """project_points for all sixteen; Mollweide's angle is iterated here."""
    c = as_crs(crs)
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if c.name != "mollweide":
        return project_points(lon, lat, c, closed)
    d = lon - c.center_longitude
    lam = np.radians(np.where(closed & (np.abs(d) <= 180), d, np.mod(d + 180, 360) - 180))
    phi = np.radians(lat)
    th = phi.copy()
    with np.errstate(all="ignore"):
        for _ in range(15):
            s = 2 + 2 * np.cos(2 * th)
            th = np.where(s < 1e-15, th, th - (2 * th + np.sin(2 * th) - np.pi * np.sin(phi)) / np.where(s == 0, 1, s))
        th = np.where(np.abs(np.abs(phi) - np.pi / 2) < 1e-9, np.sign(phi) * np.pi / 2, th)
        x, y = 2 * math.sqrt(2) / math.pi * lam * np.cos(th), math.sqrt(2) * np.sin(th)
    bad = np.isnan(lon) | np.isnan(lat)
    return np.where(bad, np.nan, x), np.where(bad, np.nan, y)


def inside(lon, lat, crs: Crs | str, lon_limit, lat_limit) -> np.ndarray:
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    mid, half = (lon_limit[0] + lon_limit[1]) / 2, (lon_limit[1] - lon_limit[0]) / 2
    w = np.mod(lon - mid + 180, 360) - 180
    x, y = forward(lon, lat, crs)
    return np.isfinite(x) & np.isfinite(y) & (lat >= lat_limit[0] - 1e-9) & (lat <= lat_limit[1] + 1e-9) & ((half >= 180 - 1e-9) | (np.abs(w) <= half + 1e-9))


# --- paths -----------------------------------------------------------------------------------------


def _grouped(df: DataFrame, key: list[str], fn, schema: str) -> DataFrame:
    return df.groupBy(*key).applyInPandas(fn, schema)


def clip_paths(paths: DataFrame, crs: Crs | str, lon_limit=(-180.0, 180.0), lat_limit=(-90.0, 90.0), bisect: int = 16) -> DataFrame:
    """path_id, part_id, seq, lon, lat, source: the stretches on the map; a line that leaves gets one more vertex, found by halving, and source is its place between two vertices."""
    c = as_crs(crs)

    @F.pandas_udf("boolean")
    def on_map(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series(inside(lon, lat, c, lon_limit, lat_limit))

    @F.pandas_udf("share double, lon double, lat double")
    def frame(cut: pd.Series, out: pd.Series, lon0: pd.Series, lat0: pd.Series, lon1: pd.Series, lat1: pd.Series) -> pd.DataFrame:
        """Where the segments marked by cut meet the frame, seen from their end on the map (the second where not out)."""
        at = np.flatnonzero(cut.to_numpy(bool))
        ends = [x.to_numpy(float)[at] for x in (lon0, lat0, lon1, lat1)]
        first = out.to_numpy(bool)[at]
        lon, to_lon = np.where(first, ends[0], ends[2]), np.where(first, ends[2], ends[0])
        lat, to_lat = np.where(first, ends[1], ends[3]), np.where(first, ends[3], ends[1])
        d = np.mod(to_lon - lon + 180, 360) - 180
        lo, hi = np.zeros(len(at)), np.ones(len(at))
        for _ in range(bisect if len(at) else 0):
            m = (lo + hi) / 2
            ok = inside(lon + m * d, lat + m * (to_lat - lat), c, lon_limit, lat_limit)
            lo, hi = np.where(ok, m, lo), np.where(ok, hi, m)
        found = np.full((3, len(cut)), np.nan)
        found[:, at] = lo, lon + lo * d, lat + lo * (to_lat - lat)
        return pd.DataFrame({"share": found[0], "lon": found[1], "lat": found[2]})

    w = Window.partitionBy("path_id").orderBy("seq")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    p = paths.select("path_id", "seq", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).withColumn("ok", on_map("lon", "lat"))
    p = p.withColumns({"k": F.row_number().over(w) - 1, "was": F.coalesce(F.lag("ok").over(w), F.lit(False)), "lon0": F.lag("lon").over(w), "lat0": F.lag("lat").over(w)})
    whole = " AND ".join(finite(x) for x in ("lon", "lat", "lon0", "lat0"))  # NULL before the first vertex: no cut
    p = p.withColumn("cut", F.expr(f"ok <> was AND {whole}"))
    p = p.withColumns({"part_id": F.count_if(F.expr("ok AND NOT was")).over(up_to) - 1, "upto": (F.count_if("cut").over(up_to) + F.count_if("ok").over(up_to))})
    p = p.where("cut OR ok").withColumn("at", frame("cut", "was", "lon0", "lat0", "lon", "lat"))
    place = F.expr("CASE WHEN was THEN k - 1 + at.share ELSE k - at.share END")
    met = F.when(F.col("cut"), F.struct(F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"), place.alias("source")))
    own = F.when(F.col("ok"), F.struct("lon", "lat", F.col("k").cast("double").alias("source")))
    p = p.withColumn("vertices", F.array_compact(F.array(met, own))).select("path_id", "part_id", "upto", F.size("vertices").alias("n"), F.posexplode("vertices").alias("pos", "v"))
    return p.select("path_id", F.col("part_id").cast("int").alias("part_id"), (F.col("upto") - F.col("n") + F.col("pos")).alias("seq"), "v.lon", "v.lat", "v.source")


def clip_counts(paths: DataFrame, crs: Crs | str, lon_limit=(-180.0, 180.0), lat_limit=(-90.0, 90.0)) -> DataFrame:
    """path_id, cuts (segments that cross the frame), kept (vertices inside, before the cuts): what clip_paths does to each path, counted natively."""
    x, y = geo.project("lon", "lat", crs, "closed")
    p = paths.select("path_id", "seq", "lon", "lat", F.expr(x).alias("x"), F.expr(y).alias("y"))
    p = p.withColumns({"ok": F.coalesce(F.expr(geo.inside_extent("lon", "lat", lon_limit, lat_limit, "x", "y")), F.lit(False)), "whole": good("lon") & good("lat")})
    w = Window.partitionBy("path_id").orderBy("seq")
    cut = (F.col("ok") != F.lag("ok").over(w)) & F.col("whole") & F.lag("whole").over(w)
    return p.withColumn("cut", F.coalesce(cut, F.lit(False))).groupBy("path_id").agg(F.count_if("cut").alias("cuts"), F.count_if("ok").alias("kept"))


def _densified(lon: np.ndarray, lat: np.ndarray, c: Crs, target: float, densify: bool, max_points: int) -> tuple[np.ndarray, ...]:
    """Halves long segments, then parts the line where a segment stays long however often it is halved (a branch cut)."""
    x, y = forward(lon, lat, c)
    for _ in range(40 if densify else 0):
        d = np.hypot(np.diff(x), np.diff(y))
        ok = np.isfinite(x) & np.isfinite(y)
        wide = np.hypot(np.diff(lon), np.diff(lat)) > 1e-4
        split = np.flatnonzero(wide & ((np.nan_to_num(d, nan=0) > target) | (ok[1:] ^ ok[:-1])))
        if not len(split) or len(lon) + len(split) > max_points:
            break
        lon, lat = np.insert(lon, split + 1, (lon[split] + lon[split + 1]) / 2), np.insert(lat, split + 1, (lat[split] + lat[split + 1]) / 2)
        x, y = forward(lon, lat, c)
    cut = np.zeros(len(x), bool)
    d = np.hypot(np.diff(x), np.diff(y))
    for k in np.flatnonzero(np.isfinite(d) & (d > target)):
        a, b, first = (lon[k], lat[k]), (lon[k + 1], lat[k + 1]), d[k]
        for _ in range(12):
            m = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
            px, py = forward([a[0], m[0], b[0]], [a[1], m[1], b[1]], c)
            h = np.hypot(np.diff(px), np.diff(py))
            if not np.isfinite(h).all():
                break
            a, b = (a, m) if h[0] >= h[1] else (m, b)
            first_now = h.max()
        else:
            cut[k + 1] = first_now >= 0.9 * first
    return lon, lat, x, y, cut


def project_paths(paths: DataFrame, crs: Crs | str, target: float = math.inf, densify: bool = False, max_points: int = 20_000) -> DataFrame:
    """path_id, part_id, seq, lon, lat, x, y; parts end at points off the map and at branch cuts."""
    c = as_crs(crs)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        lon, lat, x, y, cut = _densified(pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float), c, target, densify, max_points)
        ok = np.isfinite(x) & np.isfinite(y)
        starts = ok & (np.concatenate(([True], ~ok[:-1])) | cut)
        part = np.cumsum(starts) - 1
        return pd.DataFrame({"path_id": [pdf["path_id"].iloc[0]] * int(ok.sum()), "part_id": part[ok].astype("int32"), "seq": np.arange(ok.sum()), "lon": lon[ok], "lat": lat[ok], "x": x[ok], "y": y[ok]})

    kind = dict(paths.dtypes)["path_id"]
    return _grouped(paths.select("path_id", "seq", "lon", "lat"), ["path_id"], one, f"path_id {kind}, part_id int, seq long, lon double, lat double, x double, y double")


def clip_half(ring: np.ndarray, at: float, keep_below: bool) -> np.ndarray:
    """The part of a ring on one side of a meridian (Sutherland-Hodgman)."""
    out = []
    for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        a, b = ((at - p[0]), (at - q[0])) if keep_below else ((p[0] - at), (q[0] - at))
        if a >= 0:
            out.append(p)
        if a * b < 0:
            out.append(p + (q - p) * (a / (a - b)))
    return np.array(out).reshape(-1, 2)


def split_rings(rings: DataFrame, lon0: float = 0.0) -> DataFrame:
    """poly_id, part_id, seq, lon, lat: rings unwrapped, cut into strips of one turn around lon0 and shifted back."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        pts = pdf[["lon", "lat"]].to_numpy(float)
        pts = pts[np.isfinite(pts).all(axis=1)]
        out, part = [], 0
        if len(pts) >= 3:
            d = np.diff(pts[:, 0])
            pts[1:, 0] = pts[0, 0] + np.cumsum(d - 360 * np.round(d / 360))
            west = lon0 - 180
            for k in range(math.floor((pts[:, 0].min() - west) / 360), math.floor((pts[:, 0].max() - west) / 360) + 1):
                lo, hi = west + 360 * k + 1e-9, west + 360 * (k + 1) - 1e-9
                r = clip_half(pts, lo, False)
                r = clip_half(r, hi, True) if len(r) else r
                if len(r) >= 3:
                    out += [(part, n, x - 360 * k, y) for n, (x, y) in enumerate(r)]
                    part += 1
        return pd.DataFrame({"poly_id": [pdf["poly_id"].iloc[0]] * len(out), "part_id": [o[0] for o in out], "seq": [o[1] for o in out], "lon": [o[2] for o in out], "lat": [o[3] for o in out]})

    kind = dict(rings.dtypes)["poly_id"]
    return _grouped(rings.select("poly_id", "seq", "lon", "lat"), ["poly_id"], one, f"poly_id {kind}, part_id int, seq long, lon double, lat double")


def rings_with_values(rings: DataFrame, values: DataFrame) -> DataFrame:
    """One value a polygon; a count that differs is an error, as positions would be mixed up."""
    a, b = rings.select("poly_id").distinct(), values.select("poly_id")
    n, m, both = a.count(), b.count(), a.join(b, "poly_id").count()
    if not n == m == both:
        raise GeoError("overlayPolygons:ValueCount", f"{n} polygons, {m} values")
    return rings.join(values, "poly_id")


def visible_rings(rings: DataFrame) -> DataFrame:
    """Polygons with a vertex on the map and three finite ones at least; rings with x and y."""
    ok = good("x") & good("y")
    seen = rings.groupBy("poly_id").agg(F.bool_or(ok).alias("any"), F.count_if(ok).alias("n")).where("any and n >= 3")
    return rings.join(seen.select("poly_id"), "poly_id", "left_semi")


def points_in_rings(points: DataFrame, rings: DataFrame, point: str = "point_id", band: float = 1.0) -> DataFrame:
    """(point, poly_id) of points inside, by the even-odd rule; points on an edge are inside.

    Edges and points meet by latitude band, an equi-join, so no pair of a point and a
    far edge is made; an edge stands in each band it crosses.
    """
    w = Window.partitionBy("poly_id").orderBy("seq")
    e = rings.withColumns({"x2": F.coalesce(F.lead("lon").over(w), F.first("lon").over(w)), "y2": F.coalesce(F.lead("lat").over(w), F.first("lat").over(w))}).withColumnsRenamed({"lon": "x1", "lat": "y1"})
    lo, hi = F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)
    e = e.withColumn("_band", F.explode(F.sequence(lo, hi))).select("poly_id", "x1", "y1", "x2", "y2", "_band")
    p = points.where(good("lon") & good("lat")).withColumn("_band", F.floor(F.col("lat") / band))
    j = p.select(point, "lon", "lat", "_band").join(e, "_band")
    # which side of the edge: the sign of one product decides crossings and edges alike, without a quotient or a tolerance
    side = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("lon") - F.col("x1"))
    up, down = (F.col("y1") <= F.col("lat")) & (F.col("lat") < F.col("y2")), (F.col("y2") <= F.col("lat")) & (F.col("lat") < F.col("y1"))
    j = j.withColumn("_side", side).withColumn("_cross", (up & (F.col("_side") > 0)) | (down & (F.col("_side") < 0)))
    j = j.withColumn("_on", (F.col("_side") == 0) & F.col("lon").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("lat").between(F.least("y1", "y2"), F.greatest("y1", "y2")))
    got = j.where("_cross or _on").groupBy(point, "poly_id").agg(F.count_if("_cross").alias("n"), F.bool_or("_on").alias("on"))
    return got.where("n % 2 = 1 or on").select(point, "poly_id")


# --- contours -----------------------------------------------------------------------------------------


def contour_levels(lo: float, hi: float) -> list[float]:
    if not hi > lo:
        raise GeoError("overlayContours:FlatField")
    return [v for v in nice_ticks(lo, hi) if lo < v < hi]


def contour_segments(grid: DataFrame, levels: list[float]) -> DataFrame:
    """level, i, j, x1, y1, x2, y2: marching squares, one or two segments for each cell and level. Native: corners by window, cases by expression."""
    row, col = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")
    g = grid.select("i", "j", "lon", "lat", "z").withColumns({"lon2": F.lead("lon").over(row), "z10": F.lead("z").over(row)})
    g = g.withColumns({"lat2": F.lead("lat").over(col), "z01": F.lead("z").over(col), "z11": F.lead("z10").over(col)}).where(good("z") & good("z10") & good("z01") & good("z11"))
    g = g.withColumn("level", F.explode(F.array(*map(F.lit, map(float, levels)))))
    b = [F.col(c) >= F.col("level") for c in ("z", "z10", "z11", "z01")]
    case_no = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(b)), F.lit(0))
    g = g.withColumn("_case", case_no).where("_case between 1 and 14")

    def between(a: str, c: str):
        return (F.col("level") - F.col(a)) / F.when(F.col(c) != F.col(a), F.col(c) - F.col(a))

    dx, dy = F.col("lon2") - F.col("lon"), F.col("lat2") - F.col("lat")
    side = {
        "s": F.struct((F.col("lon") + dx * between("z", "z10")).alias("x"), F.col("lat").alias("y")),
        "e": F.struct(F.col("lon2").alias("x"), (F.col("lat") + dy * between("z10", "z11")).alias("y")),
        "n": F.struct((F.col("lon") + dx * between("z01", "z11")).alias("x"), F.col("lat2").alias("y")),
        "w": F.struct(F.col("lon").alias("x"), (F.col("lat") + dy * between("z", "z01")).alias("y")),
    }
    high = (F.col("z") + F.col("z10") + F.col("z11") + F.col("z01")) / 4 >= F.col("level")
    seg = lambda *pairs: F.array(*(F.struct(side[p].alias("a"), side[q].alias("b")) for p, q in pairs))
    table = {1: ["sw"], 2: ["se"], 3: ["we"], 4: ["en"], 6: ["sn"], 7: ["wn"], 8: ["wn"], 9: ["sn"], 11: ["en"], 12: ["we"], 13: ["se"], 14: ["sw"]}
    pick = None
    for n, pairs in table.items():
        cond, val = F.col("_case") == n, seg(*pairs)
        pick = F.when(cond, val) if pick is None else pick.when(cond, val)
    # saddles: the mean of the corners decides which pair is joined
    pick = pick.when(F.col("_case") == 5, F.when(high, seg("se", "wn")).otherwise(seg("sw", "en")))
    pick = pick.when(F.col("_case") == 10, F.when(high, seg("sw", "en")).otherwise(seg("se", "wn")))
    out = g.withColumn("s", F.explode(pick))
    return out.select("level", "i", "j", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")).where("x1 <> x2 or y1 <> y2")


def label_places(lines: DataFrame, spacing: float) -> DataFrame:
    """level, line, seq, x, y of the vertices that carry a contour's number: the first at least ``spacing`` along the line behind the last one, or behind the line's begin or a gap."""
    if not spacing > 0:
        raise GeoError("overlayContours:BadSpacing", spacing)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.isfinite(x) & np.isfinite(y)).astype(int), [0]))))
        picked = []
        for first, stop in zip(edges[::2], edges[1::2], strict=True):
            along = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x[first:stop]), np.diff(y[first:stop])))))
            k = 0
            while (k := int(np.searchsorted(along, along[k] + spacing))) < stop - first:
                picked.append(first + k)
        return pdf.iloc[picked]

    types = dict(lines.dtypes)
    columns = ["level", "line", "seq", "x", "y"]
    return _grouped(lines.select(*columns), ["level", "line"], one, ", ".join(f"{c} {types[c]}" for c in columns))


def chain_segments(segments: DataFrame) -> DataFrame:
    """level, line, seq, lon, lat: segments joined end to end, level by level."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ends: dict[tuple, list[int]] = {}
        exact: dict[tuple, tuple] = {}  # ends meet by nine places; the lines keep what was computed

        def end(x: float, y: float) -> tuple:
            exact.setdefault(key := (round(x, 9), round(y, 9)), (x, y))
            return key

        pts = [(end(r.x1, r.y1), end(r.x2, r.y2)) for r in pdf.sort_values(["i", "j", "x1", "y1"]).itertuples()]
        for k, (a, b) in enumerate(pts):
            ends.setdefault(a, []).append(k)
            ends.setdefault(b, []).append(k)
        used, lines = set(), []

        def follow(start: tuple) -> list[tuple]:
            line = [start]
            while True:
                nxt = next((k for k in ends[line[-1]] if k not in used), None)
                if nxt is None:
                    return line
                used.add(nxt)
                a, b = pts[nxt]
                line.append(b if a == line[-1] else a)

        for p in [p for p, ks in ends.items() if len(ks) == 1] + list(ends):
            if any(k not in used for k in ends[p]):
                lines.append(follow(p))
        rows = [(float(pdf["level"].iloc[0]), n, m, *exact[p]) for n, line in enumerate(lines) for m, p in enumerate(line)]
        return pd.DataFrame(rows, columns=["level", "line", "seq", "lon", "lat"])

    return _grouped(segments, ["level"], one, "level double, line int, seq long, lon double, lat double")


# --- the map's own outline ----------------------------------------------------------------------------


def map_boundary(spark: SparkSession, crs: Crs | str, lon_limit=(-180.0, 180.0), lat_limit=(-90.0, 90.0), per_edge: int = 12) -> DataFrame:
    """seq, lon, lat, x, y: the extent's edge, projected with a closed window; vertices that coincide with the next are dropped."""
    c = as_crs(crs)
    lo, hi = max(lat_limit[0], c.latitude_limit[0]), min(lat_limit[1], c.latitude_limit[1])
    t = np.linspace(0, 1, per_edge, endpoint=False)
    lon = np.concatenate([lon_limit[0] + t * (lon_limit[1] - lon_limit[0]), np.full(per_edge, lon_limit[1]), lon_limit[1] - t * (lon_limit[1] - lon_limit[0]), np.full(per_edge, lon_limit[0])])
    lat = np.concatenate([np.full(per_edge, lo), lo + t * (hi - lo), np.full(per_edge, hi), hi - t * (hi - lo)])
    x, y = forward(lon, lat, c, closed=True)
    ok = np.isfinite(x) & np.isfinite(y)
    lon, lat, x, y = lon[ok], lat[ok], x[ok], y[ok]
    keep = np.hypot(x - np.roll(x, -1), y - np.roll(y, -1)) > 1e-9 if len(x) > 1 else np.ones(len(x), bool)
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(zip(lon[keep], lat[keep], x[keep], y[keep], strict=True))], "seq long, lon double, lat double, x double, y double")


def insert_crossings(df: DataFrame, lon0: float, track: str = "track_id") -> DataFrame:
    """Native variant of clipping for the map's edge meridian: samples with wrapped longitude and the jump marked."""
    w = Window.partitionBy(track).orderBy("seq")
    lon = F.expr(geo.wrap_longitude("lon", num(lon0)))
    return df.withColumn("lon", lon).withColumn("jump", F.coalesce(F.abs(F.col("lon") - F.lag("lon").over(w)) > 180, F.lit(False)))
