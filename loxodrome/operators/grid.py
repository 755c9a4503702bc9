"""Regular grids as rows (i, j, lat, lon, z): axes, subsets, resampling, shading, masks.

Axes are small (thousands of nodes even for a global grid of an arc minute), so they
are read to the driver once and what depends on them alone (brackets, overlaps,
edges) becomes little lookup tables; cells stay distributed and join those by index.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.functions import geo
from loxodrome.functions.sqltext import num
from loxodrome.model import EARTH_RADIUS_KM
from loxodrome.operators.tracks import good

NAN = float("nan")


def axis(df: DataFrame, dim: str) -> np.ndarray:
    """Centres of one axis in index order; dim: lon or lat."""
    k = "j" if dim == "lon" else "i"
    rows = df.groupBy(k).agg(F.min(dim).alias("c"), F.max(dim).alias("c2")).orderBy(k).collect()
    return check_axis(np.array([r["c"] for r in rows], float), dim)


def check_axis(c: np.ndarray, dim: str) -> np.ndarray:
    if c.ndim != 1:
        raise GeoError("grid:NotAVector", dim)
    if len(c) < 2:
        raise GeoError("grid:TooFewPoints", dim)
    if not np.isfinite(c).all():
        raise GeoError("grid:NaNCoordinate", dim)
    d = np.diff(c)
    if not ((d > 0).all() or (d < 0).all()):
        raise GeoError("grid:NonMonotonic", dim)
    if dim == "lat" and np.abs(c).max() > 90 + 1e-9 or dim == "lon" and np.abs(c).max() > 720:
        raise GeoError("grid:AxisNotAngular", dim)
    return c


def axis_step(c: np.ndarray) -> float:
    """The mean step of a uniform axis, the median otherwise."""
    d = np.diff(c)
    m = d.mean()
    return float(m if np.abs(d - m).max() <= 1e-6 * abs(m) else np.median(d))


def is_global(lon: np.ndarray) -> bool:
    return bool(abs(lon[-1] - lon[0]) >= 360 - 1.5 * abs(axis_step(lon)))


def registration(lon: np.ndarray, lat: np.ndarray, declared: str = "auto") -> str:
    """cell or posting, from how the axes span the globe; posting where they say nothing."""
    if declared != "auto":
        return declared

    def infer(c: np.ndarray, full: float) -> str | None:
        s, span = axis_step(c), abs(c[-1] - c[0])
        if s <= 0:
            return None
        return "posting" if abs(span - full) <= 0.01 * s else "cell" if abs(span - (full - s)) <= 0.01 * s else None

    a, b = infer(lon, 360), infer(lat, 180)
    if a and b and a != b:
        raise GeoError("grid:RegistrationAmbiguous", f"{a} {b}")
    return a or b or "posting"


def describe(df: DataFrame) -> dict:
    lon, lat = axis(df, "lon"), axis(df, "lat")
    reg = registration(lon, lat)
    half = 0.5 if reg == "cell" else 0.0
    ends = lambda c: (float(min(c) - half * abs(axis_step(c))), float(max(c) + half * abs(axis_step(c))))
    return {"n_lon": len(lon), "n_lat": len(lat), "lon_step": axis_step(lon), "lat_step": axis_step(lat), "is_global_lon": is_global(lon), "registration": reg, "lon_region": ends(lon), "lat_region": (max(-90.0, ends(lat)[0]), min(90.0, ends(lat)[1]))}


def mesh(spark: SparkSession, lon: list[float], lat: list[float], z: str = "0e0") -> DataFrame:
    """A grid from two axes and an expression over lon and lat."""
    a = spark.createDataFrame([(k, float(v)) for k, v in enumerate(lat)], "i int, lat double")
    b = spark.createDataFrame([(k, float(v)) for k, v in enumerate(lon)], "j int, lon double")
    return a.crossJoin(b).withColumn("z", F.expr(z))


def edges(c: np.ndarray, reg: str = "cell", full: float | None = None) -> np.ndarray:
    """Cell edges: midpoints, and half a step beyond the ends (posting: the ends themselves when they touch the limit)."""
    mid = (c[1:] + c[:-1]) / 2
    e = np.concatenate([[c[0] - (c[1] - c[0]) / 2], mid, [c[-1] + (c[-1] - c[-2]) / 2]])
    return np.clip(e, -full, full) if full else e


def _lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], schema)


def window_indices(c: np.ndarray, lim: tuple[float, float]) -> tuple[int, int]:
    """Indices of nodes in the limits and one neighbour each side; between two nodes, those two."""
    lo, hi = min(lim), max(lim)
    asc = c if c[-1] > c[0] else c[::-1]
    if hi < asc[0] - abs(axis_step(c)) / 2 or lo > asc[-1] + abs(axis_step(c)) / 2:
        raise GeoError("readGrid:RegionOutsideFile", f"{lim}")
    a = max(int(np.searchsorted(asc, lo, "left")) - 1, 0)
    b = min(int(np.searchsorted(asc, hi, "right")), len(asc) - 1)
    return (a, b) if c[-1] > c[0] else (len(c) - 1 - b, len(c) - 1 - a)


def subset(df: DataFrame, lon_limit: tuple[float, float], lat_limit: tuple[float, float]) -> DataFrame:
    """The cells of a region and one neighbour each side; longitudes continue past 180 where the region does. Index filters reach the scan."""
    lon, lat = axis(df, "lon"), axis(df, "lat")
    i0, i1 = window_indices(lat, lat_limit)
    out = df.where(F.col("i").between(i0, i1))
    if lon_limit[1] - lon_limit[0] >= 360:
        return out
    origin = (lon_limit[0] + lon_limit[1]) / 2 - 180
    shifted = origin + np.mod(lon - origin, 360)
    order = np.argsort(shifted, kind="stable")
    a, b = window_indices(shifted[order], lon_limit)
    keep = _lookup(df.sparkSession, [(int(order[k]), k - a, float(shifted[order[k]])) for k in range(a, b + 1)], "j int, _j int, _lon double")
    return out.join(F.broadcast(keep), "j").withColumns({"j": F.col("_j"), "lon": F.col("_lon")}).drop("_j", "_lon").select(*df.columns)


def stride(df: DataFrame, step_i: int, step_j: int) -> DataFrame:
    """Every n-th node; no averaging."""
    if step_i < 1 or step_j < 1:
        raise GeoError("readGrid:BadStride")
    out = df.where((F.pmod("i", F.lit(step_i)) == 0) & (F.pmod("j", F.lit(step_j)) == 0))
    return out.withColumns({"i": (F.col("i") / step_i).cast("int"), "j": (F.col("j") / step_j).cast("int")})


def block_mean(df: DataFrame, f: int) -> DataFrame:
    """Unweighted f x f means; f must divide both axes."""
    top = df.agg(F.max("i"), F.max("j")).first()
    if top[0] is not None and ((top[0] + 1) % f or (top[1] + 1) % f):
        raise GeoError("makeTopographySample:BadFactor", str(f))
    by = [F.floor(F.col("i") / f).cast("int").alias("i"), F.floor(F.col("j") / f).cast("int").alias("j")]
    return df.groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("z").alias("z"))


def _brackets(src: np.ndarray, dst: np.ndarray, nearest: bool) -> list[tuple[int, int, float]]:
    """(target, source, weight): two sources for a target between nodes, one on a node, none outside. src ascending."""
    out = []
    for q, v in enumerate(dst):
        if math.isnan(v) or v < src[0] or v > src[-1]:
            continue
        k = min(int(np.searchsorted(src, v, "right")) - 1, len(src) - 2)
        t = (v - src[k]) / (src[k + 1] - src[k])
        if nearest:
            out.append((q, k + 1 if t >= 0.5 else k, 1.0))
        else:
            out += [(q, k + d, w) for d, w in ((0, 1 - t), (1, t)) if w != 0]
    return out


def regrid(df: DataFrame, lon_q: list[float], lat_q: list[float], method: str = "bilinear") -> DataFrame:
    """df resampled to other axes: i, j, lat, lon, z. Outside the source, and beside a gap, z is NaN."""
    if method not in ("bilinear", "nearest", "conservative"):
        raise GeoError("regrid:BadMethod", method)
    lon, lat = axis(df, "lon"), axis(df, "lat")
    lq, aq = np.asarray(lon_q, float), np.asarray(lat_q, float)
    if method == "conservative":
        return _conservative(df, lon, lat, lq, aq)
    spark = df.sparkSession
    jo = np.argsort(lon, kind="stable")
    cols = [(float(lon[k]), int(k)) for k in jo]
    if is_global(lon):
        s = abs(axis_step(lon))
        cols = [(cols[-1][0] - 360, cols[-1][1]), *cols, (cols[0][0] + 360, cols[0][1])]
        cols = [c for n, c in enumerate(cols) if n == 0 or c[0] - cols[n - 1][0] > s * 1e-6]
    sx = np.array([c[0] for c in cols])
    mid = (sx[0] + sx[-1]) / 2
    wrapped = np.mod(lq - mid + 180, 360) - 180 + mid
    bx = [(q, cols[k][1], w) for q, k, w in _brackets(sx, wrapped, method == "nearest")]
    io = np.argsort(lat, kind="stable")
    by = [(p, int(io[k]), w) for p, k, w in _brackets(lat[io], aq, method == "nearest")]
    x, y = _lookup(spark, bx, "q int, j int, wx double"), _lookup(spark, by, "p int, i int, wy double")
    need = x.groupBy("q").agg(F.count(F.lit(1)).alias("nx")).crossJoin(y.groupBy("p").agg(F.count(F.lit(1)).alias("ny")))
    got = df.select("i", "j", "z").join(y, "i").join(x, "j").groupBy("p", "q").agg(F.sum(F.col("wx") * F.col("wy") * F.col("z")).alias("z"), F.count("z").alias("n"))
    got = got.join(need, ["p", "q"]).where(F.col("n") == F.col("nx") * F.col("ny")).select("p", "q", "z")
    return _on_target(spark, got, lq, aq)


def _on_target(spark: SparkSession, got: DataFrame, lq: np.ndarray, aq: np.ndarray) -> DataFrame:
    target = mesh(spark, list(lq), list(aq)).select("i", "j", "lat", "lon")
    got = got.select(F.col("p").alias("i"), F.col("q").alias("j"), "z")
    return target.join(got, ["i", "j"], "left").withColumn("z", F.coalesce("z", F.lit(NAN)))


def _uniform_edges(c: np.ndarray) -> np.ndarray:
    d = np.diff(c)
    if np.abs(d - d[0]).max() > abs(d[0]) * 1e-9:
        raise GeoError("regrid:NonUniformAxis")
    e = np.concatenate([[c[0] - d[0] / 2], c + d[0] / 2])
    return e


def _overlaps(src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int, float]]:
    """(target, source, shared length) of cells between edges; either axis may descend."""
    out = []
    slo, shi = np.minimum(src[1:], src[:-1]), np.maximum(src[1:], src[:-1])
    for q in range(len(dst) - 1):
        w = np.minimum(shi, max(dst[q], dst[q + 1])) - np.maximum(slo, min(dst[q], dst[q + 1]))
        out += [(q, int(k), float(w[k])) for k in np.flatnonzero(w > 0)]
    return out


def _conservative(df: DataFrame, lon: np.ndarray, lat: np.ndarray, lq: np.ndarray, aq: np.ndarray) -> DataFrame:
    """Means by shared area: longitude by degrees, latitude by its sine; gaps are left out and the rest reweighted. Two sums, rows first."""
    spark = df.sparkSession
    sin = lambda e: np.sin(np.radians(np.clip(e, -90, 90)))
    x = _lookup(spark, _overlaps(_uniform_edges(lon), _uniform_edges(lq)), "q int, j int, wx double")
    y = _lookup(spark, _overlaps(sin(_uniform_edges(lat)), sin(_uniform_edges(aq))), "p int, i int, wy double")
    cells = df.where(good("z")).select("i", "j", "z")
    rows = cells.join(y, "i").groupBy("p", "j").agg(F.sum(F.col("wy") * F.col("z")).alias("sz"), F.sum("wy").alias("sw"))
    got = rows.join(x, "j").groupBy("p", "q").agg(F.sum(F.col("wx") * F.col("sz")).alias("n"), F.sum(F.col("wx") * F.col("sw")).alias("d"))
    return _on_target(spark, got.where("d > 0").select("p", "q", (F.col("n") / F.col("d")).alias("z")), lq, aq)


def mass(df: DataFrame) -> float:
    """Sum of z times area in units of radius squared."""
    lon, lat = axis(df, "lon"), axis(df, "lat")
    e = np.sin(np.radians(_uniform_edges(lat)))
    w = _lookup(df.sparkSession, [(k, float(abs(e[k + 1] - e[k]) * math.radians(abs(axis_step(lon))))) for k in range(len(lat))], "i int, w double")
    return df.where(good("z")).join(w, "i").agg(F.sum(F.col("z") * F.col("w"))).first()[0] or 0.0


def gradients(df: DataFrame, z: str = "topo", radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """gx, gy per metre: 3x3 differences weighted 1-2-1, edges repeated, spacing shrinking with latitude. Two windows, one along each axis."""
    lon, lat = axis(df, "lon"), axis(df, "lat")
    dlon, dlat = math.radians(float(np.median(np.diff(lon)))), math.radians(float(np.median(np.diff(lat))))
    row, col = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")
    mean = df.where(good(z)).agg(F.avg(z).alias("_mean"))
    d = df.crossJoin(F.broadcast(mean)).withColumn("_gap", ~good(z)).withColumn("_z", F.when(F.col("_gap"), F.coalesce("_mean", F.lit(0.0))).otherwise(F.col(z)))
    left, right = F.coalesce(F.lag("_z").over(row), F.col("_z")), F.coalesce(F.lead("_z").over(row), F.col("_z"))
    d = d.withColumns({"_dx": right - left, "_sx": left + 2 * F.col("_z") + right})
    up = lambda c: F.coalesce(F.lag(c).over(col), F.col(c))
    down = lambda c: F.coalesce(F.lead(c).over(col), F.col(c))
    d = d.withColumns({"gx": up("_dx") + 2 * F.col("_dx") + down("_dx"), "gy": down("_sx") - up("_sx")})
    metres = 1000 * radius
    dx = F.abs(metres * F.cos(F.radians("lat")) * dlon)
    return d.withColumns({"gx": F.col("gx") / (8 * F.when(dx > 0, dx)), "gy": F.col("gy") / (8 * metres * dlat)}).drop("_mean", "_z", "_dx", "_sx")


def auto_z_factor(df: DataFrame, z: str = "topo") -> float:
    """Exaggeration that tilts the median slope (of those that are not flat) to thirty degrees."""
    g = gradients(df, z).select(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("g")).where("g > 0").agg(F.percentile("g", F.lit(0.5))).first()[0]
    return math.tan(math.radians(30)) / g if g else 1.0


def lambert_shade(gx: Column, gy: Column, azimuth: float, elevation: float, ambient: float) -> Column:
    slope = F.atan(F.sqrt(gx * gx + gy * gy))
    aspect = F.atan2(-gx, -gy)
    zen = math.radians(90 - elevation)
    c = math.cos(zen) * F.cos(slope) + math.sin(zen) * F.sin(slope) * F.cos(math.radians(azimuth) - aspect)
    return ambient + (1 - ambient) * F.greatest(c, F.lit(0.0))


def hillshade(df: DataFrame, azimuth: float = 315, elevation: float = 45, ambient: float = 0.35, z_factor: float | str = "auto", multi: bool = False, z: str = "topo") -> DataFrame:
    """df with shade; a gap is lit (1). Light follows the compass also on a descending latitude axis."""
    zf = auto_z_factor(df, z) if z_factor == "auto" else float(z_factor)
    g = gradients(df, z)
    gx, gy = F.coalesce(F.col("gx"), F.lit(0.0)) * zf, F.col("gy") * zf
    if multi:
        az = [225, 270, 315, 360]
        w = [math.sin(math.radians(a - azimuth + 90)) ** 2 for a in az]
        shade = sum((k / sum(w)) * lambert_shade(gx, gy, a, elevation, ambient) for k, a in zip(w, az, strict=True))
    else:
        shade = lambert_shade(gx, gy, azimuth, elevation, ambient)
    return g.withColumn("shade", F.when(F.col("_gap"), 1.0).otherwise(shade)).drop("gx", "gy", "_gap")


def roll_to_centre(df: DataFrame, lon0: float) -> DataFrame:
    """Columns renumbered so that the map's edge is 180 degrees from lon0; a repeated meridian goes."""
    lon = axis(df, "lon")
    w = np.mod(lon - lon0 + 180, 360) - 180 + lon0
    order = [int(k) for k in np.argsort(w, kind="stable")]
    tol = abs(axis_step(lon)) * 1e-6
    keep = [k for n, k in enumerate(order) if n == 0 or w[k] - w[order[n - 1]] > tol]
    table = _lookup(df.sparkSession, [(k, n, float(w[k])) for n, k in enumerate(keep)], "j int, _j int, _lon double")
    return df.join(F.broadcast(table), "j").withColumns({"j": F.col("_j"), "lon": F.col("_lon")}).drop("_j", "_lon").select(*df.columns)


def cell_edges(df: DataFrame) -> DataFrame:
    """dim, k, centre, lo_edge, hi_edge of both axes."""
    rows = []
    for dim, full in (("lon", None), ("lat", 90.0)):
        c = axis(df, dim)
        e = edges(c, full=full)
        rows += [(dim, k, float(c[k]), float(e[k]), float(e[k + 1])) for k in range(len(c))]
    return _lookup(df.sparkSession, rows, "dim string, k int, centre double, lo_edge double, hi_edge double")


def mask(df: DataFrame, method: str = "threshold", threshold: float | None = None, inside: str | None = None, side: str = "outside", explicit: DataFrame | None = None) -> DataFrame:
    """df with masked: below a threshold, inside or outside an outline (``inside``: an expression), or where a mask table says so."""
    if method == "threshold":
        if threshold is None:
            raise GeoError("basemap:MaskMethodMismatch", method)
        return df.withColumn("masked", F.coalesce(F.col("z") < threshold, F.lit(False)) & ~F.isnan("z"))
    if method == "polygon":
        if inside is None:
            raise GeoError("basemap:MaskMethodMismatch", method)
        test = F.expr(inside)
        return df.withColumn("masked", test if side == "inside" else ~test)
    if explicit is None:
        raise GeoError("basemap:MaskMethodMismatch", method)
    return df.join(explicit.select("i", "j", F.col("masked").alias("_m")), ["i", "j"], "left").withColumn("masked", F.coalesce("_m", F.lit(False))).drop("_m")


def mask_verdict(df: DataFrame) -> DataFrame:
    """Whether the mask covers everything, or nothing."""
    return df.agg(F.bool_and("masked").alias("covers_everything"), (~F.bool_or("masked")).alias("covers_nothing"), F.count_if("masked").alias("n_masked"))


def stipple_dots(df: DataFrame, density: int = 2000) -> DataFrame:
    """Every n-th cell of a mask (z neither 0 nor NaN), column by column, n chosen for about ``density`` dots.

    Ranks come from counts per column, so no window spans the whole grid.
    """
    m = df.where((F.col("z") != 0) & good("z"))
    per = m.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each column
    total = per.agg(F.sum("n")).first()[0] or 0
    every = max(1, math.ceil(total / density))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("j").orderBy("i")) - 1
    return m.join(before.select("j", "_before"), "j").withColumn("_rank", rank).where(F.pmod("_rank", F.lit(every)) == 0).drop("_before", "_rank")


def stipple_hatch(df: DataFrame, spacing: float, angle: float = 45.0) -> DataFrame:
    """Masked cells (x, y) gathered to parallel lines; a gap over 1.5 typical steps ends a stroke. line, stroke, x0, y0, x1, y1."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    m = df.where((F.col("z") != 0) & good("z") & good("x") & good("y")).withColumns({"_u": F.col("x") * c + F.col("y") * s, "_v": F.col("y") * c - F.col("x") * s})
    low = m.agg(F.min("_v").alias("_v0"))
    m = m.crossJoin(F.broadcast(low)).withColumn("line", F.round((F.col("_v") - F.col("_v0")) / spacing).cast("int"))
    w = Window.partitionBy("line").orderBy("_u")
    m = m.withColumn("_du", F.col("_u") - F.lag("_u").over(w))
    step = m.where("_du > 0").agg(F.percentile("_du", F.lit(0.5)).alias("_step"))
    m = m.crossJoin(F.broadcast(step)).withColumn("stroke", F.sum(F.when(F.col("_du") > 1.5 * F.greatest("_step", F.lit(spacing)), 1).otherwise(0)).over(w))
    return m.groupBy("line", "stroke").agg(F.min_by("x", "_u").alias("x0"), F.min_by("y", "_u").alias("y0"), F.max_by("x", "_u").alias("x1"), F.max_by("y", "_u").alias("y1"))


def background(df: DataFrame, lon_limit: tuple[float, float], lat_limit: tuple[float, float], target: int = 300) -> DataFrame:
    """A backdrop resampled to the extent: the longer side has ``target`` cells, and never finer than the source."""
    lon, lat = axis(df, "lon"), axis(df, "lat")
    w, h = lon_limit[1] - lon_limit[0], lat_limit[1] - lat_limit[0]
    n_lon = max(2, min(round(target * w / max(w, h)), math.ceil(w / abs(axis_step(lon)))))
    n_lat = max(2, min(round(target * h / max(w, h)), math.ceil(h / abs(axis_step(lat)))))
    return regrid(df, list(np.linspace(*lon_limit, n_lon)), list(np.linspace(*lat_limit, n_lat)))


def wrapped_column(lon0: float) -> Column:
    return F.expr(geo.wrap_longitude("lon", num(lon0)))
