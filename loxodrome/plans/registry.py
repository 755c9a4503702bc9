"""One query for each operator, and the SQL another engine answers it with.

Coordinates come from ``events`` by whole-number arithmetic (sources.base), so both
engines start from the same doubles.  Floating results are rounded to six places.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.functions import geo, ticks
from loxodrome.functions.sqltext import rounded
from loxodrome.model import PRESETS, PROJECTIONS, Crs, Region
from loxodrome.operators import color, fields, geometry, grid, projection, tracks
from loxodrome.plans import options, scene
from loxodrome.sources import base, coastline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

POINTS = base.points_sql("duckdb")
TRACK = base.track_sql("duckdb")
GRID = base.grid_sql()


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return put


def r6(df: DataFrame, *keep: str, **values: str) -> DataFrame:
    return df.selectExpr(*keep, *(f"{rounded(v)} AS {k}" for k, v in values.items()))


def r6_sql(source: str, *keep: str, **values: str) -> str:
    return f"SELECT {', '.join([*keep, *(f'{rounded(v)} AS {k}' for k, v in values.items())])} FROM ({source})"


def scalar(name: str, make, where: str = "true") -> None:
    """A query over points: ``make(dialect)`` gives the named expressions."""
    QUERIES[name] = lambda spark, d: r6(base.points(spark, d).where(where), "event_id", **make("spark"))
    ORACLES[name] = r6_sql(f"SELECT * FROM ({POINTS}) WHERE {where}", "event_id", **make("duckdb"))


# --- longitudes, great circles, projections -----------------------------------------------------------

PARIS, NEW_YORK = ("2.3522e0", "48.8566e0"), ("(-74.006e0)", "40.7128e0")


@query("great_circle", f"SELECT event_type, count(*) AS n, {rounded('avg(km)')} AS mean_km, {rounded('max(km)')} AS max_km, {rounded('avg(y)')} AS mean_y FROM (SELECT event_type, {geo.great_circle_km('lon', 'lat', *PARIS)} AS km, {geo.project('lon', 'lat', 'mercator', dialect='duckdb')[1]} AS y FROM ({POINTS}) WHERE abs(lat) <= 85e0) GROUP BY event_type")
def great_circle(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: distance from a fixed point and Mercator ordinate, by event type."""
    p = base.points(spark, d).withColumn("km", F.expr(geo.great_circle_km("lon", "lat", *PARIS)))
    p = projection.project(projection.domain_filter(p, "mercator"), "mercator")
    return r6(p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("km").alias("a"), F.max("km").alias("b"), F.avg("y").alias("c")), "event_type", "n", mean_km="a", max_km="b", mean_y="c")


scalar("wrap_longitude", lambda d: {"wrapped": geo.wrap_longitude("(lon * 3e0)", "30e0")})
scalar("wrap_longitude_closed", lambda d: {"wrapped": geo.wrap_longitude("(lon * 3e0)", "30e0", "closed")})
scalar("great_circle_bearings", lambda d: dict(zip(("initial", "final"), geo.bearings("lon", "lat", *NEW_YORK), strict=True)), "abs(lat) < 89e0")
scalar("great_circle_destination", lambda d: dict(zip(("lon2", "lat2"), geo.destination("lon", "lat", "(obs * 3.6e0)", "(500e0 + obs)"), strict=True)), "NOT isnan(obs) AND abs(lat) < 85e0 AND abs(lon) < 170e0")


def sample_crs(name: str) -> Crs:
    oblique = name in ("lambert", "stereographic", "orthographic", "azimuthalequidistant", "gnomonic")
    conic = name in ("lambertconformal", "albers")
    return Crs(
        name, center_longitude=-96.0 if conic else 20.0, center_latitude=40.0 if oblique else 23.0 if conic else math.nan,
        standard_parallel={"lambertconformal": 33.0, "albers": 29.5, "polarstereographic": 71.0}.get(name, math.nan), standard_parallel2={"lambertconformal": 45.0, "albers": 45.5}.get(name, math.nan),
    )


for _name in PROJECTIONS:
    _c = sample_crs(_name)
    scalar(f"project_{_name}", lambda d, c=_c: dict(zip("xy", geo.project("lon", "lat", c, dialect=d), strict=True)))
    QUERIES[f"project_{_name}"] = lambda spark, d, c=_c: r6(projection.project(base.points(spark, d), c), "event_id", x="x", y="y")

    def _back(spark, d, c=_c):
        p = projection.project(base.points(spark, d), c).where("NOT isnan(x)").select("event_id", "x", "y")
        return r6(projection.unproject(p, c), "event_id", lon="lon", lat="lat")

    QUERIES[f"unproject_{_name}"] = _back
    if _name != "winkeltripel":
        _x, _y = geo.project("lon", "lat", _c, dialect="duckdb")
        _lon, _lat = geo.unproject("x", "y", _c, "duckdb")
        ORACLES[f"unproject_{_name}"] = r6_sql(f"SELECT event_id, {_lon} AS lon, {_lat} AS lat FROM (SELECT event_id, {_x} AS x, {_y} AS y FROM ({POINTS})) WHERE NOT isnan(x)", "event_id", lon="lon", lat="lat")
    else:  # the round trip is the identity but for whole turns, which SQL can say: longitudes from half a turn west of the centre on
        ORACLES[f"unproject_{_name}"] = r6_sql(f"SELECT event_id, CASE WHEN lon < -160e0 THEN lon + 360e0 ELSE lon END AS lon, lat FROM ({POINTS})", "event_id", lon="lon", lat="lat")


@query("cone_constants")
def cone_constants(spark, d):
    rows = [(n, p1, p2, Crs(n, standard_parallel=p1, standard_parallel2=p2).cone_constant) for n in ("lambertconformal", "albers") for p1, p2 in ((33.0, 45.0), (29.5, 45.5), (40.0, 40.0), (-20.0, -50.0))]
    return r6(spark.createDataFrame(rows, "name string, p1 double, p2 double, n double"), "name", "p1", "p2", n="n")


_RAD = "pi() / 180e0"
ORACLES["cone_constants"] = r6_sql(f"""SELECT name, p1, p2, CASE WHEN name = 'albers' THEN (sin(p1 * {_RAD}) + sin(p2 * {_RAD})) / 2 WHEN p1 = p2 THEN sin(p1 * {_RAD})
  ELSE ln(cos(p1 * {_RAD}) / cos(p2 * {_RAD})) / ln(tan(pi() / 4 + p2 * {_RAD} / 2) / tan(pi() / 4 + p1 * {_RAD} / 2)) END AS n
  FROM (VALUES ('lambertconformal'), ('albers')) t(name), (VALUES (33e0, 45e0), (29.5e0, 45.5e0), (40e0, 40e0), (-20e0, -50e0)) u(p1, p2)""", "name", "p1", "p2", n="n")


@query("crs_domain_filter", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (abs(lat) <= 85e0) AS BIGINT) AS on_mercator, CAST(count(*) FILTER ({geo.great_circle_km('lon', 'lat', '20e0', '40e0', 1.0)} * 180e0 / pi() <= 90e0) AS BIGINT) AS on_orthographic FROM ({POINTS})")
def crs_domain_filter(spark, d):
    p = base.points(spark, d)
    m, _ = geo.project("lon", "lat", "mercator")
    o, _ = geo.project("lon", "lat", sample_crs("orthographic"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(f"NOT isnan({m})")).alias("on_mercator"), F.count_if(F.expr(f"NOT isnan({o})")).alias("on_orthographic"))


@query("crs_catalog")
def crs_catalog(spark, d):
    rows = [tuple(sample_crs(n).domain()[k] for k in ("name", "family", "is_whole_world", "max_distance", "singular_at", "clip_is_cosmetic", "lat_min", "lat_max")) for n in PROJECTIONS]
    return spark.createDataFrame(rows, "name string, family string, is_whole_world boolean, max_distance double, singular_at double, clip_is_cosmetic boolean, lat_min double, lat_max double")


def _scale_factor_sql() -> str:
    s = f"SELECT event_id, lon, lat FROM ({POINTS})"
    for st in projection.scale_factor_stages(sample_crs("robinson"), "duckdb"):
        keep = "event_id" if "omega" in st else "event_id, lon, lat"
        s = f"SELECT {keep}, {', '.join(f'{v} AS {k}' for k, v in st.items())} FROM ({s})"
    return s


@query("scale_factors", f"SELECT event_id, {rounded('h', 4)} AS h, {rounded('k', 4)} AS k, {rounded('area_scale', 4)} AS area_scale FROM ({_scale_factor_sql()})")
def scale_factors(spark, d):
    p = base.points(spark, d)
    s = projection.scale_factors(p, sample_crs("robinson"))
    return s.selectExpr("event_id", *(f"{rounded(c, 4)} AS {c}" for c in ("h", "k", "area_scale")))


scalar("format_lonlat", lambda d: {})
QUERIES["format_lonlat"] = lambda spark, d: base.points(spark, d).selectExpr("event_id", f"{geo.format_lon('lon')} AS lon_text", f"{geo.format_lat('lat')} AS lat_text")
ORACLES["format_lonlat"] = f"SELECT event_id, {geo.format_lon('lon', 'duckdb')} AS lon_text, {geo.format_lat('lat', 'duckdb')} AS lat_text FROM ({POINTS})"


@query("mesh_cross", r6_sql("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, -80e0 + 20e0 * i AS lat, -170e0 + 20e0 * j AS lon, (-80e0 + 20e0 * i) * (-170e0 + 20e0 * j) AS z FROM range(9) a(i), range(18) b(j)", "i", "j", lat="lat", lon="lon", z="z"))
def mesh_cross(spark, d):
    return r6(grid.mesh(spark, list(range(-170, 180, 20)), list(range(-80, 90, 20)), "lon * lat"), "i", "j", lat="lat", lon="lon", z="z")


# --- statistics -----------------------------------------------------------------------------------------

_OK = "NOT isnan(obs)"


@query("quantile", f"SELECT event_type, {', '.join(f'{rounded(f"quantile_cont(obs, {p / 100})")} AS q{p}' for p in (2, 25, 50, 98))} FROM ({POINTS}) WHERE {_OK} GROUP BY event_type")
def quantile(spark, d):
    return r6(fields.quantile(base.points(spark, d), "obs", [2, 25, 50, 98], ["event_type"]), "event_type", **{f"q{p}": f"q{p}" for p in (2, 25, 50, 98)})


def _lim(name: str, fn, sql: str) -> None:
    QUERIES[name] = lambda spark, d: r6(fn(base.points(spark, d)), lo="lo", hi="hi")
    ORACLES[name] = r6_sql(sql, lo="lo", hi="hi")


_lim("symmetric_limits", lambda p: fields.symmetric_limits(p, "obs"), f"SELECT -q AS lo, q AS hi FROM (SELECT quantile_cont(abs(obs), 0.98) AS q FROM ({POINTS}) WHERE {_OK})")
_lim("value_limits", lambda p: fields.value_limits(p, "obs"), f"SELECT min(obs) AS lo, max(obs) AS hi FROM ({POINTS}) WHERE {_OK}")
_lim("percentile_limits", lambda p: fields.percentile_limits(p, "obs"), f"SELECT quantile_cont(obs, 0.02) AS lo, quantile_cont(obs, 0.98) AS hi FROM ({POINTS}) WHERE {_OK}")
_lim("percentile_limits_compat", lambda p: fields.percentile_limits(p, "obs", compat=True), f"SELECT quantile_cont(obs, 0.0002) AS lo, quantile_cont(obs, 0.0098) AS hi FROM ({POINTS}) WHERE {_OK}")
_lim("shared_limits", lambda p: fields.shared_limits([p.where("lat > 0"), p.where("lon > 90")], "obs"), f"SELECT quantile_cont(obs, 0.02) AS lo, quantile_cont(obs, 0.98) AS hi FROM (SELECT obs FROM ({POINTS}) WHERE lat > 0 UNION ALL SELECT obs FROM ({POINTS}) WHERE lon > 90) WHERE {_OK}")


@query("bounding_box", r6_sql(f"SELECT event_type, min(lon) - 0.05e0 * (max(lon) - min(lon)) AS w, max(lon) + 0.05e0 * (max(lon) - min(lon)) AS e, greatest(-90e0, min(lat) - 0.05e0 * (max(lat) - min(lat))) AS s, least(90e0, max(lat) + 0.05e0 * (max(lat) - min(lat))) AS n FROM ({POINTS}) GROUP BY event_type", "event_type", west="w", east="e", south="s", north="n"))
def bounding_box(spark, d):
    return r6(fields.bounding_box(base.points(spark, d), by=["event_type"]), "event_type", west="west", east="east", south="south", north="north")


@query("range_flags", f"SELECT bool_or(obs < 5e0) AS has_under, bool_or(obs > 1e6) AS has_over FROM ({POINTS}) WHERE {_OK}")
def range_flags(spark, d):
    return fields.range_flags(base.points(spark, d), "obs", 5.0, 1e6)


@query("colorbar_caps", f"""SELECT 'low' AS side, 0e0 AS at_end, -10e0 AS tip FROM ({POINTS}) WHERE {_OK} HAVING min(obs) < 5e0 UNION ALL SELECT 'high', 200e0, 210e0 FROM ({POINTS}) WHERE {_OK} HAVING max(obs) > 60e0""")
def colorbar_caps(spark, d):
    return fields.end_caps(fields.range_flags(base.points(spark, d), "obs", 5.0, 60.0), 200.0).withColumnRenamed("at", "at_end")


@query("marker_area", r6_sql(f"SELECT event_id, CASE WHEN isnan(obs) THEN 36e0 ELSE 16e0 + (obs - lo) / (hi - lo) * 384e0 END AS area FROM ({POINTS}), (SELECT min(obs) AS lo, max(obs) AS hi FROM ({POINTS}) WHERE {_OK})", "event_id", area="area"))
def marker_area(spark, d):
    return r6(fields.marker_areas(base.points(spark, d), "obs"), "event_id", area="area")


@query("legend_values", r6_sql(f"""WITH m AS (SELECT min(obs) AS lo, max(obs) AS hi FROM ({POINTS}) WHERE {_OK}),
  d AS (SELECT lo, hi, (hi - lo) / 6 AS ideal, pow(10e0, floor(log10((hi - lo) / 6))) AS dec FROM m),
  s AS (SELECT lo, hi, dec * CASE WHEN dec >= ideal THEN 1 WHEN 2 * dec >= ideal THEN 2 WHEN 5 * dec >= ideal THEN 5 ELSE 10 END AS step FROM d)
  SELECT k * step AS value FROM s, range(-1000, 1000) r(k) WHERE k * step >= lo AND k * step <= hi""", value="value"))
def legend_values(spark, d):
    lo, hi = fields.value_limits(base.points(spark, d), "obs").first()
    return r6(spark.createDataFrame([(float(v),) for v in ticks.nice_ticks(lo, hi)], "value double"), value="value")


def _tick_rows(spark, kind: str, values) -> DataFrame:
    return r6(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double"), "k", value="v")


@query("nice_ticks", r6_sql("SELECT CAST(i AS INT) AS k, -40e0 + 20e0 * i AS v FROM range(7) t(i)", "k", value="v"))
def nice_ticks(spark, d):
    return _tick_rows(spark, "linear", ticks.nice_ticks(-42.0, 93.0, target=7))


@query("graticule_ticks", r6_sql("SELECT CAST(i AS INT) AS k, -180e0 + 90e0 * i AS v FROM range(5) t(i)", "k", value="v"))
def graticule_ticks(spark, d):
    return _tick_rows(spark, "graticule", ticks.nice_ticks(-180.0, 180.0, "graticule", 4))


@query("colorbar_ticks", r6_sql("SELECT CASE WHEN i % 4 = 0 THEN 'main' ELSE 'minor' END AS kind, -100e0 + 12.5e0 * i AS v FROM range(17) t(i)", "kind", value="v"))
def colorbar_ticks(spark, d):
    main, minor = ticks.colorbar_ticks(-100.0, 100.0)
    return r6(spark.createDataFrame([("main", float(v)) for v in main] + [("minor", float(v)) for v in minor], "kind string, v double"), "kind", value="v")


# --- regions and polygons ---------------------------------------------------------------------------------


@query("region_presets", f"SELECT * FROM (VALUES {', '.join(f"('{k}', {', '.join(f'{float(x)}e0' for x in v)})" for k, v in PRESETS.items())}) t(name, west, east, south, north)")
def region_presets(spark, d):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in PRESETS.items()], "name string, west double, east double, south double, north double")


@query("region_box_filter", f"SELECT event_id FROM ({POINTS}) WHERE lon >= -25 AND lon <= 45 AND lat >= 34 AND lat <= 72")
def region_box_filter(spark, d):
    return base.points(spark, d).where(projection.in_region(Region.preset("Europe"))).select("event_id")


TRIANGLE = [(-60.0, -50.0), (70.0, -20.0), (10.0, 65.0)]
_EDGE = lambda a, b: f"(({b[0]} - {a[0]}) * (lat - ({a[1]})) - ({b[1]} - {a[1]}) * (lon - ({a[0]})) >= 0)"
_IN_TRIANGLE = " AND ".join(_EDGE(a, b).replace("- -", "+ ") for a, b in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]], strict=True))


def _rings(spark, parts: dict[int, list]) -> DataFrame:
    return spark.createDataFrame([(p, k, float(x), float(y)) for p, pts in parts.items() for k, (x, y) in enumerate(pts)], "poly_id int, seq long, lon double, lat double")


@query("polygon_filter", f"SELECT event_id FROM ({POINTS}) WHERE {_IN_TRIANGLE}")
def polygon_filter(spark, d):
    return geometry.points_in_rings(base.points(spark, d), _rings(spark, {1: TRIANGLE}), "event_id").select("event_id")


@query("polygon_outside", f"SELECT event_id FROM ({POINTS}) WHERE NOT ({_IN_TRIANGLE})")
def polygon_outside(spark, d):
    p = base.points(spark, d)
    return p.join(geometry.points_in_rings(p, _rings(spark, {1: TRIANGLE}), "event_id"), "event_id", "left_anti").select("event_id")


@query("polygon_predicate", f"SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM ({POINTS}) WHERE {_IN_TRIANGLE} GROUP BY event_type")
def polygon_predicate(spark, d):
    return base.points(spark, d).where(projection.in_polygon([TRIANGLE])).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("polygon_values", f"SELECT n.n_nationkey AS poly_id, {rounded('sum(c.c_acctbal)')} AS value, CAST(4 AS BIGINT) AS vertices FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey")
def polygon_values(spark, d):
    """A box for each nation, valued by its customers' balances."""
    n = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey AS poly_id", "n_nationkey * 10e0 - 170e0 AS x")
    v = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("poly_id")).agg(F.sum("c_acctbal").alias("value"))
    n = n.join(v.select("poly_id"), "poly_id", "left_semi")
    rings = n.select("poly_id", F.posexplode(F.expr("transform(array(0, 1, 2, 3), k -> named_struct('lon', x + CASE WHEN k IN (1, 2) THEN 8e0 ELSE 0e0 END, 'lat', CASE WHEN k > 1 THEN 5e0 ELSE -5e0 END))")).alias("seq", "p")).selectExpr("poly_id", "CAST(seq AS LONG) AS seq", "p.lon AS lon", "p.lat AS lat")
    out = geometry.rings_with_values(rings, v)
    return r6(out.groupBy("poly_id").agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("vertices")), "poly_id", "vertices", value="v")


@query("polygon_seam_split")
def polygon_seam_split(spark, d):
    out = geometry.split_rings(_rings(spark, {1: [(170, -10), (-170, -10), (-170, 10), (170, 10)], 2: [(0, 0), (10, 0), (5, 8)]}))
    return r6(out, "poly_id", "part_id", "seq", lon="lon", lat="lat")


# --- tracks ---------------------------------------------------------------------------------------------

_SPLIT_SQL = """WITH t AS ({track}), d AS (SELECT *, {brk} AS b FROM (SELECT *, {lags} FROM t)), s AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS g FROM d),
 n AS (SELECT *, count(*) OVER (PARTITION BY track_id, g) AS c FROM s), k AS (SELECT track_id, seq, dense_rank() OVER (PARTITION BY track_id ORDER BY g) AS pass_id FROM n WHERE c >= {least})
 SELECT t.track_id, t.seq, CAST(coalesce(k.pass_id, 0) AS INT) AS pass_id FROM t LEFT JOIN k USING (track_id, seq)"""
_LAGS = "time - lag(time) OVER w AS dt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lag(grp) OVER w AS pgrp FROM t WINDOW w AS (PARTITION BY track_id ORDER BY seq)"


def _split_sql(brk: str, least: int = 2, track: str = TRACK) -> str:
    return _SPLIT_SQL.format(track=track, brk=f"coalesce({brk}, false)", lags=_LAGS, least=least).replace("FROM t WINDOW w AS (PARTITION BY track_id ORDER BY seq) FROM t)", "FROM t WINDOW w AS (PARTITION BY track_id ORDER BY seq))")


def _split(name: str, brk: str, least: int = 2, track: str = TRACK, **kw) -> None:
    ORACLES[name] = _split_sql(brk, least, track)
    QUERIES[name] = lambda spark, d: tracks.split_tracks(base.track(spark, d), min_points=least, **kw).selectExpr("track_id", "seq", "coalesce(pass_id, 0) AS pass_id")


_split("split_tracks_time", "dt > 5 * (SELECT quantile_cont(u.dt, 0.5) FROM (SELECT track_id AS tid, time - lag(time) OVER (PARTITION BY track_id ORDER BY seq) AS dt FROM t) u WHERE u.dt > 0 AND u.tid = track_id)")
ORACLES["split_tracks_time"] = f"""WITH t AS ({TRACK}), d0 AS (SELECT *, time - lag(time) OVER (PARTITION BY track_id ORDER BY seq) AS dt FROM t), m AS (SELECT track_id, 5 * quantile_cont(dt, 0.5) AS lim FROM d0 WHERE dt > 0 GROUP BY track_id),
 s AS (SELECT d0.track_id, seq, sum(CASE WHEN dt > lim THEN 1 ELSE 0 END) OVER (PARTITION BY d0.track_id ORDER BY seq) AS g FROM d0 LEFT JOIN m USING (track_id)),
 n AS (SELECT *, count(*) OVER (PARTITION BY track_id, g) AS c FROM s), k AS (SELECT track_id, seq, dense_rank() OVER (PARTITION BY track_id ORDER BY g) AS pass_id FROM n WHERE c >= 2)
 SELECT t.track_id, t.seq, CAST(coalesce(k.pass_id, 0) AS INT) AS pass_id FROM t LEFT JOIN k USING (track_id, seq)"""
_split("split_tracks_fixed", "dt > 86400e0", time_gap="86400")
_split("split_tracks_space", f"{geo.great_circle_km('plon', 'plat', 'lon', 'lat')} > 12000e0", time_gap=None, spatial_jump_km=12000.0)
_split("split_tracks_group", "grp <> pgrp", group="grp")
_split("split_tracks_minpoints", "dt > 43200e0", 4, time_gap="43200")


@query("split_tracks_region", f"""WITH t AS ({TRACK}), p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS pos FROM t), r AS (SELECT * FROM p WHERE lon >= -120 AND lon <= 150 AND lat >= -60 AND lat <= 75),
 s AS (SELECT track_id, seq, sum(CASE WHEN pos - ppos > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS g FROM (SELECT *, lag(pos) OVER (PARTITION BY track_id ORDER BY seq) AS ppos FROM r)),
 n AS (SELECT *, count(*) OVER (PARTITION BY track_id, g) AS c FROM s), k AS (SELECT track_id, seq, dense_rank() OVER (PARTITION BY track_id ORDER BY g) AS pass_id FROM n WHERE c >= 2)
 SELECT t.track_id, t.seq, CAST(coalesce(k.pass_id, 0) AS INT) AS pass_id FROM t LEFT JOIN k USING (track_id, seq)""")
def split_tracks_region(spark, d):
    return tracks.split_tracks(base.track(spark, d), time_gap=None, region=Region("r", (-120, 150), (-60, 75))).selectExpr("track_id", "seq", "coalesce(pass_id, 0) AS pass_id")


@query("split_tracks_forced", f"""WITH t AS ({TRACK}), s AS (SELECT track_id, seq, time, sum(CASE WHEN dt > 86400e0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS g FROM (SELECT *, time - lag(time) OVER (PARTITION BY track_id ORDER BY seq) AS dt FROM t)),
 c AS (SELECT *, floor((time - first_value(time) OVER v) / 172800e0) AS ch, row_number() OVER v AS rn FROM s WINDOW v AS (PARTITION BY track_id, g ORDER BY seq)),
 f AS (SELECT *, CASE WHEN coalesce(ch <> lag(ch) OVER v, false) OR (rn > 1 AND (rn - 1) % 5 = 0) THEN 1 ELSE 0 END AS fb FROM c WINDOW v AS (PARTITION BY track_id, g ORDER BY seq)),
 h AS (SELECT track_id, seq, g + sum(fb) OVER (PARTITION BY track_id ORDER BY seq) AS g FROM f), n AS (SELECT *, count(*) OVER (PARTITION BY track_id, g) AS c FROM h),
 k AS (SELECT track_id, seq, dense_rank() OVER (PARTITION BY track_id ORDER BY g) AS pass_id FROM n WHERE c >= 2) SELECT t.track_id, t.seq, CAST(coalesce(k.pass_id, 0) AS INT) AS pass_id FROM t LEFT JOIN k USING (track_id, seq)""")
def split_tracks_forced(spark, d):
    return tracks.split_tracks(base.track(spark, d), time_gap="86400", max_duration=172800.0, max_points=5).selectExpr("track_id", "seq", "coalesce(pass_id, 0) AS pass_id")


@query("track_breaks", f"""WITH k AS (SELECT * FROM ({ORACLES['split_tracks_fixed']}) WHERE pass_id > 0), t AS ({TRACK})
 SELECT track_id, pass_id, seq, CAST(0 AS INT) AS after, {rounded('lon')} AS lon FROM k JOIN t USING (track_id, seq)
 UNION ALL SELECT track_id, pass_id, max(seq), 1, NULL FROM k JOIN (SELECT track_id, max(pass_id) AS last FROM k GROUP BY track_id) l USING (track_id) WHERE pass_id < last GROUP BY track_id, pass_id""")
def track_breaks(spark, d):
    return r6(tracks.with_breaks(tracks.split_tracks(base.track(spark, d), time_gap="86400")), "track_id", "pass_id", "seq", "after", lon="lon")


@query("count_gaps", f"SELECT track_id, CAST(sum(CASE WHEN isnan(obs) AND NOT coalesce(p, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps FROM (SELECT track_id, obs, isnan(lag(obs) OVER (PARTITION BY track_id ORDER BY seq)) AS p FROM ({TRACK})) GROUP BY track_id")
def count_gaps(spark, d):
    return tracks.count_gaps(base.track(spark, d), "obs")


@query("track_runs", f"""SELECT track_id, CAST(dense_rank() OVER (PARTITION BY track_id ORDER BY g) AS INT) AS run_id, seq FROM (SELECT track_id, seq, obs, sum(CASE WHEN isnan(obs) THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS g FROM ({TRACK})) WHERE NOT isnan(obs)""")
def track_runs(spark, d):
    return tracks.runs(base.track(spark, d), ["obs"]).select("track_id", "run_id", "seq")


_AM = f"""WITH t AS ({TRACK}), l AS (SELECT *, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM t WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
 j AS (SELECT *, coalesce(abs(nlon - lon) > 180, false) AS jump, {geo.wrap_longitude('(nlon - lon)')} AS d FROM l),
 p AS (SELECT *, coalesce(sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, sign(d) * 180 AS edge, CASE WHEN d = 0 THEN 0 ELSE least(greatest((sign(d) * 180 - lon) / d, 0), 1) END AS f FROM j)"""


@query("split_antimeridian", _AM + f"""SELECT track_id, seq, CAST(0 AS INT) AS sub, CAST(part AS BIGINT) AS part_id, {rounded('lon')} AS lon, {rounded('lat')} AS lat FROM p
 UNION ALL SELECT track_id, seq, 1, CAST(part AS BIGINT), {rounded('edge')}, {rounded('(lat + f * (nlat - lat))')} FROM p WHERE jump UNION ALL SELECT track_id, seq, 2, CAST(part + 1 AS BIGINT), {rounded('(-edge)')}, {rounded('(lat + f * (nlat - lat))')} FROM p WHERE jump""")
def split_antimeridian(spark, d):
    # a latitude is rounded as the other engine does it, by a product: a decimal round differs where that product ends in one half
    out = r6(tracks.split_antimeridian(base.track(spark, d)), "track_id", "seq", "sub", "part_id", lon="lon", v="sign(lat) * floor(abs(lat) * 1e6 + 0.5e0) / 1e6")
    return out.withColumnRenamed("v", "lat")


@query("split_antimeridian_break", _AM + f"SELECT track_id, seq, CAST(part AS BIGINT) AS part_id, {rounded('lon')} AS lon FROM p")
def split_antimeridian_break(spark, d):
    return r6(tracks.split_antimeridian(base.track(spark, d), mode="break"), "track_id", "seq", "part_id", lon="lon")


_NRM = f"""SELECT *, CASE WHEN len = 0 THEN 0 ELSE -ty / len END AS nx, CASE WHEN len = 0 THEN 0 ELSE tx / len END AS ny FROM (SELECT *, sqrt(tx * tx + ty * ty) AS len FROM (SELECT *, coalesce(lead(lon) OVER w, lon) - coalesce(lag(lon) OVER w, lon) AS tx, coalesce(lead(lat) OVER w, lat) - coalesce(lag(lat) OVER w, lat) AS ty FROM ({TRACK}) WINDOW w AS (PARTITION BY track_id ORDER BY seq)))"""


@query("track_normals", r6_sql(_NRM, "track_id", "seq", nx="nx", ny="ny"))
def track_normals(spark, d):
    return r6(tracks.unit_normals(base.track(spark, d), "lon", "lat"), "track_id", "seq", nx="nx", ny="ny")


@query("track_ribbon", r6_sql(f"SELECT track_id, seq, lon + nx * obs * sc AS rx, lat + ny * obs * sc AS ry FROM ({_NRM}), (SELECT 0.06e0 * sqrt(pow(max(lon) - min(lon), 2) + pow(max(lat) - min(lat), 2)) / max(abs(obs)) AS sc FROM ({TRACK}) WHERE NOT isnan(obs))", "track_id", "seq", rx="rx", ry="ry"))
def track_ribbon(spark, d):
    return r6(tracks.ribbon(base.track(spark, d).withColumnsRenamed({"lon": "x", "lat": "y"})), "track_id", "seq", rx="rx", ry="ry")


@query("unwrap_longitude", r6_sql(f"SELECT track_id, seq, first_value(lon) OVER w + sum(st) OVER w AS u FROM (SELECT track_id, seq, lon, coalesce(dl - 360e0 * round(dl / 360e0), 0e0) AS st FROM (SELECT *, lon - lag(lon) OVER (PARTITION BY track_id ORDER BY seq) AS dl FROM ({TRACK}))) WINDOW w AS (PARTITION BY track_id ORDER BY seq)", "track_id", "seq", lon="u"))
def unwrap_longitude(spark, d):
    return r6(tracks.unwrap_longitude(base.track(spark, d)), "track_id", "seq", lon="lon_unwrapped")


_SPACING = f"SELECT 1.4e0 * quantile_cont(s, 0.5) AS spacing FROM (SELECT quantile_cont(obs, 0.95) - quantile_cont(obs, 0.05) AS s, count(*) AS n FROM ({TRACK}) WHERE NOT isnan(obs) GROUP BY track_id) WHERE n >= 2 AND s > 0"


@query("typical_range", r6_sql(_SPACING, spacing="spacing"))
def typical_range(spark, d):
    return r6(tracks.typical_range(base.track(spark, d)), spacing="spacing")


@query("series_offsets", r6_sql(f"SELECT track_id, (row_number() OVER (ORDER BY track_id DESC) - 1) * spacing AS o FROM (SELECT DISTINCT track_id FROM ({TRACK})), ({_SPACING})", "track_id", offset="o").replace(" AS offset", ' AS "offset"'))
def series_offsets(spark, d):
    return r6(tracks.stack_offsets(base.track(spark, d)).select("track_id", "offset").distinct(), "track_id", **{"`offset`": "`offset`"})


@query("series_band", f"""WITH r AS (SELECT track_id, seq, obs, sum(CASE WHEN isnan(obs) THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS g FROM ({TRACK})), n AS (SELECT *, count(*) OVER (PARTITION BY track_id, g) AS c FROM r WHERE NOT isnan(obs))
 SELECT track_id, seq, {rounded('(obs - 2e0)')} AS lo, {rounded('(obs + 2e0)')} AS hi FROM n WHERE c >= 2""")
def series_band(spark, d):
    return r6(tracks.uncertainty_band(base.track(spark, d), "obs", 2.0), "track_id", "seq", lo="lo", hi="hi")


@query("series_labels", r6_sql(f"SELECT track_id, arg_max(time, seq) + 0.01e0 * (max(time) - min(time)) AS t, arg_max(obs, seq) AS v FROM ({TRACK}) WHERE NOT isnan(obs) GROUP BY track_id", "track_id", label_value="v").replace("SELECT track_id,", "SELECT track_id, round(t, 3) AS label_time,", 1))
def series_labels(spark, d):
    return r6(tracks.label_anchor(base.track(spark, d)), "track_id", "round(label_time, 3) AS label_time", label_value="label_value")


@query("series_reference", r6_sql(f"SELECT track_id, t0, t1, value FROM (SELECT DISTINCT track_id FROM ({TRACK})), (SELECT min(time) AS t0, max(time) AS t1 FROM ({TRACK})), (VALUES (10e0), (50e0)) v(value)", "track_id", t0="t0", t1="t1", value="value"))
def series_reference(spark, d):
    return r6(tracks.reference_lines(base.track(spark, d), [10.0, 50.0]), "track_id", t0="t0", t1="t1", value="value")


@query("median_spacing", r6_sql(f"SELECT quantile_cont(d, 0.5) AS m FROM (SELECT sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) AS d FROM ({TRACK}) WINDOW w AS (PARTITION BY track_id ORDER BY seq)) WHERE d IS NOT NULL", median_spacing="m"))
def median_spacing(spark, d):
    return r6(tracks.median_spacing(base.track(spark, d), "lon", "lat"), median_spacing="median_spacing")


# --- grids ------------------------------------------------------------------------------------------------


@query("grid_axes", r6_sql("SELECT * FROM (SELECT 'lon' AS dim, CAST(k AS INT) AS k, -175e0 + 10e0 * k AS c FROM range(36) t(k)) UNION ALL SELECT 'lat', CAST(k AS INT), -85e0 + 10e0 * k FROM range(18) t(k)", "dim", "k", centre="c"))
def grid_axes(spark, d):
    return r6(grid.cell_edges(base.grid(spark, d)).select("dim", "k", F.col("centre").alias("c")), "dim", "k", centre="c")


@query("cell_edges", r6_sql("SELECT * FROM (SELECT 'lon' AS dim, CAST(k AS INT) AS k, -180e0 + 10e0 * k AS a, -170e0 + 10e0 * k AS b FROM range(36) t(k)) UNION ALL SELECT 'lat', CAST(k AS INT), -90e0 + 10e0 * k, -80e0 + 10e0 * k FROM range(18) t(k)", "dim", "k", lo_edge="a", hi_edge="b"))
def cell_edges(spark, d):
    return r6(grid.cell_edges(base.grid(spark, d)), "dim", "k", lo_edge="lo_edge", hi_edge="hi_edge")


@query("grid_registration", "SELECT 'cell' AS registration, true AS is_global_lon, CAST(36 AS INT) AS n_lon, CAST(18 AS INT) AS n_lat")
def grid_registration(spark, d):
    g = grid.describe(base.grid(spark, d))
    return spark.createDataFrame([(g["registration"], g["is_global_lon"], g["n_lon"], g["n_lat"])], "registration string, is_global_lon boolean, n_lon int, n_lat int")


@query("grid_subset", r6_sql(f"SELECT i, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon, lat, z FROM ({GRID}) WHERE (lon >= 165 OR lon <= -165) AND lat BETWEEN -5 AND 15", "i", lon="lon", lat="lat", z="z"))
def grid_subset(spark, d):
    return r6(grid.subset(base.grid(spark, d), (170.0, 190.0), (-3.0, 14.0)), "i", lon="lon", lat="lat", z="z")


@query("grid_stride", r6_sql(f"SELECT CAST(i // 3 AS INT) AS i, CAST(j // 4 AS INT) AS j, z FROM ({GRID}) WHERE i % 3 = 0 AND j % 4 = 0", "i", "j", z="z"))
def grid_stride(spark, d):
    return r6(grid.stride(base.grid(spark, d), 3, 4), "i", "j", z="z")


@query("block_mean", r6_sql(f"SELECT CAST(i // 3 AS INT) AS i, CAST(j // 3 AS INT) AS j, avg(z) AS z, avg(lat) AS lat FROM ({GRID}) GROUP BY 1, 2", "i", "j", z="z", lat="lat"))
def block_mean(spark, d):
    return r6(grid.block_mean(base.grid(spark, d), 3), "i", "j", z="z", lat="lat")


LON_Q, LAT_Q = [-178.1371913 + 12 * q for q in range(30)], [-79.0713717 + 13 * p for p in range(13)]
_AXIS = "WITH g AS ({grid}), tx AS (SELECT CAST(q AS INT) AS q, -178.1371913e0 + 12e0 * q AS lon FROM range(30) t(q)), ty AS (SELECT CAST(p AS INT) AS p, -79.0713717e0 + 13e0 * p AS lat FROM range(13) t(p)),"


@query("regrid_bilinear", _AXIS.format(grid=GRID) + f""" bx AS (SELECT q, CAST(((k % 36) + 36) % 36 AS INT) AS j, w FROM (SELECT q, CAST(floor((lon + 175) / 10) AS INT) + s AS k, CASE WHEN s = 0 THEN 1 - f ELSE f END AS w FROM (SELECT *, (lon + 175) / 10 - floor((lon + 175) / 10) AS f FROM tx), range(2) t(s))),
 byy AS (SELECT p, CAST(floor((lat + 85) / 10) AS INT) + s AS i, CASE WHEN s = 0 THEN 1 - f ELSE f END AS w FROM (SELECT *, (lat + 85) / 10 - floor((lat + 85) / 10) AS f FROM ty), range(2) t(s))
 SELECT p AS i, q AS j, {rounded('sum(bx.w * byy.w * z)')} AS z FROM g JOIN bx ON bx.j = g.j JOIN byy ON byy.i = g.i WHERE bx.w * byy.w <> 0 GROUP BY p, q""")
def regrid_bilinear(spark, d):
    return r6(grid.regrid(base.grid(spark, d), LON_Q, LAT_Q), "i", "j", z="z")


@query("regrid_nearest", _AXIS.format(grid=GRID) + f" n AS (SELECT q, p, CAST(((floor((tx.lon + 175) / 10 + 0.5) % 36) + 36) % 36 AS INT) AS j, CAST(floor((ty.lat + 85) / 10 + 0.5) AS INT) AS i FROM tx, ty) SELECT p AS i, q AS j, {rounded('z')} AS z FROM n LEFT JOIN g USING (i, j)")
def regrid_nearest(spark, d):
    return r6(grid.regrid(base.grid(spark, d), LON_Q, LAT_Q, "nearest"), "i", "j", z="z")


_C_LON, _C_LAT = [-170.0 + 20 * k for k in range(18)], [-75.0 + 30 * k for k in range(6)]
_CONS = f"""SELECT CAST(floor(i / 3) AS INT) AS p, CAST(floor(j / 2) AS INT) AS q, CASE WHEN bool_and(isnan(z)) THEN CAST('NaN' AS DOUBLE) ELSE sum(CASE WHEN isnan(z) THEN 0 ELSE w * z END) / sum(CASE WHEN isnan(z) THEN 0 ELSE w END) END AS z FROM (SELECT *, sin((lat + 5) * pi() / 180) - sin((lat - 5) * pi() / 180) AS w FROM ({GRID})) GROUP BY 1, 2"""


@query("regrid_conservative", f"SELECT p AS i, q AS j, {rounded('z')} AS z FROM ({_CONS})")
def regrid_conservative(spark, d):
    return r6(grid.regrid(base.grid(spark, d), _C_LON, _C_LAT, "conservative"), "i", "j", z="z")


@query("regrid_mass", f"SELECT {rounded('sum(z * (sin((lat + 5) * pi() / 180) - sin((lat - 5) * pi() / 180)) * 10e0 * pi() / 180)', 4)} AS mass FROM ({GRID}) WHERE NOT isnan(z)")
def regrid_mass(spark, d):
    return spark.createDataFrame([(grid.mass(base.grid(spark, d)),)], "m double").selectExpr(f"{rounded('m', 4)} AS mass")


_HILL = f"""WITH g AS (SELECT *, CASE WHEN isnan(z) THEN (SELECT avg(z) FROM ({GRID}) WHERE NOT isnan(z)) ELSE z END AS t FROM ({GRID})),
 h AS (SELECT *, coalesce(lead(t) OVER r, t) - coalesce(lag(t) OVER r, t) AS dx, coalesce(lag(t) OVER r, t) + 2 * t + coalesce(lead(t) OVER r, t) AS sx FROM g WINDOW r AS (PARTITION BY i ORDER BY j)),
 v AS (SELECT *, (coalesce(lag(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, dx)) / (8 * 6371007.2e0 * cos(lat * pi() / 180) * 10 * pi() / 180) AS gx, (coalesce(lead(sx) OVER c, sx) - coalesce(lag(sx) OVER c, sx)) / (8 * 6371007.2e0 * 10 * pi() / 180) AS gy FROM h WINDOW c AS (PARTITION BY j ORDER BY i)),
 f AS (SELECT tan(pi() / 6) / quantile_cont(sqrt(gx * gx + gy * gy), 0.5) AS zf FROM v WHERE sqrt(gx * gx + gy * gy) > 0)"""


def _shade_sql(az: float) -> str:
    s, a = "atan(sqrt(gx * gx + gy * gy) * zf)", "atan2(-gx, -gy)"
    return f"(0.35e0 + 0.65e0 * greatest(0e0, cos(pi() / 4) * cos({s}) + sin(pi() / 4) * sin({s}) * cos({az}e0 * pi() / 180 - {a})))"


@query("hillshade", _HILL + f" SELECT i, j, CASE WHEN isnan(z) THEN 1e0 ELSE {rounded(_shade_sql(315.0))} END AS shade FROM v, f")
def hillshade(spark, d):
    return r6(grid.hillshade(base.grid(spark, d), z="z"), "i", "j", shade="shade")


_MULTI = " + ".join(f"{math.sin(math.radians(a - 315 + 90)) ** 2 / 2!r} * {_shade_sql(float(a))}" for a in (270, 315, 360))


@query("hillshade_multi", _HILL + f" SELECT i, j, CASE WHEN isnan(z) THEN 1e0 ELSE {rounded(f'({_MULTI})')} END AS shade FROM v, f")
def hillshade_multi(spark, d):
    return r6(grid.hillshade(base.grid(spark, d), z="z", multi=True), "i", "j", shade="shade")


@query("auto_zfactor", _HILL + f" SELECT {rounded('zf', 3)} AS zf FROM f")
def auto_zfactor(spark, d):
    return spark.createDataFrame([(grid.auto_z_factor(base.grid(spark, d), "z"),)], "v double").selectExpr(f"{rounded('v', 3)} AS zf")


@query("roll_to_centre", r6_sql(f"SELECT i, CAST(((j - 18 + 36) % 36) AS INT) AS j, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon, z FROM ({GRID})", "i", "j", lon="lon", z="z"))
def roll_to_centre(spark, d):
    return r6(grid.roll_to_centre(base.grid(spark, d), 180.0), "i", "j", lon="lon", z="z")


@query("mask_threshold", f"SELECT i, j, NOT isnan(z) AND z < 50e0 AS masked FROM ({GRID})")
def mask_threshold(spark, d):
    return grid.mask(base.grid(spark, d), "threshold", 50.0).select("i", "j", "masked")


@query("mask_polygon", f"SELECT i, j, NOT ({_IN_TRIANGLE}) AS masked FROM ({GRID})")
def mask_polygon(spark, d):
    return grid.mask(base.grid(spark, d), "polygon", inside=projection.in_polygon([TRIANGLE])).select("i", "j", "masked")


@query("mask_explicit", f"SELECT i, j, (i + j) % 3 = 0 AS masked FROM ({GRID})")
def mask_explicit(spark, d):
    g = base.grid(spark, d)
    return grid.mask(g, "explicit", explicit=g.selectExpr("i", "j", "(i + j) % 3 = 0 AS masked")).select("i", "j", "masked")


@query("mask_verdict", f"SELECT bool_and(m) AS covers_everything, NOT bool_or(m) AS covers_nothing, CAST(count(*) FILTER (m) AS BIGINT) AS n_masked FROM (SELECT NOT isnan(z) AND z < 50e0 AS m FROM ({GRID}))")
def mask_verdict(spark, d):
    return grid.mask_verdict(grid.mask(base.grid(spark, d), "threshold", 50.0))


@query("stipple_dots", f"SELECT i, j FROM (SELECT i, j, row_number() OVER (ORDER BY j, i) - 1 AS r, ceil(count(*) OVER () / 100.0) AS n FROM ({GRID}) WHERE NOT isnan(z) AND z <> 0) WHERE r % n = 0")
def stipple_dots(spark, d):
    return grid.stipple_dots(base.grid(spark, d), 100).select("i", "j")


@query("stipple_hatch")
def stipple_hatch(spark, d):
    g = base.grid(spark, d).withColumns({"x": F.col("lon"), "y": F.col("lat")})
    return r6(grid.stipple_hatch(g.where("z > 40"), 14.0), "line", "stroke", x0="x0", y0="y0", x1="x1", y1="y1")


@query("background", None)
def background(spark, d):
    return r6(grid.background(base.grid(spark, d), (-30.0, 50.0), (30.0, 75.0)), "i", "j", lon="lon", lat="lat", z="z")


# where a level cuts the sides of cells whose four corners have values: the vertices of contour lines, whatever their order
_CUTS = f"""WITH g AS ({GRID}), c AS (SELECT a.i, a.j, a.lon AS w, a.lat AS s, d.lon AS e, d.lat AS n, a.z AS sw, b.z AS se, k.z AS nw, d.z AS ne
  FROM g a JOIN g b ON b.i = a.i AND b.j = a.j + 1 JOIN g k ON k.i = a.i + 1 AND k.j = a.j JOIN g d ON d.i = a.i + 1 AND d.j = a.j + 1 WHERE NOT isnan(a.z + b.z + k.z + d.z)),
  sides AS (SELECT i, j, w AS x1, s AS y1, e AS x2, s AS y2, sw AS z1, se AS z2 FROM c UNION ALL SELECT i, j, e, s, e, n, se, ne FROM c UNION ALL SELECT i, j, w, n, e, n, nw, ne FROM c UNION ALL SELECT i, j, w, s, w, n, sw, nw FROM c),
  cuts AS (SELECT level, i, j, x1 + (x2 - x1) * ((level - z1) / (z2 - z1)) AS lon, y1 + (y2 - y1) * ((level - z1) / (z2 - z1)) AS lat FROM sides, (VALUES (30e0), (50e0), (60e0)) v(level) WHERE (z1 >= level) <> (z2 >= level))"""


@query("contours", f"{_CUTS} SELECT DISTINCT level, {rounded('lon')} AS lon, {rounded('lat')} AS lat FROM cuts")
def contours(spark, d):
    """Every vertex of the chained lines, once; tests hold their order."""
    g = base.grid(spark, d)
    lines = geometry.chain_segments(geometry.contour_segments(g, [30.0, 50.0, 60.0]))
    return r6(lines, "level", lon="lon", lat="lat").distinct()


@query("contour_labels")
def contour_labels(spark, d):
    lines = geometry.chain_segments(geometry.contour_segments(base.grid(spark, d), [30.0, 60.0])).withColumnsRenamed({"lon": "x", "lat": "y"})
    return r6(geometry.label_places(lines, 25.0), "level", "line", "seq", x="x", y="y")


_TURN = "(v * 2e0 * pi() / 360e0)"


@query("coast_sample", f"""SELECT path_id, seq, {rounded('(u - 360e0 * floor((u + 180e0) / 360e0))')} AS lon, {rounded('lat')} AS lat FROM (SELECT concat('sample#', k) AS path_id, CAST(v AS BIGINT) AS seq, lon0 + a * cos({_TURN}) * (1e0 + 0.15e0 * sin(3e0 * {_TURN} + k)) AS u, lat0 + b * sin({_TURN}) * (1e0 + 0.1e0 * cos(5e0 * {_TURN})) AS lat
 FROM (VALUES (0, -95e0, 45e0, 30e0, 20e0), (1, -60e0, -15e0, 18e0, 28e0), (2, 20e0, 5e0, 22e0, 30e0), (3, 75e0, 48e0, 55e0, 20e0), (4, 134e0, -25e0, 19e0, 12e0), (5, 178e0, -10e0, 9e0, 14e0)) t(k, lon0, lat0, a, b), range(361) r(v))""")
def coast_sample(spark, d):
    return r6(coastline.sample_coast(spark, split="none"), "path_id", "seq", lon="lon", lat="lat")


@query("contour_segments", f"{_CUTS} SELECT DISTINCT level, i, j, {rounded('lon')} AS lon, {rounded('lat')} AS lat FROM cuts")
def contour_segments(spark, d):
    """Both ends of every segment, cell by cell."""
    s = geometry.contour_segments(base.grid(spark, d), [30.0, 50.0, 60.0])
    ends = s.select("level", "i", "j", F.col("x1").alias("lon"), F.col("y1").alias("lat")).unionByName(s.select("level", "i", "j", F.col("x2").alias("lon"), F.col("y2").alias("lat")))
    return r6(ends, "level", "i", "j", lon="lon", lat="lat").distinct()


# --- colours -------------------------------------------------------------------------------------------------


@query("colormap_get", r6_sql("SELECT CAST(k AS INT) AS idx, k / 255e0 AS v FROM range(256) t(k)", "idx", r="v", g="v", b="v"))
def colormap_get(spark, d):
    return r6(color.colormap_rows(spark, "gray"), "idx", r="r", g="g", b="b")


@query("colormap_discretize", r6_sql("SELECT CAST(k AS INT) AS idx, floor((least(k * 5 // 256, 4) + 0.5) / 5 * 255 + 0.5) / 255e0 AS v FROM range(256) t(k)", "idx", r="v"))
def colormap_discretize(spark, d):
    return r6(color.colormap_rows(spark, "gray", 256, 5), "idx", r="r")


@query("colormap_sequential", r6_sql("SELECT CAST(k AS INT) AS idx, k / 255e0 AS t, 1 - 0.85e0 * k / 255 AS l FROM range(256) t(k)", "idx", r="l * (1 - 0.75e0 * t)", g="l * (1 - 0.35e0 * t)", b="l"))
def colormap_sequential(spark, d):
    return r6(color.colormap_rows(spark, "sequential"), "idx", r="r", g="g", b="b")


@query("truecolor", r6_sql(f"SELECT event_id, CASE WHEN isnan(obs) THEN 1e0 WHEN obs < 20 THEN 0e0 ELSE floor(least(greatest((obs - 20) / 60, 0), 1) * 255 + 0.5) / 255 END AS v FROM ({POINTS})", "event_id", r="v"))
def truecolor(spark, d):
    return r6(color.truecolor(base.points(spark, d), "gray", "obs", (20.0, 80.0), under=(0.0, 0.0, 1.0)), "event_id", r="r")


# --- geometry and annotations: results of iterations, without SQL ------------------------------------------------


@query("clip_boundary")
def clip_boundary(spark, d):
    t = base.track(spark, d).select(F.col("track_id").cast("string").alias("path_id"), "seq", "lon", "lat")
    return r6(geometry.clip_paths(t, "equirectangular", (-100.0, 120.0), (-50.0, 60.0)), "path_id", "part_id", "seq", lon="lon", lat="lat", source="source")


@query("clip_counts", f"""SELECT path_id, CAST(sum(CASE WHEN ok <> before THEN 1 ELSE 0 END) AS BIGINT) AS cuts, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS kept
 FROM (SELECT *, lag(ok) OVER (PARTITION BY path_id ORDER BY seq) AS before FROM (SELECT CAST(track_id AS VARCHAR) AS path_id, seq, lon BETWEEN -100.000000001e0 AND 120.000000001e0 AND lat BETWEEN -50.000000001e0 AND 60.000000001e0 AS ok FROM ({TRACK}))) GROUP BY path_id""")
def clip_counts(spark, d):
    t = base.track(spark, d).select(F.col("track_id").cast("string").alias("path_id"), "seq", "lon", "lat")
    return geometry.clip_counts(t, "equirectangular", (-100.0, 120.0), (-50.0, 60.0))


@query("track_interpolated", f"""SELECT track_id, seq, {rounded('v')} AS obs FROM (SELECT track_id, seq, CASE WHEN f = 0 THEN obs ELSE obs + f * (nxt - obs) END AS v FROM (SELECT *, (seq % 4) / 4e0 AS f, lead(obs) OVER (PARTITION BY track_id ORDER BY seq) AS nxt FROM ({TRACK})))""")
def track_interpolated(spark, d):
    """Values a quarter, a half and three quarters of the way to the next vertex, and at vertices."""
    t = base.track(spark, d)
    places = t.select("track_id", "seq", F.expr("seq - 1 + (seq % 4) / 4e0").alias("source"))
    return r6(tracks.interpolate_at(places, t), "track_id", "seq", obs="obs")


@query("project_polyline")
def project_polyline(spark, d):
    lines = spark.createDataFrame([(f"m{m}", k, float(m), float(y)) for m in range(-180, 181, 30) for k, y in enumerate(range(-80, 81, 10))], "path_id string, seq long, lon double, lat double")
    return r6(geometry.project_paths(lines, sample_crs("orthographic"), 0.05, True), "path_id", "part_id", "seq", x="x", y="y")


@query("map_boundary")
def map_boundary(spark, d):
    return r6(geometry.map_boundary(spark, "mollweide"), "seq", x="x", y="y")


@query("scale_variation")
def scale_variation(spark, d):
    return spark.createDataFrame([(scene.Scene(spark, "mercator", (-20.0, 40.0), (30.0, 70.0)).scale_variation(),)], "variation double").selectExpr(f"{rounded('variation', 4)} AS variation")


@query("scalebar")
def scalebar(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        s = scene.Scene(spark, "mercator", (-20.0, 40.0), (30.0, 70.0)).scalebar()
    return s.frame_rows().select("kind", "seq", "text")


scalar("north_bearing", lambda d: {"bearing": scene.north_bearing_expr(sample_crs("lambertconformal"), dialect=d)}, "abs(lat) < 70e0 AND lon BETWEEN -160e0 AND -30e0")


@query("v1_options", f"SELECT kind, CAST(count(*) AS BIGINT) AS n, CASE WHEN kind = 'none' THEN 'raise' ELSE 'translate' END AS verdict FROM (VALUES {', '.join(f"('{o}', '{k}')" for o, k, *_ in options.OPTIONS)}) t(option, kind) GROUP BY kind")
def v1_options(spark, d):
    asked = options.option_rows(spark).selectExpr("option", "'x' AS value")
    return options.resolve(spark, asked).groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"))


def _scene_count(df: DataFrame) -> DataFrame:
    return df.groupBy("scene_id", "kind", "z_level").agg(F.count(F.lit(1)).alias("n"))


@query("map_scene")
def map_scene(spark, d):
    return _scene_count(scene.draw_map(base.grid(spark, d), "mollweide", contours={"levels": [40.0, 60.0]}, title="Values", stipple={"g": base.grid(spark, d), "density": 100}).frame_rows())


@query("track_scene")
def track_scene(spark, d):
    t = tracks.split_tracks(base.track(spark, d), time_gap="86400")
    return _scene_count(scene.track_map(t, "equirectangular", background=base.grid(spark, d)).frame_rows())


@query("points_scene")
def points_scene(spark, d):
    p = base.points(spark, d).selectExpr("event_id AS point_id", "lon", "lat", "obs", "obs AS size", "event_type AS label")
    return _scene_count(scene.point_map(p, "robinson").frame_rows())


@query("timeseries_scene")
def timeseries_scene(spark, d):
    return _scene_count(scene.time_series(base.track(spark, d), sigma=2.0, references=[50.0]))


@query("panel_union")
def panel_union(spark, d):
    g = base.grid(spark, d)
    return _scene_count(scene.panel([{"type": "map", "data": g, "options": {"graticule": False}}, {"type": "map", "data": g.where("z > 30"), "options": {"graticule": False, "lon_limit": (-180.0, 180.0), "lat_limit": (-90.0, 90.0)}}, {"type": "series", "data": base.track(spark, d)}]))


@query("session_passes", "SELECT user_id, CAST(count(*) AS BIGINT) AS passes, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, p, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)) GROUP BY user_id, p) GROUP BY user_id")
def session_passes(spark, d):
    from loxodrome.streaming.sessions import session_passes as passes

    return passes(spark.read.parquet(f"{d}/events.parquet"), 86400).groupBy("user_id").agg(F.count(F.lit(1)).alias("passes"), F.sum("n").alias("events"))


