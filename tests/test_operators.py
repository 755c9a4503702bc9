"""Tracks, grids, fields, colours, geometry and sources on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.model import Region
from loxodrome.operators import color, fields, geometry, grid, projection, tracks
from loxodrome.sources import coastline, grids
from loxodrome.sources.cache import FrameCache

NAN = float("nan")


def track(spark, time, lon=None, lat=None):
    n = len(time)
    rows = [(1, k, float((lon or range(n))[k]), float((lat or [0] * n)[k]), float(time[k]), float(k)) for k in range(n)]
    return spark.createDataFrame(rows, "track_id int, seq long, lon double, lat double, time double, obs double")


def passes(df):
    return [r.pass_id for r in df.orderBy("seq").collect()]


def test_split_tracks(spark):
    t = track(spark, [1, 2, 3, 100, 200, 201, 202, 203])
    assert passes(tracks.split_tracks(t)) == [1, 1, 1, None, 2, 2, 2, 2]
    assert passes(tracks.split_tracks(track(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2]))) == [1] * 9
    assert passes(tracks.split_tracks(track(spark, [0] * 5))) == [1] * 5
    r = tracks.split_tracks(track(spark, range(8), [0, 1, 2, 50, 51, 3, 4, 5]), region=Region("b", (-1, 10), (-1, 1)))
    assert passes(r) == [1, 1, 1, None, None, 2, 2, 2]
    assert passes(tracks.split_tracks(track(spark, range(10)), max_points=4)) == [1] * 4 + [2] * 4 + [3] * 2
    with pytest.raises(GeoError):
        tracks.split_tracks(t, time_gap="soon")


def test_antimeridian(spark):
    got = tracks.split_antimeridian(track(spark, [0, 1], [179, -179], [10, 20])).orderBy("seq", "sub").collect()
    assert [(r.part_id, r.lon, r.lat) for r in got] == [(0, 179, 10), (0, 180, 15), (1, -180, 15), (1, -179, 20)]
    assert [r.part_id for r in tracks.split_antimeridian(track(spark, [0, 1], [179, -179]), mode="break").orderBy("seq").collect()] == [0, 1]


def test_runs_and_gaps(spark):
    t = track(spark, range(6)).withColumn("obs", F.when(F.col("seq").isin(1, 2, 4), F.lit(NAN)).otherwise(F.col("obs")))
    assert tracks.count_gaps(t, "obs").first().n_gaps == 2
    assert [r.run_id for r in tracks.runs(t, ["obs"]).orderBy("seq").collect()] == [1, 2, 3]


def test_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, NAN, 2.0, math.inf)], "v double")
    assert fields.quantile(df, "v", [50]).first()[0] == 1.5
    assert tuple(fields.value_limits(df.where("v > 5 and v < 9"), "v").first()) == (-0.5, 0.5)
    with pytest.raises(GeoError):
        fields.quantile(df, "v", [101])


def test_regrid(spark):
    g = grid.mesh(spark, list(range(360)), [-1, 0, 1], "cos(radians(lon))")
    got = {(r.lon, r.lat): r.z for r in grid.regrid(g, [-0.5, 179.5], [0.0]).collect()}
    assert got[(-0.5, 0.0)] == pytest.approx((math.cos(math.radians(359)) + 1) / 2, abs=1e-12)
    assert got[(179.5, 0.0)] == pytest.approx((math.cos(math.radians(179)) - 1) / 2, abs=1e-12)
    h = grid.mesh(spark, [-179.5 + 4 * k for k in range(90)], [-88.0 + 4 * k for k in range(45)], "CASE WHEN i % 2 = 0 THEN 5e0 ELSE double('NaN') END" if False else "5e0").withColumn("z", F.when(F.col("i") % 2 == 0, F.col("z")).otherwise(NAN))
    z = [r.z for r in grid.regrid(h, [-150.0 + 60 * k for k in range(6)], [-60.0, 0.0, 60.0], "conservative").collect()]
    assert all(abs(v - 5) < 1e-12 for v in z)
    f = grid.mesh(spark, [-178.0 + 4 * k for k in range(90)], [-88.0 + 4 * k for k in range(45)], "sin(radians(3 * lat)) + cos(radians(lon))")
    m = grid.mass(grid.regrid(f, [-170.0 + 20 * k for k in range(18)], [-80.0 + 20 * k for k in range(9)], "conservative"))
    assert m == pytest.approx(grid.mass(f), abs=1e-12)
    with pytest.raises(GeoError):
        grid.regrid(grid.mesh(spark, [0, 1, 2, 5], [0, 1, 2, 3]), [0.0, 1.0], [0.0, 1.0], "conservative")


def test_hillshade(spark):
    flat = grid.mesh(spark, list(np.linspace(-10, 10, 21)), [-1, 0, 1]).withColumnRenamed("z", "topo")
    assert all(abs(r.shade - (0.35 + 0.65 * math.sin(math.pi / 4))) < 1e-14 for r in grid.hillshade(flat, z_factor=1.0).collect())
    hole = grid.mesh(spark, list(range(5)), list(range(5))).withColumn("topo", F.when((F.col("i") == 2) & (F.col("j") == 2), NAN).otherwise(0.0))
    assert grid.hillshade(hole).where("i = 2 and j = 2").first().shade == 1


def test_axes():
    with pytest.raises(GeoError):
        grid.check_axis(np.array([0, 2, 1]), "lon")
    assert grid.registration(np.arange(-179.5, 180), np.arange(-89.5, 90)) == "cell"
    assert grid.registration(np.arange(-180, 181.0), np.arange(-90, 91.0)) == "posting"


def test_colours(spark):
    m = color.colormap("divergent", 256)
    assert m.shape == (256, 3) and len(np.unique(color.discretize(m, 5), axis=0)) == 5
    df = spark.createDataFrame([(0, -1.0, False), (1, 0.5, False), (2, 9.0, True), (3, NAN, True)], "k int, z double, m boolean")
    got = [(r.r, r.g, r.b) for r in color.truecolor(df, "gray", limits=(0.0, 1.0), under=(1, 0, 0), masked="m").orderBy("k").collect()]
    assert got[0] == (1, 0, 0) and abs(got[1][0] - 128 / 255) < 1e-9 and got[2] == (0.7, 0.7, 0.7) and got[3] == (1, 1, 1)


def test_polygons(spark):
    ring = lambda p, pts: [(p, k, float(x), float(y)) for k, (x, y) in enumerate(pts)]
    r = spark.createDataFrame(ring(1, [(170, -10), (-170, -10), (-170, 10), (170, 10)]), "poly_id int, seq long, lon double, lat double")
    parts = geometry.split_rings(r).groupBy("part_id").agg((F.max("lon") - F.min("lon")).alias("w")).collect()
    assert len(parts) == 2 and sum(p.w for p in parts) == pytest.approx(20, abs=1e-6)
    sq = spark.createDataFrame(ring(7, [(0, 0), (4, 0), (4, 4), (0, 4)]), "poly_id int, seq long, lon double, lat double")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0), (3, 4.0, 2.0), (4, -1.0, 2.0)], "point_id int, lon double, lat double")
    assert sorted(x.point_id for x in geometry.points_in_rings(pts, sq).collect()) == [1, 3]
    with pytest.raises(GeoError):
        geometry.rings_with_values(sq, spark.createDataFrame([(8, 1.0)], "poly_id int, value double"))


@pytest.mark.parametrize("ring", [[(-60, -50), (70, -20), (10, 65)], [(10, 65), (70, -20), (-60, -50)], [(-60, -50), (0, -10), (70, -20), (10, 65)]])
def test_points_beside_an_edge(spark, ring):
    """Points a rounding error from an edge fall on the side the sign of the product says, in the join and in the expression."""
    closed = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    near = [(a + (c - a) * t / 12 + dx, b + (d - b) * t / 12) for (a, b), (c, d) in closed for t in range(13) for dx in (0.0, -1e-14, 1e-14, -1e-9, 1e-9)]
    pts = [(k, x, y) for k, (x, y) in enumerate(near + [(x / 1e2 - 60, -((x * 7) % 5000) / 1e2) for x in range(0, 13000, 61)])]

    def inside(x, y):
        odd = False
        for (a, b), (c, d) in closed:
            side = (c - a) * (y - b) - (d - b) * (x - a)
            if side == 0 and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d):
                return True
            odd ^= b <= y < d and side > 0 or d <= y < b and side < 0
        return odd

    df = spark.createDataFrame(pts, "point_id int, lon double, lat double")
    rings = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(ring)], "poly_id int, seq long, lon double, lat double")
    want = sorted(k for k, x, y in pts if inside(x, y))
    assert sorted(r.point_id for r in geometry.points_in_rings(df, rings).collect()) == want
    assert sorted(r.point_id for r in df.where(projection.in_polygon([ring])).collect()) == want


def test_clip_counts_are_those_of_the_clip(spark):
    rows = [(p, k, (k * 37 * (ord(p) - 90) % 360) - 180.0 if k % 11 else NAN, (k * 17) % 170 - 85.0) for p in "abc" for k in range(60)]
    d = spark.createDataFrame(rows, "path_id string, seq long, lon double, lat double")
    box = ("equirectangular", (-100.0, 120.0), (-50.0, 60.0))
    cut = geometry.clip_paths(d, *box).groupBy("path_id").agg(F.count_if(F.col("source") != F.floor("source")).alias("cuts"), F.count_if(F.col("source") == F.floor("source")).alias("kept"))
    assert sorted(map(tuple, geometry.clip_counts(d, *box).collect())) == sorted(map(tuple, cut.collect()))


def test_values_between_vertices(spark):
    path = spark.createDataFrame([(1, 5, 10.0), (1, 7, 20.0), (1, 9, NAN), (1, 11, 4.0)], "track_id int, seq long, obs double")
    at = spark.createDataFrame([(1, x) for x in (0.0, 0.25, 1.0, 1.5, 2.5, 3.0)], "track_id int, source double")
    got = {r.source: r.obs for r in tracks.interpolate_at(at, path).collect()}
    assert [got[x] for x in (0.0, 0.25, 1.0, 3.0)] == [10.0, 12.5, 20.0, 4.0] and math.isnan(got[1.5]) and math.isnan(got[2.5])


def test_end_caps(spark):
    flags = spark.createDataFrame([(True, False)], "has_under boolean, has_over boolean")
    sides = lambda arrows: sorted(tuple(r) for r in fields.end_caps(flags, 200.0, arrows=arrows).collect())
    assert sides("auto") == [("low", 0.0, -10.0)] and sides("on") == [("high", 200.0, 210.0), ("low", 0.0, -10.0)] and sides("off") == []


def test_contour_label_places(spark):
    x = [0.0, 1.0, 2.0, 3.0, NAN, 10.0, 10.5, 12.5, 13.0, 16.0]
    d = spark.createDataFrame([(1.0, 0, k, v, 0.0) for k, v in enumerate(x)], "level double, line int, seq long, x double, y double")
    assert sorted(r.seq for r in geometry.label_places(d, 2.0).collect()) == [2, 7, 9]
    with pytest.raises(GeoError):
        geometry.label_places(d, 0.0)


def test_sample_coast_is_closed_and_split(spark):
    whole = coastline.sample_coast(spark, 90, "none")
    ends = whole.groupBy("path_id").agg(F.min_by("lat", "seq").alias("a"), F.max_by("lat", "seq").alias("b")).collect()
    assert len(ends) == len(coastline.SAMPLE_LANDS) and all(r.a == pytest.approx(r.b) for r in ends)
    assert whole.where("abs(lon) > 180 OR abs(lat) > 90").count() == 0
    assert {r.path_id for r in coastline.sample_coast(spark, 90).groupBy("path_id").agg(F.count_distinct("part_id").alias("n")).where("n > 1").collect()} == {f"sample#{len(coastline.SAMPLE_LANDS) - 1}"}


def test_contours_close(spark):
    g = grid.mesh(spark, list(range(-10, 11)), list(range(-10, 11)), "lon * lon + lat * lat")
    lines = geometry.chain_segments(geometry.contour_segments(g, [25.5])).orderBy("line", "seq").collect()
    assert len({x.line for x in lines}) == 1 and (lines[0].lon, lines[0].lat) == (lines[-1].lon, lines[-1].lat)
    assert all(abs(math.hypot(x.lon, x.lat) - math.sqrt(25.5)) < 0.05 for x in lines)


def test_coastline_files(spark, tmp_path):
    box = np.array([[170.0, -10], [-170, -10], [-170, 10], [170, 10], [170, -10]])
    ice = np.array([[float(x), -70.0] for x in range(0, 361, 10)])
    raw = coastline.write_polygons([(1, box), (2, np.array([[0.0, 0], [1, 0], [0, 1]])), (5, ice)])
    (tmp_path / "c.b").write_bytes(raw + b"\0" * 50)
    got = coastline.read_coastline(spark, str(tmp_path / "c.b"))
    assert {r.level for r in got.select("level").distinct().collect()} == {1, 2, 5}
    assert got.where("level = 1").select("part_id").distinct().count() == 3
    assert got.where("level = 5").agg(F.min("lat")).first()[0] == -90
    assert coastline.read_coastline(spark, str(tmp_path / "c.b"), levels=[2]).count() == 3
    (tmp_path / "t.txt").write_text("0 0\n1 1\n\n5 5\n\n2 2\n3 3\n4 4\n")
    assert coastline.read_coastline(spark, str(tmp_path / "t.txt")).count() == 5
    with pytest.raises(GeoError):
        coastline.read_coastline(spark, "x.doc")


def test_grid_files(spark, tmp_path):
    lon, lat = np.arange(-175.0, 180, 10), np.arange(-85.0, 90, 10)
    z = np.sin(np.radians(lon))[None, :] * np.cos(np.radians(lat))[:, None]
    (tmp_path / "g.nc").write_bytes(grids.write_netcdf(lon, lat, z))
    got = grids.read_grid(spark, str(tmp_path / "g.nc"), region=Region("s", (170, 190), (-10, 10)))
    assert sorted({r.lon for r in got.collect()}) == [165, 175, 185, 195]
    assert grids.read_grid(spark, str(tmp_path / "g.nc")).count() == 36 * 18
    grids.read_grid(spark, str(tmp_path / "g.nc")).write.parquet(str(tmp_path / "g.parquet"))
    assert grids.read_grid(spark, str(tmp_path / "g.parquet"), stride=(2, 3)).count() == 9 * 12
    with pytest.raises(GeoError):
        grids.read_grid(spark, "a.png")


def test_cache(spark):
    c = FrameCache(2)
    for k in range(3):
        c.put({"k": k}, spark.range(k + 1))
    assert c.get({"k": 0}) is None and c.get({"k": 2}).count() == 3 and c.stats()["hits"] == 1
    c.clear()


def test_sessions_equal_batch(spark, sf):
    from loxodrome.streaming.sessions import batch_passes, session_passes

    e = spark.read.parquet(f"{sf}/events.parquet")
    assert sorted(session_passes(e, 86400).collect()) == sorted(batch_passes(e, 86400).collect())


def test_sessions_stream(spark, sf, tmp_path):
    from loxodrome.streaming.sessions import session_passes

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = session_passes(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 86400, late="60 days")
    q = s.writeStream.format("memory").queryName("passes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("passes").count() <= session_passes(e, 86400).count()


def test_filter_on_mollweide_stays_above_its_steps(spark):
    p = spark.range(-90, 91, 5).selectExpr("id * 2e0 AS lon", "id * 1e0 AS lat")
    kept = projection.project(p, "mollweide").where("NOT isnan(x) AND y >= 0e0")
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    back = projection.unproject(kept.withColumnsRenamed({"lon": "lon0", "lat": "lat0"}), "mollweide").where("lat0 < 89e0")
    got = back.selectExpr("count(*) AS n", "max(abs(lat - lat0)) AS d").first()
    assert got.n == 18 and got.d < 1e-6
