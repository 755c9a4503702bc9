"""Golden values, round trips and properties of the scalar operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.functions import geo, ticks
from loxodrome.model import PROJECTIONS, Crs, Region
from loxodrome.operators import geometry, projection
from loxodrome.plans import options, scene
from loxodrome.plans.registry import sample_crs


def one(spark, expr):
    return spark.range(1).select(F.expr(expr)).first()[0]


def test_wrap_is_half_open_and_closed(spark):
    assert one(spark, geo.wrap_longitude("180e0")) == -180
    assert one(spark, geo.wrap_longitude("180e0", "0e0", "closed")) == 180
    assert one(spark, geo.wrap_longitude("(-541e0)")) == 179


def test_golden_values(spark):
    x, y = geometry.forward([0.0], [35.0], "mercator")
    assert y[0] == pytest.approx(0.6528365797197981, abs=1e-15)
    c = Crs("lambertconformal", center_longitude=-96, center_latitude=23, standard_parallel=33, standard_parallel2=45)
    assert c.cone_constant == pytest.approx(0.6304776973, abs=1e-10)
    x, y = geometry.forward([-75.0], [35.0], c)
    assert (x[0], y[0]) == (pytest.approx(0.2966784599, abs=1e-9), pytest.approx(0.2462112293, abs=1e-9))
    assert Crs("albers", standard_parallel=29.5, standard_parallel2=45.5).cone_constant == pytest.approx(0.6028370046288244, abs=1e-14)
    x, y = geometry.forward([0.0], [70.0], Crs("polarstereographic", standard_parallel=71))
    assert math.hypot(x[0], y[0]) == pytest.approx(0.3430474163, abs=1e-9)
    x, y = geometry.forward([0.0], [87.0], "mercator")
    assert np.isnan(y[0])
    x, y = geometry.forward([359.0], [10.0], "robinson")
    assert x[0] == pytest.approx(-0.014744471, abs=1e-8)
    km = one(spark, geo.great_circle_km("2.3522e0", "48.8566e0", "(-74.006e0)", "40.7128e0"))
    assert km == pytest.approx(5837.24750061355, abs=1e-6)
    assert one(spark, geo.bearings("2.3522e0", "48.8566e0", "(-74.006e0)", "40.7128e0")[0]) == pytest.approx(291.7939, abs=1e-4)


@pytest.mark.parametrize("name", PROJECTIONS)
def test_round_trip_and_spark_equals_numpy(spark, name):
    rng = np.random.default_rng(42)
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(-150, 150, 300), rng.uniform(-80, 80, 300), strict=True)]
    c = sample_crs(name)
    df = projection.project(spark.createDataFrame(pts, "lon double, lat double"), c)
    back = projection.unproject(df.withColumnsRenamed({"lon": "lon0", "lat": "lat0"}), c).toPandas()
    x, y = geometry.forward(back.lon0, back.lat0, c)
    assert np.allclose(back.x, x, atol=1e-12, equal_nan=True) and np.allclose(back.y, y, atol=1e-12, equal_nan=True)
    ok = back.x.notna()
    assert ok.sum() > 50 and back.lon[ok].notna().all()
    assert np.abs(np.mod(back.lon - back.lon0 + 180, 360) - 180)[ok].max() < 1e-8 and np.abs(back.lat - back.lat0)[ok].max() < 1e-8


def test_gaps_stay_gaps(spark):
    df = spark.createDataFrame([(float("nan"), 10.0), (10.0, float("nan")), (None, 5.0)], "lon double, lat double")
    for name in ("robinson", "mollweide", "albers", "gnomonic"):
        assert all(math.isnan(r.x) and math.isnan(r.y) for r in projection.project(df, sample_crs(name)).collect())


@settings(max_examples=50, deadline=None)
@given(st.floats(-1e4, 1e4), st.floats(1e-3, 1e4))
def test_nice_ticks_are_multiples_inside(lo, span):
    t = ticks.nice_ticks(lo, lo + span)
    step = ticks.nice_step(lo, lo + span)
    assert all(lo - 1e-9 * abs(lo) - 1e-9 <= v <= lo + span + 1e-9 * abs(lo) + 1e-9 for v in t) and len(t) <= 7 and step >= span / 6


def test_equal_area(spark):
    df = spark.createDataFrame([(10.0, 20.0), (-60.0, 50.0)], "lon double, lat double")
    for name in ("mollweide", "hammer", "sinusoidal", "albers", "lambert"):
        for r in projection.scale_factors(df, sample_crs(name)).collect():
            assert r.area_scale == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize(
    ("make", "reason"),
    [
        (lambda: Crs("nowhere"), "crs:UnknownProjection"), (lambda: Crs("albers"), "crs:MissingParallel"), (lambda: Crs("albers", standard_parallel=20, standard_parallel2=-20), "crs:DegenerateConic"),
        (lambda: Crs("albers", standard_parallel=90), "crs:BadStandardParallel"), (lambda: Crs("polarstereographic", standard_parallel=-71), "crs:PolarParallelSign"), (lambda: Region.preset("atlantis"), "region:UnknownPreset"),
        (lambda: Region("x", (170, -170), (0, 1)), "region:InvalidBoundingBox"), (lambda: Region.of_outline([]), "region:EmptyOutline"), (lambda: ticks.nice_ticks(1, 1), "niceTicks:EmptyRange"),
        (lambda: projection.great_circle_form(), "greatCircle:AmbiguousForm"), (lambda: projection.great_circle_form(None, 1.0), "greatCircle:IncompleteForm"), (lambda: options.translate({"Material": 1}), "v1Options:NoEquivalent"),
        (lambda: scene.avoid_collisions([0, 0, 1, 1], [], (0, 0)), "avoidRectCollisions:ZeroDirection"),
    ],
)
def test_errors(make, reason):
    with pytest.raises(GeoError) as e:
        make()
    assert e.value.identifier == reason


def test_options_translate():
    t = options.translate({"Projection": "robinson", "CoastlineColor": "k", "ScaleBar": True, "NorthArrowColor1": "w", "Else": 1})
    assert t["crs"] == {"name": "robinson"} and t["elements"]["Coastline"] == {"Color": "k"} and t["kept"] == {"Else": 1}
    kinds = [k for _, k, *_ in options.OPTIONS]
    assert (len(kinds), kinds.count("none")) == (120, 33)


def test_rectangles():
    assert scene.avoid_collisions([0, 0, 10, 10], [[5, 5, 10, 10]], (0, 1)) == [0, 19, 10, 10]
    assert scene.plotted_box([0, 0, 10, 10], 2) == [0, 2.5, 10, 5]


def test_sql_functions(spark):
    projection.register_sql(spark)
    assert spark.sql("select wrap_longitude(190D), is_finite(double('NaN'))").first() == (-170.0, False)
