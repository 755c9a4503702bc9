"""Clipping of whole tables of paths against a plain loop over their vertices."""

import math

import numpy as np
import pytest

from loxodrome.operators import geometry

NAN = math.nan


def plain(points, crs, lon_limit, lat_limit):
    """part_id, seq, lon, lat, source of one path."""
    seen = lambda lon, lat: bool(geometry.inside([lon], [lat], crs, lon_limit, lat_limit)[0])
    ok, out, part = [seen(*p) for p in points], [], 0
    for k, (lon, lat) in enumerate(points):
        if k and ok[k] and not ok[k - 1]:
            part += bool(out)
        if k and ok[k] != ok[k - 1] and np.isfinite([*points[k - 1], lon, lat]).all():
            (x, y), (x2, y2) = (points[k - 1], points[k]) if ok[k - 1] else (points[k], points[k - 1])
            d, lo, hi = (x2 - x + 180) % 360 - 180, 0.0, 1.0
            for _ in range(16):
                m = (lo + hi) / 2
                lo, hi = (m, hi) if seen(x + m * d, y + m * (y2 - y)) else (lo, m)
            out.append((part, len(out), x + lo * d, y + lo * (y2 - y), k - 1 + lo if ok[k - 1] else k - lo))
        if ok[k]:
            out.append((part, len(out), lon, lat, float(k)))
    return out


@pytest.mark.parametrize("crs, lon_limit, lat_limit", [("equirectangular", (-100.0, 120.0), (-50.0, 60.0)), ("orthographic", (-180.0, 180.0), (-90.0, 90.0)), ("mollweide", (100.0, 250.0), (-40.0, 90.0))])
def test_clip_paths_as_a_plain_loop(spark, crs, lon_limit, lat_limit):
    paths = {p: [((k * 37 * (p + 3) % 360) - 180.0 if (k + p) % 11 else (NAN, None, math.inf)[p % 3], (k * 17 + p * 29) % 170 - 85.0) for k in range(40)] for p in range(12)}
    paths |= {20: [(0.0, 0.0)], 21: [(-179.0, 89.0)], 22: [(179.0, -89.0), (0.0, 0.0), (179.0, -89.0), (1.0, 1.0)], None: [(0.0, 10.0), (170.0, -80.0), (5.0, 5.0)]}
    rows = [(p, 10 * k, *xy) for p, points in paths.items() for k, xy in enumerate(points)]
    got = geometry.clip_paths(spark.createDataFrame(rows[::-1], "path_id int, seq long, lon double, lat double"), crs, lon_limit, lat_limit)
    by = {}
    for r in got.collect():
        by.setdefault(r.path_id, []).append(tuple(r)[1:])
    for p, points in paths.items():
        want = plain([tuple(NAN if v is None else v for v in xy) for xy in points], crs, lon_limit, lat_limit)
        have = sorted(by.get(p, []), key=lambda r: r[1])
        assert [r[:2] for r in have] == [r[:2] for r in want]
        assert np.allclose([r[2:] for r in have], [r[2:] for r in want], rtol=0, atol=1e-12)


def test_clip_paths_calls_no_function_for_each_path(spark):
    """A hundred thousand tracks are as many calls, and every cut segment sixteen, where a path is a group."""
    paths = spark.createDataFrame([], "path_id int, seq long, lon double, lat double")
    assert "FlatMapGroups" not in geometry.clip_paths(paths, "equirectangular")._jdf.queryExecution().optimizedPlan().toString()
    assert geometry.clip_paths(paths, "equirectangular").count() == 0
