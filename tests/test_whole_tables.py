"""Queries over whole tables, against plain loops on events written for the test."""

import collections
import datetime
import math

import pytest

from loxodrome.plans import registry
from loxodrome.sources import base

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write_events(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return str(path)


def event(k, user):
    return (k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k), user, "abc"[k % 3], float((k * 31) % 101), "{}")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Ids on both sides of 5000, a value that depends on the side."""
    rows = [event(k, k % 40)[:4] + (float(k % 50) + (1000.0 if k >= 5000 else 0.0), "{}") for k in range(4000, 6500)]
    return write_events(spark, tmp_path_factory.mktemp("many"), rows), rows


def test_grid_averages_every_event(spark, many):
    d, events = many
    cells = collections.defaultdict(list)
    for k, _, user, _, value, _ in events:
        cells[k * 7 % 18, (user * 5 + k) % 36].append(value)
    got = {(r.i, r.j): r.z for r in base.grid(spark, d).collect()}
    assert len(got) == 18 * 36
    for cell, z in got.items():
        assert math.isnan(z) if cell not in cells else z == pytest.approx(sum(cells[cell]) / len(cells[cell]))
    masked = {(r.i, r.j): r.masked for r in registry.QUERIES["mask_threshold"](spark, d).collect()}
    assert masked == {cell: not math.isnan(z) and z < 50 for cell, z in got.items()}


# --- clipping and scenes: every track and every point ------------------------------------------------------


@pytest.fixture(scope="module")
def voyages(spark, tmp_path_factory):
    """Thirty tracks, ids 3 to 32: two passes of ten and nine events, then one event alone. Points as base.points derives them."""
    rows = []
    for k in range(600):
        _, _, user, kind, value, props = event(k, 3 + k * 7 % 30)
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=20 * k, days=3 * (k >= 300) + 3 * (k >= 570))
        rows.append((29 * k, ts, user, kind, value, props))  # ids spread over all latitudes
    by_track = collections.defaultdict(list)
    for k, ts, user, _, value, _ in rows:
        by_track[user].append(((user * 37 + k * 13) % 36000 / 100 - 180, k % 17900 / 100 - 89.95, ts, math.nan if k % 97 == 0 else value))
    return write_events(spark, tmp_path_factory.mktemp("voyages"), rows), by_track


def counts(df):
    return {(r.scene_id, r.kind): r.n for r in df.collect()}


def lines(by_track):
    """Rows of the stacked lines, of one side of the bands, of the labels: values, values in runs of two at least, tracks with a value."""
    runs = []
    for points in by_track.values():
        run = 0
        for value in [p[3] for p in points] + [math.nan]:
            if math.isnan(value):
                runs.append(run)
                run = 0
            else:
                run += 1
    return sum(runs), sum(n for n in runs if n > 1), sum(any(not math.isnan(p[3]) for p in v) for v in by_track.values())


def test_clip_boundary_clips_every_track(spark, voyages):
    d, by_track = voyages
    want = {(str(t), k, round(lon, 6), round(lat, 6)) for t, points in by_track.items() for k, (lon, lat, *_) in enumerate(points) if -100 <= lon <= 120 and -50 <= lat <= 60}
    assert any(int(t) >= 20 for t, *_ in want)
    got = registry.QUERIES["clip_boundary"](spark, d).collect()
    assert {(r.path_id, int(r.source), r.lon, r.lat) for r in got if r.source == int(r.source)} == want


def test_scenes_draw_every_track_and_point(spark, voyages):
    d, by_track = voyages
    in_passes = 0
    for points in by_track.values():
        passes = [1]
        for (*_, before, _), (*_, now, _) in zip(points, points[1:], strict=False):
            passes[-1:] = [passes[-1] + 1] if (now - before).total_seconds() <= 86400 else [passes[-1], 1]
        in_passes += sum(n for n in passes if n > 1)
    assert in_passes == 30 * 19
    assert counts(registry.QUERIES["track_scene"](spark, d))["map", "track"] == in_passes
    assert counts(registry.QUERIES["points_scene"](spark, d))["map", "points"] == sum(map(len, by_track.values()))


def test_series_hold_every_track(spark, voyages):
    d, by_track = voyages
    line, band, labels = lines(by_track)
    assert counts(registry.QUERIES["timeseries_scene"](spark, d)) == {("series", "series"): line + 2 * band + labels + 2 * len(by_track)}
    assert counts(registry.QUERIES["panel_union"](spark, d))["tile2", "series"] == line + labels
