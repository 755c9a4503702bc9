"""Coast and outline readers: binary polygons (big-endian integers), shapefiles, text blocks. PATH rows: path_id, part_id, seq, lon, lat, level.

Files are read by Spark (any store it reaches) and decoded on the executors, one file
a row; a polygon crossing the antimeridian is split afterwards by a window.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.operators.tracks import split_antimeridian

SCHEMA = "path_id string, part_id int, seq long, lon double, lat double, level int"
#: Shape types with parts (fixed values): polylines and polygons, plain, with z, with m.
SHAPES = {3, 5, 13, 15, 23, 25}
#: Levels of the outlines of the southern continent, whose ring is closed along the pole (fixed values).
POLAR_LEVELS = {5, 6}


def decode_polygons(raw: bytes, levels: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(level, points): headers of eleven integers, then pairs in millionths of a degree. A cut-off tail ends the reading."""
    at = 0
    while at + 44 <= len(raw):
        head = np.frombuffer(raw, ">i4", 11, at)
        n, level = int(head[1]), int(head[2]) & 0xFF
        at += 44
        if n < 0 or at + 8 * n > len(raw):
            return
        pts = np.frombuffer(raw, ">i4", 2 * n, at).reshape(n, 2) / 1e6
        at += 8 * n
        if level in levels and n:
            pts = pts.copy()
            spans_globe = level in POLAR_LEVELS and np.ptp(pts[:, 0]) >= 359
            pts[:, 0] = np.where(pts[:, 0] > 180, pts[:, 0] - 360, pts[:, 0])
            if spans_globe:
                pts = np.vstack([pts, [pts[-1, 0], -90.0], [pts[0, 0], -90.0], pts[:1]])
            yield level, pts


def decode_shapes(raw: bytes) -> Iterator[np.ndarray]:
    """Parts of a shapefile; record headers are big-endian, contents little-endian; null shapes are passed over."""
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != 9994:
        raise GeoError("readCoastline:NotAShapefile")
    at = 100
    while at + 12 <= len(raw):
        words = struct.unpack(">i", raw[at + 4 : at + 8])[0]
        kind = struct.unpack("<i", raw[at + 8 : at + 12])[0]
        if kind:
            if kind not in SHAPES:
                raise GeoError("readCoastline:UnsupportedShape", str(kind))
            n_parts, n_points = struct.unpack("<ii", raw[at + 44 : at + 52])
            first = [*np.frombuffer(raw, "<i4", n_parts, at + 52), n_points]
            pts = np.frombuffer(raw, "<f8", 2 * n_points, at + 52 + 4 * n_parts).reshape(n_points, 2)
            for a, b in zip(first, first[1:], strict=False):
                yield pts[a:b]
        at += 8 + 2 * words


def decode_text(text: str) -> Iterator[np.ndarray]:
    """Blocks of two columns between blank lines; a block of fewer than two points is no line."""
    for block in text.replace("\r\n", "\n").split("\n\n"):
        rows = [ln.replace(",", " ").split() for ln in block.split("\n")]
        pts = [(float(r[0]), float(r[1])) for r in rows if len(r) >= 2]
        if len(pts) >= 2:
            yield np.array(pts)


FORMATS = {"b": "polygons", "shp": "shape", "txt": "text", "dat": "text", "xy": "text"}


#: Invented lands: middle longitude and latitude, half width and half height in degrees. The last one lies across the antimeridian.
SAMPLE_LANDS = [(-95.0, 45.0, 30.0, 20.0), (-60.0, -15.0, 18.0, 28.0), (20.0, 5.0, 22.0, 30.0), (75.0, 48.0, 55.0, 20.0), (134.0, -25.0, 19.0, 12.0), (178.0, -10.0, 9.0, 14.0)]


def sample_coast(spark: SparkSession, points: int = 360, split: str = "interpolate") -> DataFrame:
    """A coast without a file: closed outlines made by rule, an ellipse with bays for each land; for trials and tests."""
    lands = spark.createDataFrame([(k, *land) for k, land in enumerate(SAMPLE_LANDS)], "k int, lon0 double, lat0 double, a double, b double")
    turn = f"(k2 * 2e0 * pi() / {float(points)}e0)"
    lon, lat = f"lon0 + a * cos({turn}) * (1e0 + 0.15e0 * sin(3e0 * {turn} + k))", f"lat0 + b * sin({turn}) * (1e0 + 0.1e0 * cos(5e0 * {turn}))"
    v = lands.withColumn("k2", F.explode(F.sequence(F.lit(0), F.lit(points))))
    lines = v.selectExpr("concat('sample#', k) AS path_id", "0 AS part_id", "CAST(k2 AS LONG) AS seq", f"{lon} AS u", f"{lat} AS lat").selectExpr("path_id", "part_id", "seq", "u - 360e0 * floor((u + 180e0) / 360e0) AS lon", "lat", "1 AS level")
    return lines if split == "none" else split_lines(lines, split)


def read_coastline(spark: SparkSession, path: str, format: str = "auto", levels: range | list[int] = range(1, 7), split: str = "interpolate") -> DataFrame:
    """Lines of a file or folder, split at the antimeridian ("interpolate", "break" or "none")."""
    kind = FORMATS.get(path.rsplit(".", 1)[-1].lower()) if format == "auto" else format
    if kind not in ("polygons", "shape", "text"):
        raise GeoError("readCoastline:UnknownFormat", path)
    wanted = set(levels)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                if kind == "polygons":
                    lines = decode_polygons(raw, wanted)
                else:
                    lines = ((0, p) for p in (decode_shapes(raw) if kind == "shape" else decode_text(raw.decode())))
                for n, (level, pts) in enumerate(lines):
                    yield pd.DataFrame({"path_id": f"{name.rsplit('/', 1)[-1]}#{n}", "part_id": np.int32(0), "seq": np.arange(len(pts)), "lon": pts[:, 0].astype(float), "lat": pts[:, 1].astype(float), "level": np.int32(level)})

    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, SCHEMA)
    return lines if split == "none" else split_lines(lines, split)


def split_lines(lines: DataFrame, mode: str = "interpolate") -> DataFrame:
    """PATH rows cut where they cross the antimeridian."""
    level = lines.groupBy("path_id").agg(F.first("level").alias("level"))
    parts = split_antimeridian(lines.select("path_id", "seq", "lon", "lat"), track="path_id", mode=mode)
    order = F.row_number().over(Window.partitionBy("path_id").orderBy("seq", "sub")) - 1
    return parts.withColumn("seq", order.cast("long")).drop("sub").join(level, "path_id").select("path_id", F.col("part_id").cast("int"), "seq", "lon", "lat", "level")


def summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy("level").agg(F.count_distinct("path_id", "part_id").alias("n_parts"), F.count(F.lit(1)).alias("n_points"))


def write_polygons(pts: list[tuple[int, np.ndarray]]) -> bytes:
    """The binary form, for fixtures and exchange: (level, points) in degrees."""
    out = []
    for k, (level, p) in enumerate(pts):
        lon = np.where(p[:, 0] < 0, p[:, 0] + 360, p[:, 0])
        body = np.round(np.column_stack([lon, p[:, 1]]) * 1e6).astype(">i4")
        out += [np.array([k, len(p), level, 0, 0, 0, 0, 0, 0, 0, 0], ">i4").tobytes(), body.tobytes()]
    return b"".join(out)
