"""Grid readers: long tables (parquet, csv, json) and classic NetCDF files. GRID rows: grid_id, i, j, lat, lon, z.

A region becomes index ranges before cells are read: of a table as filters Spark
pushes to the scan, of a file as row blocks, so that cells outside are never decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.model import Region
from loxodrome.operators import grid

SCHEMA = "grid_id string, i int, j int, lat double, lon double, z double"
#: Names under which axes and values are looked for, first match first (fixed values).
LON_NAMES = ["lon", "longitude", "x", "Longitude", "LON"]
LAT_NAMES = ["lat", "latitude", "y", "Latitude", "LAT"]
VALUE_NAMES = ["z", "Z", "elevation", "topo", "height", "data", "band1", "Band1", "ewh", "value", "grid"]


def pick(names: list[str], candidates: list[str], what: str) -> str:
    for c in candidates:
        if c in names:
            return c
    raise GeoError("readGrid:NoAxes" if what != "value" else "readGrid:VariableNotFound", f"{what} in {names}")


def read_grid(spark: SparkSession, path: str, variable: str = "", region: Region | str | None = None, stride: tuple[int, int] = (1, 1), rows_per_task: int = 64) -> DataFrame:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext in ("png", "jpg", "jpeg", "tif", "tiff"):
        raise GeoError("readGrid:ImageInputNotYetAvailable", path)
    if ext in ("nc", "cdf"):
        return _read_netcdf(spark, path, variable, region, stride, rows_per_task)
    if ext not in ("parquet", "csv", "json"):
        raise GeoError("readGrid:UnknownFormat", path)
    reader = spark.read.option("header", True).option("inferSchema", True) if ext == "csv" else spark.read
    raw = reader.format(ext).load(path)
    lon, lat = pick(raw.columns, LON_NAMES, "longitude"), pick(raw.columns, LAT_NAMES, "latitude")
    if variable and variable not in raw.columns:
        raise GeoError("readGrid:VariableNotFound", variable)
    z = variable or pick(raw.columns, VALUE_NAMES, "value")
    df = raw.select(F.col("grid_id") if "grid_id" in raw.columns else F.lit(path).alias("grid_id"), *(F.col(c).cast("int") if c in raw.columns else F.lit(None).cast("int").alias(c) for c in ("i", "j")), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.coalesce(F.col(z).cast("double"), F.lit(float("nan"))).alias("z"))
    if "i" not in raw.columns or "j" not in raw.columns:
        for k, c in (("i", "lat"), ("j", "lon")):
            values = [r[0] for r in df.select(c).distinct().orderBy(c).collect()]  # an axis
            df = df.drop(k).join(F.broadcast(spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"{k} int, {c} double")), c)
        df = df.select("grid_id", "i", "j", "lat", "lon", "z")
    if region is not None:
        r = Region.preset(region) if isinstance(region, str) else region
        df = grid.subset(df, r.lon, r.lat)
    if stride != (1, 1):
        df = grid.stride(_from_zero(df), *stride)
    return df


def _from_zero(df: DataFrame) -> DataFrame:
    low = df.agg(F.min("i").alias("_i"), F.min("j").alias("_j"))
    return df.crossJoin(F.broadcast(low)).withColumns({"i": F.col("i") - F.col("_i"), "j": F.col("j") - F.col("_j")}).drop("_i", "_j")


# --- classic NetCDF -----------------------------------------------------------------------------------

_TYPES = {1: (">i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}


def netcdf_header(raw: bytes) -> dict:
    """Dimensions and variables of a classic file (versions 1 and 2): name -> (dims, dtype, begin, attributes)."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise GeoError("readGrid:NotReadable", "no classic NetCDF header")
    wide, at = raw[3] == 2, 8

    def i4() -> int:
        nonlocal at
        at += 4
        return struct.unpack(">i", raw[at - 4 : at])[0]

    def name() -> str:
        nonlocal at
        n = i4()
        s = raw[at : at + n].decode()
        at += -(-n // 4) * 4
        return s

    def attributes() -> dict:
        nonlocal at
        i4()
        out = {}
        for _ in range(i4()):
            key, kind, n = name(), i4(), i4()
            dt, size = _TYPES[kind]
            out[key] = raw[at : at + n].decode() if kind == 2 else np.frombuffer(raw, dt, n, at)
            at += -(-n * size // 4) * 4
        return out

    i4()
    dims = [(name(), i4()) for _ in range(i4())]
    attributes()
    i4()
    variables = {}
    for _ in range(i4()):
        key = name()
        ids = [i4() for _ in range(i4())]
        att = attributes()
        kind = i4()
        i4()
        begin = struct.unpack(">q", raw[at : at + 8])[0] if wide else struct.unpack(">i", raw[at : at + 4])[0]
        at += 8 if wide else 4
        variables[key] = ([dims[d] for d in ids], *_TYPES[kind], begin, att)
    return variables


def _values(raw: bytes, var: tuple, first: int, count: int) -> np.ndarray:
    _, dt, size, begin, att = var
    v = np.frombuffer(raw, dt, count, begin + first * size).astype(float)
    for k in ("_FillValue", "missing_value"):
        if k in att:
            v = np.where(v == float(att[k][0]), np.nan, v)
    return v * float(att["scale_factor"][0] if "scale_factor" in att else 1) + float(att["add_offset"][0] if "add_offset" in att else 0)


def _read_netcdf(spark: SparkSession, path: str, variable: str, region: Region | str | None, stride: tuple[int, int], rows_per_task: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    want = Region.preset(region) if isinstance(region, str) else region

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                yield from cells(name, raw)

    def cells(name: str, raw: bytes) -> Iterator[pd.DataFrame]:
        variables = netcdf_header(raw)
        lon_v, lat_v = variables[pick(list(variables), LON_NAMES, "longitude")], variables[pick(list(variables), LAT_NAMES, "latitude")]
        if variable and variable not in variables:
            raise GeoError("readGrid:VariableNotFound", variable)
        flat = [k for k, v in variables.items() if len(v[0]) == 2]
        zname = variable or next((c for c in VALUE_NAMES if c in variables), flat[0] if flat else "")
        if not zname:
            raise GeoError("readGrid:VariableNotFound", "two-dimensional variable")
        z = variables[zname]
        lon, lat = _values(raw, lon_v, 0, lon_v[0][0][1]), _values(raw, lat_v, 0, lat_v[0][0][1])
        by_lat = z[0][0][0] == lat_v[0][0][0]
        i0, i1, cols, shown = 0, len(lat) - 1, np.arange(len(lon)), lon
        if want is not None:
            i0, i1 = grid.window_indices(lat, want.lat)
            if want.lon[1] - want.lon[0] < 360:
                origin = sum(want.lon) / 2 - 180
                shifted = origin + np.mod(lon - origin, 360)
                order = np.argsort(shifted, kind="stable")
                a, b = grid.window_indices(shifted[order], want.lon)
                cols, shown = order[a : b + 1], shifted
        cols = cols[:: stride[1]]
        if not by_lat:
            whole = _values(raw, z, 0, len(lat) * len(lon)).reshape(len(lon), len(lat)).T
        for n, i in enumerate(range(i0, i1 + 1, stride[0])):
            row = _values(raw, z, i * len(lon), len(lon)) if by_lat else whole[i]
            yield pd.DataFrame({"grid_id": name.rsplit("/", 1)[-1], "i": np.int32(n), "j": np.arange(len(cols), dtype=np.int32), "lat": lat[i], "lon": shown[cols], "z": row[cols]})

    return files.mapInPandas(decode, SCHEMA)


def write_netcdf(lon: np.ndarray, lat: np.ndarray, z: np.ndarray, name: str = "z") -> bytes:
    """A classic file with two axes and one variable, for fixtures and exchange."""

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    dims = struct.pack(">ii", 10, 2) + text("lat") + struct.pack(">i", len(lat)) + text("lon") + struct.pack(">i", len(lon))
    empty = struct.pack(">ii", 0, 0)

    def head(begins: list[int]) -> bytes:
        out = struct.pack(">ii", 11, 3)
        for key, ids, n, at in (("lat", [0], len(lat), begins[0]), ("lon", [1], len(lon), begins[1]), (name, [0, 1], len(lat) * len(lon), begins[2])):
            out += text(key) + struct.pack(">i", len(ids)) + b"".join(struct.pack(">i", k) for k in ids) + empty + struct.pack(">iii", 6, 8 * n, at)
        return b"CDF\x01" + struct.pack(">i", 0) + dims + empty + out

    start = len(head([0, 0, 0]))
    begins = [start, start + 8 * len(lat), start + 8 * (len(lat) + len(lon))]
    return head(begins) + np.asarray(lat, ">f8").tobytes() + np.asarray(lon, ">f8").tobytes() + np.asarray(z, ">f8").tobytes()


def header_axis(limits: tuple[float, float], n: int) -> np.ndarray:
    """Cell centres of a grid that only states its limits."""
    return limits[0] + (np.arange(n) + 0.5) * (limits[1] - limits[0]) / n
