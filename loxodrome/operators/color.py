"""Colour maps as rows (name, idx, r, g, b), banding, and colours for values."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.operators.tracks import good

PRESETS = ["divergent", "sequential", "viridis", "magma", "cividis", "parula", "jet", "turbo", "gray"]

#: Published control polynomials and anchors, resampled to any length; (fixed values).
#: turbo: sixth-order fit of the published map, lowest order first.
TURBO = {
    "r": [0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943],
    "g": [0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604],
    "b": [0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973],
}
#: Eleven even anchors of perceptually ordered maps.
ANCHORS = {
    "viridis": "440154 482475 414487 355f8d 2a788e 21918c 22a884 44bf70 7ad151 bddf26 fde725",
    "magma": "000004 140e36 3b0f70 641a80 8c2981 b73779 de4968 f7705c fe9f6d fecf92 fcfdbf",
    "cividis": "00224e 123570 3b496c 575d6d 707173 8a8678 a59c74 c3b369 e1cc55 f5dc4d fee838",
    "parula": "3e26a8 4741e5 4367fd 2f87f7 1ba2e5 0fb7c9 36c8a0 7fcb5b d1bf27 fdbf3d f9fb15",
}


def _ramp(name: str, n: int) -> np.ndarray:
    t = np.linspace(0, 1, n)
    if name == "gray":
        rgb = np.column_stack([t, t, t])
    elif name == "sequential":
        light = 1 - 0.85 * t
        rgb = np.column_stack([light * (1 - 0.75 * t), light * (1 - 0.35 * t), light])
    elif name == "divergent":
        u = np.linspace(-1, 1, n)
        s = np.abs(u)
        light, cold = 1 - 0.65 * s**0.9, u < 0
        rgb = np.column_stack([
            light * np.where(cold, 1 - 0.95 * s, 1),
            light * np.where(cold, 1 - 0.55 * s, 1 - 0.62 * s),
            light * np.where(cold, 1, 1 - 0.95 * s),
        ])
    elif name == "jet":
        hat = lambda c: np.clip(1.5 - np.abs(4 * t - c), 0, 1)
        rgb = np.column_stack([hat(3), hat(2), hat(1)])
    elif name == "turbo":
        rgb = np.column_stack([np.polynomial.polynomial.polyval(t, TURBO[c]) for c in "rgb"])
    else:
        a = np.array([[int(h[k : k + 2], 16) / 255 for k in (0, 2, 4)] for h in ANCHORS[name].split()])
        rgb = np.column_stack([np.interp(t, np.linspace(0, 1, len(a)), a[:, k]) for k in range(3)])
    return np.clip(rgb, 0, 1)


def read_tables(path: str) -> dict[str, np.ndarray]:
    """Colour maps of a text file: ``# name rows``, then rows of three numbers."""
    if not os.path.exists(path):
        raise GeoError("colormaps:DataFileMissing", path)
    out, name = {}, None
    with open(path) as f:
        for line in f:
            part = line.split()
            if len(part) == 3 and part[0] == "#" and part[2].isdigit():
                name, out[part[1]] = part[1], []
            elif name and len(part) == 3 and part[0] != "#":
                out[name].append([float(v) for v in part])
    return {k: np.array(v) for k, v in out.items()}


def colormap(name: str | np.ndarray, n: int = 256, tables: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """n rows of r, g, b; ``tables`` (see read_tables) take precedence and are resampled, or given as they are at their own length."""
    if not isinstance(name, str):
        m = np.asarray(name, float)
        if m.ndim != 2 or m.shape[1] != 3 or not np.isfinite(m).all() or m.min() < 0 or m.max() > 1:
            raise GeoError("colormaps:NotAColormap")
        return m
    key = name.lower()
    if tables and key in tables:
        t = tables[key]
        return t if len(t) == n else np.column_stack([np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(t)), t[:, k]) for k in range(3)])
    if key not in PRESETS:
        raise GeoError("colormaps:UnknownPreset", name)
    return _ramp(key, n)


def discretize(m: np.ndarray, levels: int | None) -> np.ndarray:
    """Bands of one colour each, taken from their middle; as many rows as before."""
    if not levels or levels < 1:
        return m
    n = len(m)
    band = np.minimum(np.arange(n) * levels // n, levels - 1)
    return m[np.floor((band + 0.5) / levels * (n - 1) + 0.5).astype(int)]


def colormap_rows(spark: SparkSession, name: str | np.ndarray, n: int = 256, levels: int | None = None) -> DataFrame:
    m = discretize(colormap(name, n), levels)
    return spark.createDataFrame([(name if isinstance(name, str) else "custom", i, *map(float, c)) for i, c in enumerate(m)], "name string, idx int, r double, g double, b double")


def color_index(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Row of the map for a value, clamped to its ends; 0 for a gap."""
    t = (value - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)
    return F.when(good(value), F.least(F.greatest(F.floor(t * (n - 1) + 0.5), F.lit(0)), F.lit(n - 1))).otherwise(0).cast("int")


def truecolor(
    df: DataFrame, cmap: str | np.ndarray = "divergent", value: str = "z", limits: tuple[float, float] | None = None, under: tuple | None = None, over: tuple | None = None,
    masked: str | None = None, mask_color: tuple = (0.7, 0.7, 0.7), nan_color: tuple = (1.0, 1.0, 1.0), shade: str | None = None, levels: int | None = None,
) -> DataFrame:
    """df with r, g, b. Later rules win: map, under and over, mask, gap; then shading darkens all."""
    spark = df.sparkSession
    m = discretize(colormap(cmap, 256), levels)
    if limits is None:
        v = F.when(good(value), F.col(value))
        a = df.agg(F.min(v), F.max(v)).first()
        limits = (a[0], a[1]) if a[0] is not None and a[1] > a[0] else (0.0, 1.0)
    lo, hi = map(F.lit, map(float, limits))
    table = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(m)], "_idx int, r double, g double, b double")  # as long as the colour map
    out = df.drop("r", "g", "b").withColumn("_idx", color_index(F.col(value), lo, hi, len(m))).join(F.broadcast(table), "_idx").drop("_idx")
    ok = good(value)
    for k, c in enumerate("rgb"):
        col = F.col(c)
        if under is not None:
            col = F.when(ok & (F.col(value) < lo), float(under[k])).otherwise(col)
        if over is not None:
            col = F.when(ok & (F.col(value) > hi), float(over[k])).otherwise(col)
        if masked is not None:
            col = F.when(F.col(masked), float(mask_color[k])).otherwise(col)
        col = F.when(ok, col).otherwise(float(nan_color[k]))
        out = out.withColumn(c, col * F.col(shade) if shade else col)
    return out
