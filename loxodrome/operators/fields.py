"""Statistics over values that may have gaps: quantiles, limits, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.operators.tracks import good


def quantile(df: DataFrame, value: str, percents: list[float], by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Interpolated quantiles (type 7) of the finite values, one column q for each percent, NaN without any. ``approximate`` trades exactness for bounded state."""
    if any(not 0 <= p <= 100 for p in percents):
        raise GeoError("quantile:OutOfRange", str(percents))
    fn = (lambda p: F.percentile_approx(v, F.lit(p / 100), F.lit(10000))) if approximate else (lambda p: F.percentile(v, F.lit(p / 100)))
    v = F.when(good(value), F.col(value))
    return df.groupBy(*(by or [])).agg(*(F.coalesce(fn(p).cast("double"), F.lit(float("nan"))).alias(f"q{p:g}".replace(".", "_")) for p in percents))


def _limits(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Equal or missing limits open to half a unit each side."""
    ok = lo.isNotNull() & hi.isNotNull() & (hi > lo)
    mid = F.coalesce((lo + hi) / 2, F.lit(0.0))
    return F.when(ok, lo).otherwise(mid - 0.5), F.when(ok, hi).otherwise(mid + 0.5)


def symmetric_limits(df: DataFrame, value: str, percent: float = 98) -> DataFrame:
    q = F.percentile(F.when(good(value), F.abs(value)), F.lit(percent / 100))
    top = df.agg(q.alias("q")).select(F.when(F.col("q") > 0, F.col("q")).otherwise(0.5).alias("q"))
    return top.select((-F.col("q")).alias("lo"), F.col("q").alias("hi"))


def value_limits(df: DataFrame, value: str) -> DataFrame:
    v = F.when(good(value), F.col(value))
    a = df.agg(F.min(v).alias("a"), F.max(v).alias("b"))
    lo, hi = _limits(F.col("a"), F.col("b"))
    return a.select(lo.alias("lo"), hi.alias("hi"))


def percentile_limits(df: DataFrame, value: str, percents: tuple[float, float] = (2, 98), compat: bool = False) -> DataFrame:
    """Limits at two percents. compat: percents divided by 100 once more, as one published implementation does."""
    f = 10000 if compat else 100
    v = F.when(good(value), F.col(value))
    a = df.agg(F.percentile(v, F.lit(percents[0] / f)).alias("a"), F.percentile(v, F.lit(percents[1] / f)).alias("b"))
    lo, hi = _limits(F.col("a"), F.col("b"))
    return a.select(lo.alias("lo"), hi.alias("hi"))


def shared_limits(frames: list[DataFrame], value: str) -> DataFrame:
    """One pair of limits for several maps; a single value opens to one unit each side."""
    every = frames[0].select(value)
    for f in frames[1:]:
        every = every.unionByName(f.select(value))
    v = F.when(good(value), F.col(value))
    a = every.agg(F.percentile(v, F.lit(0.02)).alias("a"), F.percentile(v, F.lit(0.98)).alias("b"))
    ok = F.col("b") > F.col("a")
    mid = F.coalesce(F.col("a"), F.lit(0.0))
    return a.select(F.when(ok, F.col("a")).otherwise(mid - 1).alias("lo"), F.when(ok, F.col("b")).otherwise(mid + 1).alias("hi"))


def bounding_box(df: DataFrame, padding: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Finite extent, widened by a share of its span (at least of 1e-6), latitudes kept on the globe."""
    ok = good("lon") & good("lat")
    a = df.where(ok).groupBy(*(by or [])).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    px, py = padding * F.greatest(F.col("e") - F.col("w"), F.lit(1e-6)), padding * F.greatest(F.col("n") - F.col("s"), F.lit(1e-6))
    return a.select(*(by or []), (F.col("w") - px).alias("west"), (F.col("e") + px).alias("east"), F.greatest(F.lit(-90.0), F.col("s") - py).alias("south"), F.least(F.lit(90.0), F.col("n") + py).alias("north"))


def range_flags(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Whether any value lies under or over the limits (a colour bar's end caps)."""
    v = F.when(good(value), F.col(value))
    return df.agg(F.coalesce(F.bool_or(v < lo), F.lit(False)).alias("has_under"), F.coalesce(F.bool_or(v > hi), F.lit(False)).alias("has_over"))


def end_caps(flags: DataFrame, bar_length: float, cap_length: float = 10.0, arrows: str = "auto") -> DataFrame:
    """side, at, tip: a colour bar's triangles, from its ends outwards. flags: of range_flags; "auto" draws those the data asks for, "on" both, "off" none."""
    if arrows not in ("auto", "on", "off"):
        raise GeoError("colorbar:BadArrows", arrows)
    wanted = {"auto": lambda c: F.col(c), "on": lambda c: F.lit(True), "off": lambda c: F.lit(False)}[arrows]
    cap = lambda side, at, tip, flag: F.struct(F.lit(side).alias("side"), F.lit(float(at)).alias("at"), F.lit(float(tip)).alias("tip"), wanted(flag).alias("drawn"))
    both = F.array(cap("low", 0, -cap_length, "has_under"), cap("high", bar_length, bar_length + cap_length, "has_over"))
    return flags.select(F.explode(both).alias("c")).where("c.drawn").select("c.side", "c.at", "c.tip")


def marker_areas(df: DataFrame, size: str, size_range: tuple[float, float] = (16, 400), scale: str = "area", default: float = 36) -> DataFrame:
    """df with area: sizes mapped to the range by area or radius; no size, the default; all alike, the middle."""
    if scale not in ("area", "radius"):
        raise GeoError("overlayPoints:BadScale", scale)
    v = F.when(good(size), F.col(size))
    d = df.crossJoin(F.broadcast(df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))))
    span = F.col("_hi") - F.col("_lo")
    frac = (v - F.col("_lo")) / F.when(span > 0, span)
    a, b = map(float, size_range)
    area = (a**0.5 + frac * (b**0.5 - a**0.5)) ** 2 if scale == "radius" else a + frac * (b - a)
    return d.withColumn("area", F.when(v.isNull(), float(default)).when(span > 0, area).otherwise((a + b) / 2)).drop("_lo", "_hi")
