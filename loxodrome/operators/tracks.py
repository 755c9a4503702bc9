"""Along-track series: splitting into passes, the antimeridian, runs, ribbons and stacked series. One window per track; nothing global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.errors import GeoError
from loxodrome.functions import geo
from loxodrome.model import Region
from loxodrome.operators.projection import in_region

NAN = float("nan")


def good(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _by(track: list[str], *extra: str):
    return Window.partitionBy(*track, *extra).orderBy("seq")


def split_tracks(
    df: DataFrame, track: list[str] | str = "track_id", time_gap: float | str | None = "auto", time_factor: float = 5.0, spatial_jump_km: float | None = None,
    group: str | None = None, max_duration: float | None = None, max_points: int | None = None, min_points: int = 2, region: Region | None = None,
) -> DataFrame:
    """df (track, seq, lon, lat, time) with pass_id: 1, 2, ... for the passes that survive, NULL for dropped samples and those outside the region.

    A pass ends where the group changes, or where time or distance jumps; then where
    samples were cut out by the region; then at whole durations or point counts.
    """
    track = [track] if isinstance(track, str) else list(track)
    base = df
    if region is not None:
        df = df.withColumn("_pos", F.row_number().over(_by(track))).where(in_region(region))
    w = _by(track)
    brk = F.lit(False)
    if group is not None:
        brk = ~F.col(group).eqNullSafe(F.lag(group).over(w)) | F.isnan(F.col(group).try_cast("double"))
    else:
        if time_gap is not None:
            df = df.withColumn("_dt", F.col("time") - F.lag("time").over(w))
            if time_gap == "auto":
                typical = df.where("_dt > 0").groupBy(*track).agg((F.percentile("_dt", F.lit(0.5)) * time_factor).alias("_limit"))
                df = df.join(typical, track, "left")
            else:
                try:
                    limit = float(time_gap)
                except ValueError as e:
                    raise GeoError("splitTracks:InvalidThreshold", str(time_gap)) from e
                df = df.withColumn("_limit", F.lit(limit))
            brk = brk | F.coalesce(F.col("_dt") > F.col("_limit"), F.lit(False))
        if spatial_jump_km is not None:
            df = df.withColumns({"_plon": F.lag("lon").over(w), "_plat": F.lag("lat").over(w)})
            brk = brk | F.coalesce(F.expr(geo.great_circle_km("_plon", "_plat", "lon", "lat")) > spatial_jump_km, F.lit(False))
    if region is not None:
        brk = brk | F.coalesce(F.col("_pos") - F.lag("_pos").over(w) > 1, F.lit(False))
    first = F.lag("seq").over(w).isNull()
    df = df.withColumn("_seg", F.sum(F.when(brk & ~first, 1).otherwise(0)).over(w))
    if max_duration is not None or max_points is not None:
        s = _by(track, "_seg")
        forced = F.lit(False)
        if max_duration is not None:
            df = df.withColumn("_chunk", F.floor((F.col("time") - F.first("time").over(s)) / max_duration))
            forced = forced | F.coalesce(F.col("_chunk") != F.lag("_chunk").over(s), F.lit(False))
        if max_points is not None:
            n = F.row_number().over(s)
            forced = forced | ((n > 1) & (F.pmod(n - 1, F.lit(max_points)) == 0))
        df = df.withColumn("_forced", F.when(forced, 1).otherwise(0))
        df = df.withColumn("_seg", F.col("_seg") + F.sum("_forced").over(w))
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*track, "_seg")))
    alive = df.where(F.col("_n") >= min_points)
    ids = alive.select(*track, "seq", F.dense_rank().over(Window.partitionBy(*track).orderBy("_seg")).alias("pass_id"))
    return base.join(ids, [*track, "seq"], "left")


def with_breaks(df: DataFrame, track: str = "track_id") -> DataFrame:
    """Surviving samples in order, with a row of NaN between passes (how plotting formats write parts)."""
    kept = df.where("pass_id is not null")
    ends = kept.groupBy(track, "pass_id").agg(F.max("seq").alias("seq"))
    last = ends.groupBy(track).agg(F.max("pass_id").alias("last"))
    gaps = ends.join(last, track).where("pass_id < last").select(track, "pass_id", "seq", F.lit(1).alias("after"), F.lit(NAN).alias("lon"), F.lit(NAN).alias("lat"))
    return kept.select(track, "pass_id", "seq", F.lit(0).alias("after"), "lon", "lat").unionByName(gaps)


def count_gaps(df: DataFrame, value: str, track: str = "track_id") -> DataFrame:
    """Runs of missing samples, not samples."""
    gap = ~good(value)
    starts = gap & ~F.coalesce(F.lag(gap).over(_by([track])), F.lit(False))
    return df.select(track, F.when(starts, 1).otherwise(0).alias("s")).groupBy(track).agg(F.sum("s").alias("n_gaps"))


def runs(df: DataFrame, values: list[str], track: str = "track_id") -> DataFrame:
    """Samples whose values are all finite, with run_id: maximal stretches without a gap."""
    ok = F.lit(True)
    for v in values:
        ok = ok & good(v)
    marked = df.withColumn("_ok", ok)
    marked = marked.withColumn("run_id", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(_by([track])))
    return marked.where("_ok").drop("_ok").withColumn("run_id", F.dense_rank().over(Window.partitionBy(track).orderBy("run_id")))


def split_antimeridian(df: DataFrame, payload: list[str] | None = None, track: str = "track_id", threshold: float = 180.0, mode: str = "interpolate") -> DataFrame:
    """Cuts lines where the longitude jumps: track, part_id, seq, sub, lon, lat and the payload. Mode "interpolate" ends both parts on the edge, "break" only parts them."""
    if mode not in ("interpolate", "break"):
        raise GeoError("splitAntimeridian:BadMode", mode)
    payload = ["lat", *(payload or [])]
    w = _by([track])
    nxt = {c: F.lead(c).over(w) for c in ["lon", *payload]}
    d = df.withColumns({f"_n_{c}": v for c, v in nxt.items()})
    jump = good("lon") & good("_n_lon") & (F.abs(F.col("_n_lon") - F.col("lon")) > threshold)
    d = d.withColumn("_jump", F.coalesce(jump, F.lit(False)))
    d = d.withColumn("part_id", F.coalesce(F.sum(F.when(F.col("_jump"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    step = F.expr(geo.wrap_longitude("(_n_lon - lon)"))
    d = d.withColumn("_d", step).withColumn("_edge", F.signum("_d") * 180.0)
    t = F.when(F.col("_d") == 0, 0.0).otherwise((F.col("_edge") - F.col("lon")) / F.when(F.col("_d") != 0, F.col("_d")))
    d = d.withColumn("_t", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))

    def point(sub: int, part: Column, lon: Column, cross: bool) -> Column:
        vals = [(F.col(c) + F.col("_t") * (F.col(f"_n_{c}") - F.col(c)) if cross else F.col(c)).cast("double").alias(c) for c in payload]
        return F.struct(F.lit(sub).alias("sub"), part.alias("part_id"), lon.cast("double").alias("lon"), *vals)

    own = point(0, F.col("part_id"), F.col("lon"), False)
    if mode == "interpolate":
        pts = F.when(F.col("_jump"), F.array(own, point(1, F.col("part_id"), F.col("_edge"), True), point(2, F.col("part_id") + 1, -F.col("_edge"), True))).otherwise(F.array(own))
    else:
        pts = F.array(own)
    return d.select(track, "seq", F.explode(pts).alias("p")).select(track, "seq", "p.*")


def unit_normals(df: DataFrame, x: str = "x", y: str = "y", track: str = "track_id") -> DataFrame:
    """nx, ny: normals of the tangent between both neighbours; at an end the sample is its own neighbour, and a repeated point has none."""
    w = _by([track])
    t = {f"_t{c}": F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in (x, y)}
    d = df.withColumns(t).withColumn("_len", F.sqrt(F.col(f"_t{x}") ** 2 + F.col(f"_t{y}") ** 2))
    size = F.when(F.col("_len") == 0, 1.0).otherwise(F.col("_len"))
    return d.withColumns({"nx": -F.col(f"_t{y}") / size, "ny": F.col(f"_t{x}") / size}).drop(f"_t{x}", f"_t{y}", "_len")


def ribbon(df: DataFrame, fraction: float = 0.06, diagonal: float | None = None, obs: str = "obs", track: str = "track_id", bicolor: bool = False) -> DataFrame:
    """Offsets along the normal, so that the largest observation is ``fraction`` of the map's diagonal."""
    if fraction <= 0:
        raise GeoError("overlayTrack:BadScale", str(fraction))
    top = df.where(good(obs)).agg(F.max(F.abs(obs)).alias("top"), F.sqrt((F.max("x") - F.min("x")) ** 2 + (F.max("y") - F.min("y")) ** 2).alias("diag"))
    d = unit_normals(df, track=track).crossJoin(F.broadcast(top))  # one row
    scale = F.when(F.col("top") > 0, fraction * (F.lit(diagonal) if diagonal else F.col("diag")) / F.when(F.col("top") > 0, F.col("top"))).otherwise(0.0)
    d = d.withColumn("amp", F.col(obs) * scale).drop("top", "diag")
    d = d.withColumns({"rx": F.col("x") + F.col("nx") * F.col("amp"), "ry": F.col("y") + F.col("ny") * F.col("amp")})
    return d.withColumns({"amp_over": F.greatest("amp", F.lit(0.0)), "amp_under": F.least("amp", F.lit(0.0))}) if bicolor else d


def typical_range(df: DataFrame, value: str = "obs", track: str = "track_id") -> DataFrame:
    """One row: 1.4 times the median over series of the 5-95 percent spread; 1 if no series varies."""
    per = df.where(good(value)).groupBy(track).agg(F.percentile(value, F.lit(0.95)).alias("hi"), F.percentile(value, F.lit(0.05)).alias("lo"), F.count(F.lit(1)).alias("n"))
    spread = per.where("n >= 2").select((F.col("hi") - F.col("lo")).alias("s")).where("s > 0")
    return spread.agg(F.coalesce(1.4 * F.percentile("s", F.lit(0.5)), F.lit(1.0)).alias("spacing"))


def stack_offsets(df: DataFrame, value: str = "obs", track: str = "track_id", spacing: float | None = None) -> DataFrame:
    """df with offset and stacked: the first series on top, each next one a spacing below."""
    order = df.select(track).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(F.col(track).desc())) - 1)  # one row for each series
    out = df.join(order, track)
    if spacing is None:
        out = out.crossJoin(F.broadcast(typical_range(df, value, track)))
    else:
        out = out.withColumn("spacing", F.lit(float(spacing)))
    return out.withColumn("offset", F.col("_rank") * F.col("spacing")).withColumn("stacked", F.col(value) + F.col("offset")).drop("_rank", "spacing")


def uncertainty_band(df: DataFrame, value: str, sigma: str | float, track: str = "track_id") -> DataFrame:
    """lo and hi of runs of at least two samples."""
    s = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else F.col(sigma)
    d = runs(df.withColumn("_s", s.cast("double")), [value, "_s"], track)
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(track, "run_id"))).where("_n >= 2")
    return d.withColumns({"lo": F.col(value) - F.col("_s"), "hi": F.col(value) + F.col("_s")}).drop("_n", "_s")


def label_anchor(df: DataFrame, value: str = "obs", track: str = "track_id", side: str = "right") -> DataFrame:
    """Where a series' label stands: its last (first) finite sample, one percent of the time span beyond."""
    d = df.where(good(value) & good("time"))
    pick = F.max_by if side == "right" else F.min_by
    sign = 1 if side == "right" else -1
    return d.groupBy(track).agg((pick("time", "seq") + sign * 0.01 * (F.max("time") - F.min("time"))).alias("label_time"), pick(value, "seq").alias("label_value"))


def reference_lines(df: DataFrame, values: list[float], track: str = "track_id") -> DataFrame:
    """Each value across the whole time span, for every series."""
    span = df.where(good("time")).agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    return df.select(track).distinct().crossJoin(F.broadcast(span)).withColumn("value", F.explode(F.array(*map(F.lit, map(float, values)))))


def median_spacing(df: DataFrame, x: str = "x", y: str = "y", track: str = "track_id") -> DataFrame:
    w = _by([track])
    step = F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2)
    return df.select(step.alias("d")).where(good("d")).agg(F.percentile("d", F.lit(0.5)).alias("median_spacing"))


def unwrap_longitude(df: DataFrame, track: str = "track_id") -> DataFrame:
    """lon_unwrapped: longitudes that continue past 180 instead of jumping."""
    w = _by([track])
    d = F.coalesce(F.col("lon") - F.lag("lon").over(w), F.lit(0.0))
    step = d - 360 * F.round(d / 360)
    return df.withColumn("_s", step).withColumn("lon_unwrapped", F.first("lon").over(w) + F.sum("_s").over(w)).drop("_s")


def interpolate_at(places: DataFrame, path: DataFrame, value: str = "obs", track: str = "track_id") -> DataFrame:
    """places (track, source and more) with ``value``: linear between the two vertices of the path around source, which counts them from 0; a gap beside it is a gap, at a vertex its own value."""
    w = _by([track])
    p = path.select(F.col(track).alias("_t"), (F.row_number().over(w) - 1).cast("long").alias("_k"), F.col(value).alias("_v"), F.lead(value).over(w).alias("_next"))
    share = F.col("source") - F.floor("source")
    at = F.when(share == 0, F.col("_v")).otherwise(F.col("_v") + share * (F.col("_next") - F.col("_v")))
    keep = [c for c in places.columns if c != value]
    return places.join(p, (F.col(track) == F.col("_t")) & (F.floor("source") == F.col("_k")), "left").select(*keep, at.alias(value))
