"""Longitudes, great circles, the sixteen projections and their inverses, as SQL text. Angles in degrees, map units in Earth radii."""

from __future__ import annotations

import math

import numpy as np

from loxodrome.errors import GeoError
from loxodrome.functions.sqltext import NAN, PI, bound, case, deg, div, floored_mod, fold, hypot, let, num, rad
from loxodrome.model import EARTH_RADIUS_KM, Crs, as_crs


def wrap_longitude(lon: str, lon0: str = "0e0", window: str = "halfopen") -> str:
    """Into [lon0-180, lon0+180); a closed window leaves what is within 180 degrees as it is."""
    if window not in ("halfopen", "closed"):
        raise GeoError("wrapLongitude:BadWindow", window)
    wrapped = f"({floored_mod(f'({lon}) - ({lon0}) + 180e0', 360)} - 180e0 + ({lon0}))"
    return wrapped if window == "halfopen" else case(f"abs(({lon}) - ({lon0})) <= 180e0", f"({lon})", wrapped)


def great_circle_km(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = EARTH_RADIUS_KM) -> str:
    dp, dl = rad(f"({lat2}) - ({lat1})"), rad(f"({lon2}) - ({lon1})")
    a = f"(pow(sin({dp} / 2e0), 2) + cos({rad(lat1)}) * cos({rad(lat2)}) * pow(sin({dl} / 2e0), 2))"
    return f"(2e0 * {num(radius)} * asin({bound(f'sqrt({a})', 0, 1)}))"


def bearings(lon1: str, lat1: str, lon2: str, lat2: str) -> tuple[str, str]:
    """Initial and final bearing, in [0, 360)."""
    p1, p2, dl = rad(lat1), rad(lat2), rad(f"({lon2}) - ({lon1})")
    first = f"atan2(sin({dl}) * cos({p2}), cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({dl}))"
    last = f"(atan2(sin(-({dl})) * cos({p1}), cos({p2}) * sin({p1}) - sin({p2}) * cos({p1}) * cos({dl})) + {PI})"
    return floored_mod(deg(first), 360), floored_mod(deg(last), 360)


def destination(lon: str, lat: str, bearing: str, distance: str, radius: float = EARTH_RADIUS_KM) -> tuple[str, str]:
    p1, brg, ang = rad(lat), rad(bearing), f"(({distance}) / {num(radius)})"
    s2 = f"(sin({p1}) * cos({ang}) + cos({p1}) * sin({ang}) * cos({brg}))"
    p2 = f"asin({bound(s2, -1, 1)})"
    l2 = f"({rad(lon)} + atan2(sin({brg}) * sin({ang}) * cos({p1}), cos({ang}) - sin({p1}) * sin({p2})))"
    return wrap_longitude(deg(l2)), deg(p2)


# --- Robinson: a table every five degrees, joined by monotone cubics --------------------------------

#: Lengths of parallels and their distances from the equator, latitudes 0, 5, ... 90 (fixed values).
ROBINSON_X = [1.0000, 0.9986, 0.9954, 0.9900, 0.9822, 0.9730, 0.9600, 0.9427, 0.9216, 0.8962, 0.8679, 0.8350, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322]
ROBINSON_Y = [0.0000, 0.0620, 0.1240, 0.1860, 0.2480, 0.3100, 0.3720, 0.4340, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0000]
ROBINSON_SCALE = (0.8487, 1.3523)


def monotone_cubic(values: list[float], h: float) -> np.ndarray:
    """Coefficients (constant first) of Fritsch-Carlson cubics through equally spaced values, one row for each interval."""
    v = np.asarray(values, float)
    d = np.diff(v) / h
    slope = np.zeros(len(v))
    same = d[:-1] * d[1:] > 0
    slope[1:-1][same] = 2 * d[:-1][same] * d[1:][same] / (d[:-1][same] + d[1:][same])

    def end(d0: float, d1: float) -> float:
        s = (3 * d0 - d1) / 2
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    slope[0], slope[-1] = end(d[0], d[1]), end(d[-1], d[-2])
    return np.column_stack([v[:-1], slope[:-1], (3 * d - 2 * slope[:-1] - slope[1:]) / h, (slope[:-1] + slope[1:] - 2 * d) / h**2])


def _robinson(values: list[float], lat: str) -> str:
    """The interpolant at |latitude| ``lat``, clamped to [0, 90]."""
    rows = monotone_cubic(values, 5.0)
    out = NAN
    for i in reversed(range(len(rows))):
        t = f"(({lat}) - {num(5.0 * i)})"
        a, b, c, d = map(num, rows[i])
        poly = f"({a} + {t} * ({b} + {t} * ({c} + {t} * {d})))"
        out = poly if i == len(rows) - 1 else case(f"({lat}) < {num(5.0 * (i + 1))}", poly, out)
    return out


# --- projections ----------------------------------------------------------------------------------


def _constants(c: Crs) -> dict[str, float]:
    p0, p1, n = math.radians(c.center_latitude), math.radians(c.standard_parallel), c.cone_constant
    t = lambda p: math.tan(math.pi / 4 + p / 2)
    if c.name == "lambertconformal":
        f = math.cos(p1) * t(p1) ** n / n
        return {"n": n, "F": f, "rho0": f / t(p0) ** n}
    if c.name == "albers":
        k = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
        return {"n": n, "C": k, "rho0": math.sqrt(max(k - 2 * n * math.sin(p0), 0)) / n}
    if c.name == "polarstereographic":
        return {"k0": 0.5 * (1 + math.sin(abs(p1)))}
    return {}


MOLLWEIDE_STEPS = 15


def mollweide_step(th: str, sine: str) -> str:
    """One Newton step for 2t + sin 2t = pi sine."""
    slope = f"(2e0 + 2e0 * cos(2e0 * {th}))"
    return f"(CASE WHEN {slope} < 1e-15 THEN {th} ELSE {th} - (2e0 * {th} + sin(2e0 * {th}) - {PI} * {sine}) / {slope} END)"


def mollweide_theta(phi: str, dialect: str, th: str | None = None) -> str:
    """2t + sin 2t = pi sin(phi), by fifteen Newton steps (``th``, if given, is their result); the poles are fixed points."""
    th = th or fold(dialect, MOLLWEIDE_STEPS, f"({phi})", "th", mollweide_step("th", f"sin({phi})"))
    return case(f"abs(abs({phi}) - {PI} / 2e0) < 1e-9", f"(sign({phi}) * {PI} / 2e0)", th)


def project(lon: str, lat: str, crs: Crs | str, window: str = "halfopen", dialect: str = "spark", theta: str | None = None) -> tuple[str, str]:
    """x and y; NaN outside the domain, and both NaN where either input is. theta: a column with Mollweide's, worked out before."""
    c = as_crs(crs)
    lam = rad(wrap_longitude(f"({lon}) - {num(c.center_longitude)}", "0e0", window))
    phi, phi0, k = rad(lat), math.radians(c.center_latitude), _constants(c)
    outside = f"({lat}) < {num(c.latitude_limit[0])} OR ({lat}) > {num(c.latitude_limit[1])}"
    if c.name == "equirectangular":
        x, y = lam, phi
    elif c.name == "mercator":
        x, y = lam, f"ln(tan({PI} / 4e0 + {phi} / 2e0))"
    elif c.name == "transversemercator":
        b = bound(f"(cos({phi}) * sin({lam}))", -1 + 1e-15, 1 - 1e-15)
        x, y = f"(0.5e0 * ln((1e0 + {b}) / (1e0 - {b})))", f"(atan2(tan({phi}), cos({lam})) - {num(phi0)})"
        outside += f" OR abs({b}) > {num(math.sin(math.radians(c.max_distance)))}"
    elif c.name == "robinson":
        a = f"abs({lat})"
        x, y = f"({num(ROBINSON_SCALE[0])} * {lam} * {_robinson(ROBINSON_X, a)})", f"({num(ROBINSON_SCALE[1])} * {_robinson(ROBINSON_Y, a)} * sign({lat}))"
    elif c.name == "mollweide":
        th = mollweide_theta(phi, dialect, theta)
        x, y = f"({num(2 * math.sqrt(2) / math.pi)} * {lam} * cos({th}))", f"({num(math.sqrt(2))} * sin({th}))"
    elif c.name == "hammer":
        d = f"sqrt(1e0 + cos({phi}) * cos({lam} / 2e0))"
        x, y = f"({num(2 * math.sqrt(2))} * cos({phi}) * sin({lam} / 2e0) / {d})", f"({num(math.sqrt(2))} * sin({phi}) / {d})"
    elif c.name == "winkeltripel":
        alpha = f"acos({bound(f'(cos({phi}) * cos({lam} / 2e0))', -1, 1)})"
        sc = case(f"abs({alpha}) < 1e-12", "1e0", f"(sin({alpha}) / {alpha})")
        x, y = f"(0.5e0 * ({lam} * {num(2 / math.pi)} + 2e0 * cos({phi}) * sin({lam} / 2e0) / {sc}))", f"(0.5e0 * ({phi} + sin({phi}) / {sc}))"
    elif c.name == "sinusoidal":
        x, y = f"({lam} * cos({phi}))", phi
    elif c.name == "polarstereographic":
        s = "+" if c.hemisphere == "south" else "-"
        rho = f"({num(2 * k['k0'])} * tan({PI} / 4e0 {s} {phi} / 2e0))"
        x, y = f"({rho} * sin({lam}))", f"({s}{rho} * cos({lam}))"
    elif c.family == "conic":
        if c.name == "albers":
            rho = f"(sqrt({bound(f'({num(k["C"])} - {num(2 * k["n"])} * sin({phi}))', 0, math.inf)}) / {num(k['n'])})"
        else:
            rho = f"({num(k['F'])} / pow(tan({PI} / 4e0 + {phi} / 2e0), {num(k['n'])}))"
        x, y = f"({rho} * sin({num(k['n'])} * {lam}))", f"({num(k['rho0'])} - {rho} * cos({num(k['n'])} * {lam}))"
    else:
        s0, c0 = num(math.sin(phi0)), num(math.cos(phi0))
        cosc = bound(f"({s0} * sin({phi}) + {c0} * cos({phi}) * cos({lam}))", -1, 1)
        far = case(f"1e0 + {cosc} < 1e-15", "1e-15", f"(1e0 + {cosc})")
        scale = {
            "lambert": f"sqrt(2e0 / {far})", "stereographic": f"(2e0 / {far})", "orthographic": "1e0",
            "azimuthalequidistant": case(f"abs(sin(acos({cosc}))) < 1e-15", "1e0", f"(acos({cosc}) / sin(acos({cosc})))"),
            "gnomonic": case(f"abs({cosc}) < 1e-15", NAN, f"(1e0 / {cosc})"),
        }[c.name]
        x, y = f"({scale} * cos({phi}) * sin({lam}))", f"({scale} * ({c0} * sin({phi}) - {s0} * cos({phi}) * cos({lam})))"
        outside += f" OR {deg(f'acos({cosc})')} > {num(c.max_distance)}"
    gap = f"{lon} IS NULL OR {lat} IS NULL OR isnan({lon}) OR isnan({lat}) OR {outside}"
    return case(gap, NAN, x), case(gap, NAN, y)


def unproject(x: str, y: str, crs: Crs | str, dialect: str = "spark") -> tuple[str, str]:
    """lon and lat of map coordinates; NaN off the map. Winkel tripel has no closed form: see operators.projection.unproject."""
    c = as_crs(crs)
    phi0, k, off = math.radians(c.center_latitude), _constants(c), "false"
    if c.name == "equirectangular":
        lam, phi = x, y
    elif c.name == "mercator":
        lam, phi = x, f"(2e0 * atan(exp({y})) - {PI} / 2e0)"
    elif c.name == "transversemercator":
        dy = f"(({y}) + {num(phi0)})"
        phi, lam = f"asin({bound(f'(sin({dy}) / cosh({x}))', -1, 1)})", f"atan2(sinh({x}), cos({dy}))"
    elif c.name == "robinson":
        top = f"(abs({y}) / {num(ROBINSON_SCALE[1])})"
        off = f"{top} > 1.000000000001e0"
        # bisection: the step halves, and is taken wherever the interpolant is still below
        halved = "(th + 90e0 / pow(2e0, k))"
        alat = fold(dialect, 55, "0e0", "th", let(dialect, halved, "m", case(f"{_robinson(ROBINSON_Y, 'm')} < {top}", "m", "th")))
        lam = f"(({x}) / ({num(ROBINSON_SCALE[0])} * {let(dialect, alat, 'a', _robinson(ROBINSON_X, 'a'))}))"
        phi = rad(f"{alat} * sign({y})")
    elif c.name == "mollweide":
        off = f"abs({y}) > {num(math.sqrt(2) + 1e-12)}"
        th = f"asin({bound(f'(({y}) / {num(math.sqrt(2))})', -1, 1)})"
        phi = f"asin({bound(f'((2e0 * {th} + sin(2e0 * {th})) / {PI})', -1, 1)})"
        lam = div(f"{PI} * ({x})", f"{num(2 * math.sqrt(2))} * cos({th})")
    elif c.name == "hammer":
        z2 = f"(1e0 - pow(({x}) / 4e0, 2) - pow(({y}) / 2e0, 2))"
        off = f"{z2} <= 0e0"
        z = f"sqrt({bound(z2, 1e-300, math.inf)})"
        lam, phi = f"(2e0 * atan2({z} * ({x}), 2e0 * (2e0 * {z} * {z} - 1e0)))", f"asin({bound(f'({z} * ({y}))', -1, 1)})"
    elif c.name == "sinusoidal":
        lam, phi = div(x, f"cos({y})"), y
    elif c.name == "polarstereographic":
        rho = f"({hypot(x, y)} / {num(2 * k['k0'])})"
        south = c.hemisphere == "south"
        phi = f"(2e0 * atan({rho}) - {PI} / 2e0)" if south else f"({PI} / 2e0 - 2e0 * atan({rho}))"
        lam = f"atan2({x}, {y})" if south else f"atan2({x}, -({y}))"
    elif c.family == "conic":
        s, n = math.copysign(1, k["n"]), k["n"]
        up = f"({num(k['rho0'])} - ({y}))"
        rho = hypot(x, up)
        lam = f"(atan2({num(s)} * ({x}), {num(s)} * {up}) / {num(n)})"
        if c.name == "albers":
            phi = f"asin({bound(f'(({num(k["C"])} - pow({rho} * {num(n)}, 2)) / {num(2 * n)})', -1, 1)})"
        else:
            phi = case(f"{rho} = 0e0", f"({num(s)} * {PI} / 2e0)", f"(2e0 * atan(pow({num(abs(k['F']))} / {rho}, {num(1 / n)})) - {PI} / 2e0)")
    elif c.name == "winkeltripel":
        raise GeoError("unproject:Iterative", "winkeltripel")
    else:
        rho = hypot(x, y)
        limit = {"lambert": 2.0, "orthographic": 1.0, "azimuthalequidistant": math.pi}.get(c.name)
        off = "false" if limit is None else f"{rho} > {num(limit)}"
        cc = {
            "lambert": f"(2e0 * asin({bound(f'({rho} / 2e0)', -1, 1)}))", "stereographic": f"(2e0 * atan({rho} / 2e0))", "orthographic": f"asin({bound(rho, -1, 1)})",
            "azimuthalequidistant": rho, "gnomonic": f"atan({rho})",
        }[c.name]
        s0, c0 = num(math.sin(phi0)), num(math.cos(phi0))
        inner = f"(cos({cc}) * {s0} + {div(f'({y}) * sin({cc}) * {c0}', rho, '0e0')})"
        phi = case(f"{rho} < 1e-15", num(phi0), f"asin({bound(inner, -1, 1)})")
        lam = case(f"{rho} < 1e-15", "0e0", f"atan2(({x}) * sin({cc}), {rho} * {c0} * cos({cc}) - ({y}) * {s0} * sin({cc}))")
        off += f" OR {deg(cc)} > {num(c.max_distance)}"
    gap = f"{x} IS NULL OR {y} IS NULL OR isnan({x}) OR isnan({y}) OR {off}"
    turned = f"({deg(lam)} + {num(c.center_longitude)})"
    wrapped = let(dialect, turned, "t", wrap_longitude("t", num(c.center_longitude))) if c.name == "robinson" else wrap_longitude(turned, num(c.center_longitude))
    return case(gap, NAN, wrapped), case(gap, NAN, deg(phi))


def inside_extent(lon: str, lat: str, lon_limit: tuple[float, float], lat_limit: tuple[float, float], x: str, y: str, slack: float = 1e-9) -> str:
    """In the box (longitudes wrapped to its middle; a full turn excludes none) and on the map (x and y finite)."""
    mid, half = (lon_limit[0] + lon_limit[1]) / 2, (lon_limit[1] - lon_limit[0]) / 2
    w = wrap_longitude(lon, num(mid))
    in_lon = "true" if half >= 180 - slack else f"abs({w} - {num(mid)}) <= {num(half + slack)}"
    return f"(NOT isnan({x}) AND NOT isnan({y}) AND ({lat}) BETWEEN {num(lat_limit[0] - slack)} AND {num(lat_limit[1] + slack)} AND {in_lon})"


def _number(v: str, dialect: str) -> str:
    """Up to four decimals, no trailing zeros."""
    whole = f"abs({v} - round({v}, 0)) < 1e-9"
    as_text = f"regexp_replace(regexp_replace(CAST(CAST(round({v}, 4) AS DECIMAL(18, 4)) AS {'STRING' if dialect == 'spark' else 'VARCHAR'}), '0+$', ''), '[.]$', '')"
    return case(whole, f"CAST(CAST(round({v}, 0) AS BIGINT) AS {'STRING' if dialect == 'spark' else 'VARCHAR'})", as_text)


def format_lon(v: str, dialect: str = "spark") -> str:
    w = wrap_longitude(v)
    return f"(CASE WHEN abs(abs({w}) - 180e0) < 1e-9 THEN '180°' WHEN abs({w}) < 1e-9 THEN '0°' WHEN {w} > 0e0 THEN concat({_number(w, dialect)}, '°E') ELSE concat({_number(f'(-{w})', dialect)}, '°W') END)"


def format_lat(v: str, dialect: str = "spark") -> str:
    return f"(CASE WHEN abs({v}) < 1e-9 THEN '0°' WHEN {v} > 0e0 THEN concat({_number(v, dialect)}, '°N') ELSE concat({_number(f'(-({v}))', dialect)}, '°S') END)"
