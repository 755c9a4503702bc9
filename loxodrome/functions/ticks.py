"""Round numbers for axes: steps of 1-2-5 and of the degrees maps use. Driver-side arithmetic on a few numbers."""

from __future__ import annotations

import math

from loxodrome.errors import GeoError

#: Steps in degrees that divide a circle or a right angle (fixed values).
GRATICULE_STEPS = [0.1, 0.2, 0.25, 0.5, 1, 2, 3, 5, 10, 15, 20, 30, 45, 60, 90]


def nice_step(lo: float, hi: float, mode: str = "linear", target: float = 6) -> float:
    if hi <= lo:
        raise GeoError("niceTicks:EmptyRange", f"{lo} {hi}")
    ideal = (hi - lo) / target
    if mode == "graticule":
        return next((s for s in GRATICULE_STEPS if s >= ideal), GRATICULE_STEPS[-1])
    decade = 10.0 ** math.floor(math.log10(ideal))
    return next(s * decade for s in (1, 2, 5, 10) if s * decade >= ideal)


def nice_ticks(lo: float, hi: float, mode: str = "linear", target: float = 6) -> list[float]:
    step = nice_step(lo, hi, mode, target)
    return [k * step for k in range(math.ceil(lo / step), math.floor(hi / step) + 1)]


def nice_length(wanted: float) -> float:
    """The 1-2-5 value nearest in ratio."""
    if not math.isfinite(wanted) or wanted <= 0:
        return 1.0
    decade = 10.0 ** math.floor(math.log10(wanted))
    return min((s * decade for s in (1, 2, 5, 10)), key=lambda v: abs(math.log(v) - math.log(wanted)))


def colorbar_ticks(lo: float, hi: float, levels: int | None = None, subticks: int | None = None) -> tuple[list[float], list[float]]:
    """Main ticks, and the minor ones between them (three; none for discrete levels)."""
    if levels:
        main, n = [lo + (hi - lo) * i / levels for i in range(levels + 1)], 0
    else:
        main, n = nice_ticks(lo, hi), 3
    n = n if subticks is None else subticks
    minor = [a + (b - a) * k / (n + 1) for a, b in zip(main, main[1:], strict=False) for k in range(1, n + 1)]
    return [v for v in main if lo - 1e-15 <= v <= hi + 1e-15], minor


def near_square(n: int) -> tuple[int, int]:
    """Rows and columns of a panel of n tiles."""
    cols = math.ceil(math.sqrt(n))
    return math.ceil(n / cols), cols
