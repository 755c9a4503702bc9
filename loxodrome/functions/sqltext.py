"""Expressions as SQL text that Spark and DuckDB read alike.

Every scalar operator of the library is one function that returns such text, so the
same definition serves DataFrame columns (``F.expr``), SQL functions and, with
dialect "duckdb", the check against another engine.  Literals carry an exponent:
both engines then read them as doubles.  Gaps are NaN; hazards (a zero divisor, the
logarithm of zero) are excluded by CASE before they are evaluated.
"""

from __future__ import annotations

import math

NAN = "CAST('NaN' AS DOUBLE)"
PI = "pi()"


def num(v: float) -> str:
    if math.isnan(v):
        return NAN
    if math.isinf(v):
        return f"CAST('{'-' if v < 0 else ''}Infinity' AS DOUBLE)"
    s = repr(float(v))
    s = s if "e" in s else s + "e0"
    return f"({s})" if v < 0 else s


def case(test: str, then: str, otherwise: str) -> str:
    return f"(CASE WHEN {test} THEN {then} ELSE {otherwise} END)"


def clamp(x: str, lo: float, hi: float) -> str:
    """Least and greatest values; a NaN stays one."""
    return f"(CASE WHEN isnan({x}) THEN {NAN} WHEN {x} < {num(lo)} THEN {num(lo)} WHEN {x} > {num(hi)} THEN {num(hi)} ELSE {x} END)"


def bound(x: str, lo: float, hi: float) -> str:
    """Least and greatest values for arguments that only rounding can carry over; x stands once. A NaN is lost: callers test their inputs for gaps."""
    out = x if math.isinf(lo) else f"greatest({x}, {num(lo)})"
    return out if math.isinf(hi) else f"least({out}, {num(hi)})"


def let(dialect: str, value: str, var: str, body: str) -> str:
    """body, with a value bound to a name so that long expressions stand once."""
    if dialect == "spark":
        return f"transform(array({value}), {var} -> {body})[0]"
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def div(a: str, b: str, at_zero: str = NAN) -> str:
    return f"(CASE WHEN ({b}) = 0e0 THEN {at_zero} ELSE ({a}) / ({b}) END)"


def hypot(x: str, y: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"


def rad(x: str) -> str:
    return f"(({x}) * {PI} / 180e0)"


def deg(x: str) -> str:
    return f"(({x}) * 180e0 / {PI})"


def floored_mod(x: str, m: float) -> str:
    return f"(({x}) - {num(m)} * floor(({x}) / {num(m)}))"


def finite(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < {num(math.inf)})"


def fold(dialect: str, n: int, start: str, var: str, step: str) -> str:
    """start, then n times ``step`` (text over ``var`` and the step number ``k``, from 1)."""
    if dialect == "spark":
        return f"aggregate(sequence(1, {n}), {start}, ({var}, k) -> {step})"
    return f"list_reduce(list_prepend({start}, CAST(range(1, {n + 1}) AS DOUBLE[])), lambda {var}, k: {step})"


def rounded(x: str, digits: int = 6) -> str:
    """For results that engines compare: rounded, no negative zero, NULL for NaN."""
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL ELSE round({x}, {digits}) + 0e0 END)"
