"""Element-wise functions. A missing argument makes a missing result."""

from __future__ import annotations

from quillon.plans.layers import Layers

#: Denominators at or below these are treated as zero: programs, structured expressions, feature recipes.
PROGRAM_EPS, STRUCTURED_EPS, RECIPE_EPS = 1e-6, 1e-2, 1e-12


def neg(p: Layers, x: str) -> str:
    return p.let(f"-{x}")


def absolute(p: Layers, x: str) -> str:
    return p.let(f"abs({x})")


def sign(p: Layers, x: str) -> str:
    return p.let(f"CAST(sign({x}) AS DOUBLE)")


def slog(p: Layers, x: str) -> str:
    """sign(x) * ln(1 + |x|)"""
    return p.let(f"sign({x}) * ln(1 + abs({x}))")


def sqrt_abs(p: Layers, x: str) -> str:
    return p.let(f"sqrt(abs({x}))")


def add(p: Layers, x: str, y: str) -> str:
    return p.let(f"{x} + {y}")


def sub(p: Layers, x: str, y: str) -> str:
    return p.let(f"{x} - {y}")


def mul(p: Layers, x: str, y: str) -> str:
    return p.let(f"{x} * {y}")


def divide(p: Layers, x: str, y: str, eps: float = PROGRAM_EPS) -> str:
    """x / y where |y| > eps, else missing."""
    return p.let(f"CASE WHEN abs({y}) > {eps!r} THEN {x} / {y} END".replace("1e-", "1E-"))


def divide_nonzero(p: Layers, x: str, y: str) -> str:
    """x / y unless y is exactly 0."""
    return p.let(f"CASE WHEN {y} <> 0 THEN {x} / {y} END")


def clip(p: Layers, x: str, low: float = -8.0, high: float = 8.0) -> str:
    return p.let(f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {low}), {high}) END")


def mean_of_two(p: Layers, x: str, y: str) -> str:
    return p.let(f"({x} + {y}) / 2")


def constant(p: Layers, value: float) -> str:
    return p.let(f"CAST({float(value)!r} AS DOUBLE)")


def finite(p: Layers, x: str) -> str:
    """NaN and infinities as missing."""
    return p.let(f"CASE WHEN NOT isnan({x}) AND abs({x}) < 1E308 THEN {x} END")


def row_mean(p: Layers, xs: list[str]) -> str:
    """Mean across columns, missing ones skipped."""
    return p.let(f"CASE WHEN {_count(xs)} > 0 THEN ({' + '.join(f'coalesce({x}, 0)' for x in xs)}) / {_count(xs)} END")


def row_min(p: Layers, xs: list[str]) -> str:
    return p.let(f"least({', '.join(xs)})")


def row_std(p: Layers, xs: list[str]) -> str:
    """Sample standard deviation across columns, missing ones skipped; missing for fewer than two."""
    m = row_mean(p, xs)
    return p.let(f"CASE WHEN {_count(xs)} > 1 THEN sqrt(({' + '.join(f'coalesce(({x} - {m}) * ({x} - {m}), 0)' for x in xs)}) / ({_count(xs)} - 1)) END")


def row_count_above(p: Layers, xs: list[str], limit: float) -> str:
    return p.let("CAST(" + " + ".join(f"CASE WHEN {x} > {limit} THEN 1 ELSE 0 END" for x in xs) + " AS DOUBLE)")


def _count(xs: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in xs) + ")"
