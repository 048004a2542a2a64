"""Masks (0/1, never missing), gates and conditions."""

from __future__ import annotations

from quillon.functions import cross_section as cs
from quillon.plans.layers import DATE, Layers


def mask(p: Layers, test: str) -> str:
    return p.let(f"CASE WHEN {test} THEN 1.0E0 ELSE 0.0E0 END")


def rank_high(p: Layers, x: str, at: float) -> str:
    return mask(p, f"{cs.rank_pct(p, x)} >= {at}")


def rank_low(p: Layers, x: str, at: float) -> str:
    return mask(p, f"{cs.rank_pct(p, x)} <= {at}")


def sign_pos(p: Layers, x: str) -> str:
    return mask(p, f"{x} > 0")


def sign_neg(p: Layers, x: str) -> str:
    return mask(p, f"{x} < 0")


def as_mask(p: Layers, x: str) -> str:
    """1 where known and not 0."""
    return mask(p, f"{x} <> 0")


def gate_nan(p: Layers, x: str, cond: str) -> str:
    return p.let(f"CASE WHEN {cond} <> 0 THEN {x} END")


def gate_zero(p: Layers, x: str, cond: str, outer: str | None = None) -> str:
    """x where the condition holds, else 0; outside an outer mask, missing."""
    inner = f"CASE WHEN {cond} <> 0 THEN {x} ELSE 0.0E0 END"
    return p.let(f"CASE WHEN {outer} <> 0 THEN {inner} END" if outer else inner)


def tradeable_only(p: Layers, x: str, flag: str = "tradeable") -> str:
    """Missing where not tradeable; the row stays."""
    return p.let(f"CASE WHEN {flag} THEN {x} END")


#: Condition operators and their tests on a rank percentage or the value; {t} is the threshold.
CONDITIONS = {
    "top_quantile": "{r} >= {t}",
    "bottom_quantile": "{r} <= 1 - {t}",
    "above_median": "{r} >= 0.5",
    "below_median": "{r} < 0.5",
    "positive": "{x} > 0",
    "negative": "{x} < 0",
}


def condition(p: Layers, x: str, kind: str, threshold: float = 0.7) -> str:
    test = CONDITIONS[kind]
    r = cs.rank_pct(p, x) if "{r}" in test else ""
    return mask(p, test.format(r=r, x=x, t=threshold))


def gate_all(p: Layers, x: str, conditions: list[str], fill: str = "nan") -> str:
    """x where tradeable and all conditions hold; else missing, or 0 with ``fill="zero"`` where tradeable."""
    both = mask(p, " AND ".join(["tradeable", *[f"{c} <> 0" for c in conditions]]))
    return gate_nan(p, x, both) if fill == "nan" else gate_zero(p, x, both, as_mask(p, p.let("CASE WHEN tradeable THEN 1.0E0 ELSE 0.0E0 END")))


def top_half(p: Layers, x: str) -> str:
    return mask(p, f"tradeable AND {cs.rank_pct(p, x)} >= 0.5")


def top_k(p: Layers, x: str, k: int | None = None, fraction: float = 0.1) -> str:
    """The k highest of a date, or ceil(count * fraction) of them; ties by contract."""
    v = p.let(p.ordering(x))
    ok = p.let(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END")
    i = p.placed(v, ok, down=True)
    n = p.let(f"count({x}) OVER (PARTITION BY {DATE})")
    size = f"least({k}, {n})" if k else f"greatest(1, ceil({n} * {fraction}))"
    return mask(p, f"{ok} = 1 AND {i} <= {size}")
