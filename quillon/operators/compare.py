"""How far two columns of one panel agree."""

from __future__ import annotations

from quillon.functions import cross_section as cs
from quillon.operators.metrics import correlation, joint
from quillon.plans.layers import DATE, Layers


def comparison_sql(p: Layers, a: str, b: str, least: int = 3) -> tuple[str, list[str]]:
    """One row over {panel}: cells, known ones of either and both, agreement in what is known, correlation of values and of each date's ranks, signs that agree, absolute differences (mean, quantiles, largest)."""
    x, y = joint(p, a, b)
    rx, ry = cs.average_rank(p, x), cs.average_rank(p, y)
    gap = p.let(f"abs({x} - {y})")
    agree = p.let(f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN sign({x}) = sign({y}) THEN 1.0E0 ELSE 0.0E0 END END")
    same = p.let(f"CASE WHEN ({a} IS NULL) = ({b} IS NULL) THEN 1.0E0 ELSE 0.0E0 END")
    cols = [a, b, x, y, rx, ry, gap, agree, same]
    q = lambda at: p.quantile_of(gap, at)
    whole = f"""SELECT count(*) AS cells, count({a}) AS known_a, count({b}) AS known_b, count({x}) AS both_known, avg({same}) AS known_agree, {correlation(x, y, 2)} AS pearson, avg({agree}) AS sign_agree,
      avg({gap}) AS mean_diff, {q(0.5)} AS median_diff, {q(0.95)} AS p95_diff, {q(0.99)} AS p99_diff, max({gap}) AS max_diff FROM {{panel}}"""
    daily = f"SELECT avg(r) AS daily_spearman, min(r) AS least_daily_spearman FROM (SELECT {correlation(rx, ry, least)} AS r FROM {{panel}} GROUP BY {DATE}) d"
    names = ("known_agree", "pearson", "sign_agree", "mean_diff", "median_diff", "p95_diff", "p99_diff", "max_diff", "daily_spearman", "least_daily_spearman")
    return f"SELECT cells, known_a, known_b, both_known, {', '.join(f'round({n} + 1.3E-10, 6) + 0.0E0 AS {n}' for n in names)} FROM ({whole}) w CROSS JOIN ({daily}) d", cols
