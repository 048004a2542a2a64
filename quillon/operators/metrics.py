"""Scores of a factor against a label: information coefficients, coverage, NDCG, turnover, stability."""

from __future__ import annotations

from dataclasses import dataclass

from quillon.functions import cross_section as cs
from quillon.functions import masks
from quillon.plans.layers import DATE, NAME, Layers


@dataclass(frozen=True)
class MetricRules:
    """What differs between the two families of metrics.

    ``joint``: ranks are taken among names that have factor and label; else each among its own. ``least``: smallest
    cross-section of a date.
    """

    joint: bool = True
    least: int = 3


STRUCTURED, PROGRAM = MetricRules(), MetricRules(joint=False, least=2)


def masked(p: Layers, factor: str, label: str, mask_factor: bool = True) -> tuple[str, str]:
    return (masks.tradeable_only(p, factor) if mask_factor else factor), masks.tradeable_only(p, label)


def joint(p: Layers, x: str, y: str) -> tuple[str, str]:
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return p.let(f"CASE WHEN {ok} THEN {x} END"), p.let(f"CASE WHEN {ok} THEN {y} END")


def correlation(x: str, y: str, least: int) -> str:
    """Guarded Pearson correlation as an aggregate over rows where both are known."""
    return f"CASE WHEN count({x}) >= {least} AND var_pop({x}) > 1E-14 AND var_pop({y}) > 1E-14 THEN covar_pop({x}, {y}) / (sqrt(var_pop({x})) * sqrt(var_pop({y}))) END"


def ic_sql(x: str, y: str, least: int, where: str = "TRUE") -> str:
    """Daily correlations; dates without one are left out."""
    return f"SELECT * FROM (SELECT {DATE}, {correlation(x, y, least)} AS ic, count({x}) AS n FROM {{panel}} WHERE {where} GROUP BY {DATE}) q WHERE ic IS NOT NULL"


def daily_ic(p: Layers, factor: str, label: str, rules: MetricRules = STRUCTURED) -> tuple[str, list[str]]:
    """(SQL of daily Pearson correlations, columns it needs)."""
    x, y = joint(p, *masked(p, factor, label))
    return ic_sql(x, y, rules.least), [x, y]


def daily_rank_ic(p: Layers, factor: str, label: str, rules: MetricRules = STRUCTURED) -> tuple[str, list[str]]:
    """(SQL of daily rank correlations, columns it needs)."""
    x, y = masked(p, factor, label)
    if rules.joint:
        x, y = (cs.average_rank(p, c) for c in joint(p, x, y))
    else:
        x, y = joint(p, cs.average_rank(p, x), cs.average_rank(p, y))
    return ic_sql(x, y, rules.least), [x, y]


def scored(series: str, prefix: str) -> str:
    """One row: mean, ratio (oriented mean over sample deviation), win rate and direction of a series with column ic, in one pass over it.

    The direction is 1 if the mean is not negative, else -1. No dates give zeros and direction 1; a series without spread
    has ratio 0.
    """
    return f"""SELECT round(coalesce(m, 0), 6) + 0.0E0 AS {prefix}, round(direction * CASE WHEN days > 1 AND s > 1E-12 THEN m / s ELSE 0 END, 6) + 0.0E0 AS {prefix}_ir,
      round(CASE WHEN days > 0 THEN CASE WHEN direction > 0 THEN up ELSE down END * 1.0E0 / days ELSE 0 END, 6) AS {prefix}_win, direction, days
      FROM (SELECT avg(ic) AS m, stddev_samp(ic) AS s, count(ic) AS days, count(CASE WHEN round(ic, 9) > 0 THEN 1 END) AS up, count(CASE WHEN round(ic, 9) < 0 THEN 1 END) AS down,
        CASE WHEN coalesce(avg(ic), 0) >= 0 THEN 1 ELSE -1 END AS direction FROM ({series}) s) t"""


def coverage_sql(p: Layers, factor: str, label: str) -> tuple[str, list[str]]:
    """Mean over dates of known factors among tradeable names; dates without any are skipped."""
    x = masks.tradeable_only(p, factor)
    return (f"SELECT round(avg(c), 6) AS coverage, count(*) AS days FROM (SELECT count({x}) * 1.0E0 / sum(CASE WHEN tradeable THEN 1 ELSE 0 END) AS c FROM {{panel}} GROUP BY {DATE} HAVING sum(CASE WHEN tradeable THEN 1 ELSE 0 END) > 0) q", [x])


def ndcg_columns(p: Layers, x: str, y: str, k: int | None = None, fraction: float = 0.1, bins: int = 10, own_bins: bool = True) -> tuple[str, ...]:
    """(known, place by factor, place by gain, gain, places that count) of masked factor and label."""
    fx, fy = joint(p, x, y)
    if own_bins:
        ok = p.let(f"CASE WHEN {y} IS NOT NULL THEN 1 ELSE 0 END")
        i = p.placed(p.ordering(y), ok)
        n = p.let(f"count({y}) OVER (PARTITION BY {DATE})")
        g = p.let(f"least({bins}, {n})")
        rel = p.let(f"CASE WHEN {y} IS NOT NULL THEN {quantile_bin(i, n, g)} END")
    else:
        r = cs.average_rank(p, fy)
        n = p.let(f"count({fy}) OVER (PARTITION BY {DATE})")
        rel = p.let(f"least({bins} - 1, floor(({r} - 1) * {bins} / {n}))")
    gain = p.let(f"CASE WHEN {fx} IS NOT NULL THEN power(2.0E0, {rel}) - 1 END")
    known = p.let(f"CASE WHEN {fx} IS NOT NULL THEN 1 ELSE 0 END")
    place = p.placed(p.ordering(fx), known, down=True)
    best = p.placed(gain, known, down=True)
    m = p.let(f"count({fx}) OVER (PARTITION BY {DATE})")
    at = p.let(f"least({k}, {m})" if k else f"greatest(1, ceil({m} * {fraction}))")
    return known, place, best, gain, at


def ndcg_sql(p: Layers, factor: str, label: str, k: int | None = None, fraction: float = 0.1, bins: int = 10, own_bins: bool = True) -> tuple[str, list[str]]:
    """Daily NDCG at k, or at max(1, ceil(names * fraction)).

    ``own_bins``: relevance is the quantile bin, from 0, of a name among all labels of the date, by position; otherwise
    floor((average rank - 1) * bins / n) among names with factor and label, which are two at least. Gains are
    2 ** relevance - 1, discounts log2(place + 1); ties by contract; dates without any gain are left out.
    """
    known, place, best, gain, at = ndcg_columns(p, *masked(p, factor, label), k, fraction, bins, own_bins)
    part = lambda i: f"sum(CASE WHEN {i} <= {at} THEN {gain} / (ln({i} + 1) / ln(2.0E0)) ELSE 0 END)"
    inner = f"SELECT {DATE}, {part(place)} AS dcg, {part(best)} AS idcg FROM {{panel}} WHERE {known} = 1 GROUP BY {DATE} HAVING count(*) >= {1 if own_bins else 2}"
    return f"SELECT {DATE}, round(dcg / idcg, 6) AS ndcg FROM ({inner}) q WHERE idcg > 0", [known, place, best, gain, at]


def quantile_bin(i: str, n: str, g: str) -> str:
    """Bin, from 0, of position i of n when cut into g quantile bins."""
    return f"CASE WHEN {n} > 1 THEN greatest(0, ceil(({i} - 1) * {g} * 1.0E0 / ({n} - 1)) - 1) ELSE 0 END"


def turnover_columns(p: Layers, x: str, k: int | None = None, fraction: float = 0.1) -> tuple[str, str]:
    """(weight in the equally weighted top set, weight one date before) of a masked factor."""
    top = masks.top_k(p, x, k, fraction)
    w = p.let(f"{top} / CASE WHEN sum({top}) OVER (PARTITION BY {DATE}) > 0 THEN sum({top}) OVER (PARTITION BY {DATE}) END")
    return w, p.let(f"lag({w}) OVER (PARTITION BY {NAME} ORDER BY {DATE})")


def turnover_sql(p: Layers, factor: str, k: int | None = None, fraction: float = 0.1) -> tuple[str, list[str]]:
    """Mean of half the summed weight changes of an equally weighted top set, over pairs of dates where both have one."""
    w, before = turnover_columns(p, masks.tradeable_only(p, factor), k, fraction)
    return f"SELECT round(avg(t), 6) AS turnover, count(*) AS pairs FROM (SELECT {DATE}, sum(abs({w} - {before})) / 2 AS t FROM {{panel}} WHERE {w} IS NOT NULL AND {before} IS NOT NULL GROUP BY {DATE}) q", [w, before]


def stability_sql(p: Layers, factor: str) -> tuple[str, list[str]]:
    """Mean correlation of the factor with itself one date later, over three names or more."""
    x = masks.tradeable_only(p, factor)
    a, b = joint(p, x, p.let(f"lead({x}) OVER (PARTITION BY {NAME} ORDER BY {DATE})"))
    return f"SELECT round(avg(ic), 6) AS stability, count(*) AS days FROM ({ic_sql(a, b, 3)}) q", [a, b]


def long_side(p: Layers, factor: str, label: str, rules: MetricRules = STRUCTURED) -> tuple[str, list[str]]:
    """Daily rank correlations within the better half of the factor."""
    half = masks.top_half(p, factor)
    x, y = joint(p, masks.gate_nan(p, factor, half), masks.tradeable_only(p, label))
    return ic_sql(*(cols := [cs.average_rank(p, x), cs.average_rank(p, y)]), rules.least), cols


def style_correlation_sql(p: Layers, factor: str, styles: list[str], least: int = 3) -> tuple[str, list[str]]:
    """|mean daily correlation| of a factor with each style."""
    x = masks.tradeable_only(p, factor)
    parts, cols = [], []
    for s in styles:
        a, b = joint(p, x, cs.zscore(p, masks.tradeable_only(p, s)))
        cols += [a, b]
        parts.append(f"SELECT '{s}' AS style, round(abs(avg(ic)), 6) AS corr FROM ({ic_sql(a, b, least)}) q")
    return " UNION ALL ".join(parts), cols
