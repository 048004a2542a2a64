"""Functions over one date's contracts, or those of one industry on it."""

from __future__ import annotations

from quillon.plans.layers import DATE, Layers


def _part(by: str | None) -> str:
    return f"PARTITION BY {DATE}" + (f", {by}" if by else "")


def _with_group(x: str, by: str | None) -> str:
    return f"{x} IS NOT NULL" + (f" AND {by} IS NOT NULL" if by else "")


def average_rank(p: Layers, x: str, by: str | None = None) -> str:
    """Ascending rank from 1, ties at their average; missing values have none and count for none."""
    v = p.let(p.ordering(x))
    ok = p.let(f"CASE WHEN {_with_group(x, by)} THEN 1 ELSE 0 END")
    return p.ranked(v, ok, _part(by), by)


def rank_pct(p: Layers, x: str, by: str | None = None) -> str:
    """Average rank over the number of values, in (0, 1]."""
    return p.rank_share(average_rank(p, x, by), _part(by))


def centred_rank(p: Layers, x: str, by: str | None = None) -> str:
    return p.let(f"{rank_pct(p, x, by)} - 0.5E0")


def demean(p: Layers, x: str, by: str | None = None) -> str:
    m = p.let(f"avg({x}) OVER ({_part(by)})")
    return p.let(f"CASE WHEN {_with_group(x, by)} THEN {x} - {m} END")


def zscore(p: Layers, x: str, by: str | None = None, flat: str = "missing", eps: float = 1e-8) -> str:
    """(x - mean) / (sample deviation + eps) for two values or more.

    A date without spread gives missing values (``flat="missing"``) or zeros (``"zero"``).
    """
    m, s, n = (p.let(f"{f}({x}) OVER ({_part(by)})") for f in ("avg", "stddev_samp", "count"))
    e = f"{eps:.0E}"
    spread = f"CASE WHEN {s} > {e} THEN ({x} - {m}) / ({s} + {e}) {'ELSE 0.0E0 ' if flat == 'zero' else ''}END"
    return p.let(f"CASE WHEN {_with_group(x, by)} AND {n} >= 2 THEN {spread} END")


def quantile(p: Layers, x: str, q: float) -> str:
    return p.let(p.percentile(x, q, _part(None)))


def winsorize(p: Layers, x: str, tail: float = 0.05) -> str:
    """Clipped to the date's quantiles (linear); fewer than three values give missing ones."""
    low, high = quantile(p, x, tail), quantile(p, x, 1 - tail)
    n = p.let(f"count({x}) OVER ({_part(None)})")
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {n} >= 3 THEN least(greatest({x}, {low}), {high}) END")


def moments(p: Layers, y: str, x: str, by: str | None = None) -> tuple[str, ...]:
    """(n, mean y, mean x, Sxy, Sxx, Syy) over jointly known values of a date."""
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    yy, xx = p.let(f"CASE WHEN {ok} THEN {y} END"), p.let(f"CASE WHEN {ok} THEN {x} END")
    n = p.let(f"count({yy}) OVER ({_part(by)})")
    my, mx = p.let(f"avg({yy}) OVER ({_part(by)})"), p.let(f"avg({xx}) OVER ({_part(by)})")
    sxy = p.let(f"sum(({xx} - {mx}) * ({yy} - {my})) OVER ({_part(by)})")
    sxx = p.let(f"sum(({xx} - {mx}) * ({xx} - {mx})) OVER ({_part(by)})")
    syy = p.let(f"sum(({yy} - {my}) * ({yy} - {my})) OVER ({_part(by)})")
    return n, my, mx, sxy, sxx, syy


def residual(p: Layers, y: str, x: str, flat: str = "missing", least: int = 3) -> str:
    """Residual of y on x with intercept, over a date's jointly known values.

    Fewer than ``least`` of them give missing values; an x without spread gives missing ones or, with ``flat="demean"``,
    y less its mean.
    """
    n, my, mx, sxy, sxx, _ = moments(p, y, x)
    other = f"ELSE {y} - {my} " if flat == "demean" else ""
    return p.let(f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND {n} >= {least} THEN CASE WHEN {sxx} > 1E-12 THEN {y} - {my} - {sxy} / {sxx} * ({x} - {mx}) {other}END END")


def residual_two(p: Layers, y: str, a: str, b: str, ridge: float = 1e-6, least: int = 4) -> str:
    """Residual of y on two controls with intercept and a ridge on the slopes, in closed form over a date's jointly known values."""
    ok = f"{y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL"
    v = [p.let(f"CASE WHEN {ok} THEN {c} END") for c in (y, a, b)]
    n = p.let(f"count({v[0]}) OVER ({_part(None)})")
    d = [p.let(f"{c} - avg({c}) OVER ({_part(None)})") for c in v]
    s = lambda i, j: p.let(f"sum({d[i]} * {d[j]}) OVER ({_part(None)})")
    e = f"{ridge:.0E}"
    saa, sbb, sab, say, sby = s(1, 1), s(2, 2), s(1, 2), s(1, 0), s(2, 0)
    det = p.let(f"({saa} + {e}) * ({sbb} + {e}) - {sab} * {sab}")
    ba = p.let(f"CASE WHEN abs({det}) > 1E-300 THEN (({sbb} + {e}) * {say} - {sab} * {sby}) / {det} END")
    bb = p.let(f"CASE WHEN abs({det}) > 1E-300 THEN (({saa} + {e}) * {sby} - {sab} * {say}) / {det} END")
    return p.let(f"CASE WHEN {n} >= {least} THEN {d[0]} - {ba} * {d[1]} - {bb} * {d[2]} END")


def one_hot(p: Layers, group: str, levels: list[str]) -> list[str]:
    """0/1 columns of all levels but the first; missing where the group is. One level gives none."""
    return [p.let(f"CASE WHEN {group} IS NULL THEN NULL WHEN {group} = '{v}' THEN 1.0E0 ELSE 0.0E0 END") for v in sorted(levels)[1:]]
